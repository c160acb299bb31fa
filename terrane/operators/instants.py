"""Mixed timestamp texts to UTC instants: candidate readings as arrays, chosen by Viterbi over each source's record order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import strip
from terrane.session import cut, small_methods

#: Abbreviations of zones, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "ART": -180,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
ZONE = r"(?:\s*(Z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?(?::?\d{2})?|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)?(?:\s*\[([^\]]+)\])?(?:\s*\([A-Za-z ]+\))?)"
YMD = rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[T ]\s*{TIME}{ZONE})?$"
COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?{ZONE}$"
NUMERIC = rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:,?\s+{TIME}\s*([AaPp]\.?[Mm]\.?)?{ZONE})?$"
DAY_FIRST = rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[ -]([A-Za-z]{{3,9}})\.?[ -](\d{{4}}|\d{{2}})(?:,?\s+{TIME}\s*([AaPp]\.?[Mm]\.?)?{ZONE})?$"
MONTH_FIRST = rf"^(?:[A-Za-z]{{3,9}},?\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{TIME}\s*([AaPp]\.?[Mm]\.?)?{ZONE})?$"
CTIME = rf"^(?:[A-Za-z]{{3,9}},?\s+)?([A-Za-z]{{3,9}})\s+(\d{{1,2}})\s+{TIME}\s+(?:([A-Za-z]{{2,5}})\s+)?(\d{{4}}){ZONE}$"
NUMBER = r"^(\d{9,19})(?:[.,](\d+))?(?:\s.*)?$"
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"

#: What a switch of format and what a step back in time cost. One choice touches two steps, so a path gains at most GAIN by it.
SWITCH, BACKWARD = 1.0, 2.0
GAIN = 2 * (SWITCH + BACKWARD)
#: What a reading against a rule costs: the order of day and month a source declares, the first pass of an hour that occurs twice, the
#: unit told by a number's length. More than GAIN, so where a rule is given it holds; where none is, the path decides.
AGAINST = 8.0
UNITS = (1_000_000, 1_000, 1)


FIELDS = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "zone", "bracket")
#: Per family: a cheap test, the pattern, and its groups in the order of FIELDS (0: the family has no such part).
FAMILIES = (
    ("ymd", r"^\d{4}[-/.]\d", YMD, (1, 3, 4, 5, 6, 7, 8, 0, 9, 10)),
    ("compact", r"^\d{8}[T ]?\d{4}(\d{2})?([^\d]|$)", COMPACT, (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    ("numeric", r"^\d{1,2}[-/.]\d", NUMERIC, (4, 3, 1, 5, 6, 7, 8, 9, 10, 11)),
    ("day", r"[A-Za-z]{3}", DAY_FIRST, (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    ("month", r"[A-Za-z]{3}", MONTH_FIRST, (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
    ("ctime", r"[A-Za-z]{3}", CTIME, (8, 1, 2, 3, 4, 5, 6, 0, 9, 10)),
)


def _month(name: Column) -> Column:
    n = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))).cast("int")
    return F.when(name.rlike(r"^\d+$"), name.try_cast("int")).when(n > 0, n)


def _days(year: Column, month: Column, day: Column) -> Column:
    """The date, null where the calendar has none."""
    return F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))


def _offset(zone: Column) -> Column:
    """Minutes east of UTC for an offset or abbreviation, else null."""
    shape = r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?.*$"
    hours, mins = F.regexp_extract(zone, shape, 2), F.regexp_extract(zone, shape, 3)
    sign = F.when(F.regexp_extract(zone, shape, 1) == "-", -1).otherwise(1)
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.when(hours != "", sign * (hours.cast("int") * 60 + F.coalesce(mins.try_cast("int"), F.lit(0)))).otherwise(F.try_element_at(table, F.upper(zone)))


def zone_names(spark) -> list[str]:
    """Names of the zones this JVM knows; a fixed set of some 600 names, whatever the data."""
    return [z for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()]


def _slots(values: DataFrame, value: str, tz: str, order: str, second_pass: float) -> DataFrame:
    """Adds up to four readings of the text in plain columns _f0 to _f3 (form), _u0.. (instant, null without one), _c0.. (cost).

    Slot 0 is the first pass of the day-first reading, of any other form, or of the unit a number's length tells; 1 its second pass; 2 and
    3 are the month-first reading; the other units of a number take 1 to 3. Each text is matched once; the parts are taken from the
    one match. Only where several readings are left is an array made of them.
    """
    known = ", ".join(f"'{z}'" for z in sorted(zone_names(values.sparkSession)))  # becomes a hash set
    v = F.regexp_replace(F.translate(strip(value), "\u2212\u2010\u2011\u2012\u2013\u00a0\u202f\u2009", "-----   "), r"\s+", " ")
    c = F.col("_v")
    family = F.lit(None).cast("string")
    for fmt, test, pattern, _ in reversed(FAMILIES):
        # forms that begin with digits are told apart by their beginning alone; whether the rest fits shows when the parts are taken
        family = F.when(c.rlike(test) if test[0] == "^" else c.rlike(test) & c.rlike(pattern), F.lit(fmt)).otherwise(family)
    family = F.when(c.rlike(NUMBER) & ~c.rlike(FAMILIES[1][1]), F.lit("number")).otherwise(family)
    taken = F.lit(None).cast("string")
    for fmt, _, pattern, groups in FAMILIES:
        form = "\x01".join(f"${g}" if g else "" for g in groups)
        if fmt == "ctime":
            form = form.replace("$9", "$9$7")  # the zone may stand before the year
        taken = F.when(F.col("_f") == fmt, F.regexp_replace(c, pattern, form)).otherwise(taken)
    out = values.withColumn("_v", v).withColumn("_f", family).withColumn("_x", taken).withColumn("_p", F.when(F.col("_x").contains("\x01"), F.split("_x", "\x01")))
    g = {n: F.when(F.col("_p")[k] != "", F.col("_p")[k]) for k, n in enumerate(FIELDS)}
    year = F.when(F.length(g["year"]) == 2, F.concat(F.lit("20"), g["year"])).otherwise(g["year"]).cast("int")
    hour, minute, second = (F.coalesce(g[x].cast("int"), F.lit(0)) for x in ("hour", "minute", "second"))
    half = F.lower(F.substring(g["half"], 1, 1))
    clock = F.when(half == "p", F.pmod(hour, F.lit(12)) + 12).when(half == "a", F.pmod(hour, F.lit(12))).otherwise(hour)
    valid = (hour < 24) & (minute < 60) & (second < 60) & (half.isNull() | hour.between(1, 12)) & (year > 0)
    micro = F.coalesce(F.rpad(F.substring(g["fraction"], 1, 6), 6, "0").cast("bigint"), F.lit(0))
    of_day = F.when(valid, (clock * 3600 + minute * 60 + second).cast("bigint") * 1_000_000 + micro)
    out = out.withColumns({
        "_y": year, "_m": _month(g["month"]), "_d": g["day"].cast("int"), "_t": of_day, "_off": _offset(g["zone"]),
        "_named": F.coalesce(g["bracket"], g["zone"]), "_has": g["zone"].isNotNull(),
    })
    given = F.expr(f"_named IN ({known})")
    local = F.when(F.expr(f"`{tz}` IN ({known})"), F.col(tz)).otherwise(F.lit("UTC"))
    out = out.withColumn("_zone", F.when(given, F.col("_named")).when(~F.col("_has"), local))
    is_number, numeric = F.col("_f") == "number", F.col("_f") == "numeric"
    wall = lambda y, m, d: F.unix_micros(_days(F.col(y), F.col(m), F.col(d)).cast("timestamp")) + F.col("_t")
    out = out.withColumns({"_w0": F.when(F.col("_p").isNotNull(), wall("_y", "_m", "_d")), "_w2": F.when(numeric, wall("_y", "_d", "_m"))})
    at = lambda w: F.when(F.col("_off").isNotNull(), F.col(w) - F.col("_off").cast("bigint") * 60_000_000).when(
        F.col("_zone").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col(w)), F.col("_zone")))
    )
    digits = F.regexp_extract(c, NUMBER, 1)
    fraction = F.coalesce(F.rpad(F.substring(F.regexp_extract(c, NUMBER, 2), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    out = out.withColumns({"_n": F.when(is_number, digits), "_h": F.when(is_number, fraction), "_g0": at("_w0"), "_g2": at("_w2")})
    num, size = F.col("_n").try_cast("bigint"), F.length("_n")
    fine = F.when(size > 3, F.substring(F.col("_n"), F.lit(1), size - 3).try_cast("bigint"))  # nanoseconds are cut, not rounded
    told = F.when(size <= 11, num * 1_000_000 + F.col("_h")).when(size <= 14, num * 1000).when(size <= 17, num).otherwise(fine)
    hour = 3_600_000_000
    back = lambda g, w: F.when(
        F.col("_off").isNull() & (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(F.col(g) + hour), F.col("_zone"))) == F.col(w)), F.col(g) + hour
    )
    against = lambda this: F.when(F.col(order).isNull() | (F.trim(order) == ""), 0.0).when((F.col(order) == "MDY") == F.lit(this == "mdy"), 0.0).otherwise(AGAINST)
    first, last = F.when(numeric, against("dmy")).otherwise(0.0), F.when(is_number, AGAINST).otherwise(against("mdy"))
    form = F.when(numeric, "dmy").otherwise(F.col("_f"))
    return out.withColumns({
        "_u0": F.when(is_number, told).otherwise(F.col("_g0")), "_u1": F.when(is_number, F.when(size <= 11, num * 1000)).otherwise(back("_g0", "_w0")),
        "_u2": F.when(is_number, F.when(size <= 14, num)).otherwise(F.col("_g2")), "_u3": F.when(is_number, F.when(size <= 17, fine)).otherwise(back("_g2", "_w2")),
        "_c0": first, "_c1": F.when(is_number, AGAINST).otherwise(first + second_pass), "_c2": last, "_c3": F.when(is_number, AGAINST).otherwise(last + second_pass),
        "_f0": form, "_f1": form, "_f2": F.when(is_number, "number").otherwise("mdy"), "_f3": F.when(is_number, "number").otherwise("mdy"),
    }).select(*values.columns, *[f"_{x}{k}" for x in "fuc" for k in range(4)])


def _readings() -> Column:
    each = [F.struct(F.col(f"_f{k}").alias("fmt"), F.col(f"_u{k}").alias("utc_us"), F.col(f"_c{k}").alias("cost")) for k in range(4)]
    return F.filter(F.array(*each), lambda x: x["utc_us"].isNotNull())


def candidates(values: DataFrame, value: str = "value", tz: str = "tz", order: str = "date_order", second_pass: float = AGAINST) -> DataFrame:
    """Adds ``cands``: array of (fmt, utc_us, cost), every valid reading of the text.

    A zone or offset in the text wins, else the source's ``tz`` holds (null or unknown: UTC). Numeric dates are read in
    both orders, the one against the source's ``date_order`` at a cost; without one, both are free. An hour that occurs twice gives
    both passes, a bare number one reading per unit. Null, blank and impossible values give an empty array.
    """
    return _slots(values, value, tz, order, second_pass).select(*values.columns, _readings().alias("cands"))


def hopeful(slots: DataFrame) -> DataFrame:
    """Without the readings that no path may choose: one dearer than the cheapest by more than GAIN never pays. Exact, whatever the neighbours."""
    least = F.least(*[F.when(F.col(f"_u{k}").isNotNull(), F.col(f"_c{k}")) for k in range(4)])
    return slots.withColumn("_least", least).withColumns({f"_u{k}": F.when(F.col(f"_c{k}") <= F.col("_least") + GAIN, F.col(f"_u{k}")) for k in range(4)})


# Viterbi. The state of a record is its chosen candidate. Blocks are sorted range partitions; a block's (min, +) matrix from
# its first to its last record is all that crosses partitions, so a source with any share of the rows stays parallel.


def _step(prev: list, cur: list) -> np.ndarray:
    w = np.empty((len(prev), len(cur)))
    for i, p in enumerate(prev):
        for j, q in enumerate(cur):
            w[i, j] = q["cost"] + SWITCH * (p["fmt"] != q["fmt"]) + BACKWARD * (q["utc_us"] < p["utc_us"])
    return w


def _path(rows: list[list], start: int | None = None, end: int | None = None) -> list[int]:
    """The cheapest choice for each record of a run; ties go to the earlier candidate, first to last."""
    cost = np.array([c["cost"] for c in rows[0]])
    if start is not None:
        cost = np.where(np.arange(len(cost)) == start, cost, np.inf)
    back = []
    for p, q in zip(rows, rows[1:]):
        if len(p) == len(q) == 1:
            back.append(np.zeros(1, dtype=int))
            cost = np.zeros(1)  # a single reading on both sides decouples the path
            continue
        t = cost[:, None] + _step(p, q)
        back.append(t.argmin(axis=0))
        cost = t.min(axis=0)
    at = int(cost.argmin()) if end is None else end
    out = [at]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return out[::-1]


def _matrix(rows: list[list]) -> np.ndarray:
    """Cost of the cheapest path for each first and last candidate; the first one's own cost is left out."""
    m = np.where(np.eye(len(rows[0])) > 0, 0.0, np.inf)
    for p, q in zip(rows, rows[1:]):
        m = (m[:, :, None] + _step(p, q)[None]).min(axis=1)
    return m


def _cell(pdf: pd.DataFrame, i: int) -> list:
    """The readings of a row: the several ones, or the single one kept in plain columns."""
    more = pdf["more"].iat[i]
    return list(more) if more is not None else [{"fmt": pdf["fmt"].iat[i], "utc_us": int(pdf["utc_us"].iat[i]), "cost": 0.0}]


def _pick(source: np.ndarray, many: np.ndarray, cell, ends: dict) -> dict[int, int]:
    """Index of the choice for the rows of a sorted block that have several readings; ends: source -> (start, end) forced by the neighbours."""
    pick: dict[int, int] = {}
    s, k = source, 0
    while k < len(many):  # a run of ambiguous records and the record on either side
        a = b = many[k]
        while k + 1 < len(many) and many[k + 1] == b + 1 and s[many[k + 1]] == s[a]:
            k += 1
            b = many[k]
        k += 1
        lo = a - 1 if a and s[a - 1] == s[a] else a
        hi = b + 1 if b + 1 < len(s) and s[b + 1] == s[b] else b
        first, last = lo == a and (a == 0 or s[a - 1] != s[a]), hi == b and (b + 1 == len(s) or s[b + 1] != s[b])
        start, end = ends.get(s[a], (None, None))
        got = _path([cell(i) for i in range(lo, hi + 1)], start if first else None, end if last else None)
        pick.update(zip(range(a, b + 1), got[a - lo :]))
    return pick


def choose(
    values: DataFrame, source: str, order: str, keep: list[str], value: str = "value", tz: str = "tz", date_order: str = "date_order", second_pass: float = AGAINST
) -> DataFrame:
    """One instant per record with any reading: ``keep`` plus utc_us and cost (of the reading), by Viterbi along ``order`` within ``source``.

    ``source`` and ``order`` must be non-null; records of equal order are taken by ``keep``. Records without a
    reading do not take part. Empty input gives an empty result.
    """
    rows = values.select(*dict.fromkeys([source, order, *keep, value, tz, date_order]))
    # Texts are sorted before they are read, so that the readings are made once, in place, and never shuffled.
    placed = rows.repartitionByRange(source, order, *keep).sortWithinPartitions(source, order, *keep)
    read = hopeful(_slots(placed, value, tz, date_order, second_pass))
    first = lambda x: F.coalesce(*[F.when(F.col(f"_u{k}").isNotNull(), F.col(f"_{x}{k}")) for k in range(4)])
    several = sum((F.col(f"_u{k}").isNotNull().cast("int") for k in range(4)), F.lit(0)) > 1
    # a single reading travels in plain columns; the filter stands after the cut, or it would be pushed below and read each text again
    with small_methods(values.sparkSession):
        blocks = cut(read.select(
            *dict.fromkeys([source, order, *keep]), first("f").alias("fmt"), first("u").alias("utc_us"), first("c").alias("cost"),
            F.when(several, _readings()).alias("more"), F.spark_partition_id().alias("block"),
        )).where("utc_us IS NOT NULL")
    cell = "fmt string, utc_us bigint, cost double"

    def summaries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict = {}
        for pdf in parts:
            s = pdf[source].to_numpy()
            edge = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else []
            many = pdf["more"].notna().to_numpy()
            for lo, hi in zip(edge, [*edge[1:], len(s)]):
                src, at = s[lo], lo
                if src not in got:
                    first = _cell(pdf, lo)
                    got[src] = [int(pdf["block"].iat[lo]), first, first, _matrix([first])]
                    at = lo + 1
                x = got[src]
                if at == hi:
                    continue
                sure = at + np.flatnonzero(~many[at:hi])
                # only the ambiguous head and tail matter once a single reading is met; the middle decouples
                head = range(at, (sure[0] if len(sure) else hi - 1) + 1)
                m = _matrix([x[2], *(_cell(pdf, i) for i in head)])
                if len(sure):
                    m = m.min(axis=1, keepdims=True) + _matrix([_cell(pdf, i) for i in range(sure[-1], hi)]).min(axis=0, keepdims=True)
                x[3] = (x[3][:, :, None] + m[None]).min(axis=1)
                x[2] = _cell(pdf, hi - 1)
            for src in list(got)[1:-1]:  # a source inside the block needs no neighbour
                del got[src]
        yield pd.DataFrame(
            [(s, b, list(f), list(last), m.ravel().tolist()) for s, (b, f, last, m) in got.items()], columns=["source", "block", "first", "last", "m"]
        )

    # At most two sources per block reach over its rim, so this table has at most two rows per partition.
    rims = blocks.select(F.col(source), "fmt", "utc_us", "more", "block").mapInPandas(
        summaries, f"source string, block int, first array<struct<{cell}>>, last array<struct<{cell}>>, m array<double>"
    )

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        rows = pdf.to_dict("records")
        if len(rows) == 1:
            return pd.DataFrame([], columns=["source", "block", "start", "end"])
        cost, back = np.array([c["cost"] for c in rows[0]["first"]]), []
        states: list[np.ndarray] = []
        for i, r in enumerate(rows):
            m = np.array(r["m"]).reshape(len(r["first"]), len(r["last"]))
            if i:
                t = cost[:, None] + _step(rows[i - 1]["last"], r["first"])
                back.append(t.argmin(axis=0))
                cost = t.min(axis=0)
            t = cost[:, None] + m
            states.append(t.argmin(axis=0))
            cost = t.min(axis=0)
        end = int(cost.argmin())
        out = []
        for i in range(len(rows) - 1, -1, -1):
            start = int(states[i][end])
            out.append((rows[i]["source"], rows[i]["block"], start, end))
            if i:
                end = int(back[i - 1][start])
        return pd.DataFrame(out, columns=["source", "block", "start", "end"])

    forced = rims.groupBy("source").applyInPandas(join_up, "source string, block int, start int, end int")
    ends: dict[int, dict] = {}
    for r in forced.collect():  # two rows per partition at most
        ends.setdefault(r["block"], {})[r["source"]] = (r["start"], r["end"])
    shared = values.sparkSession.sparkContext.broadcast(ends)
    fields = [f for f in blocks.schema.fields if f.name in keep]
    names = [f.name for f in fields]

    def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # an ambiguous run, with the certain record before it, may go on in the next batch
        for pdf in parts:
            sure = np.flatnonzero(pdf["more"].isna().to_numpy())
            if not len(sure):
                held.append(pdf)
                continue
            stop = sure[-1]
            yield emit(pd.concat([*held, pdf.iloc[: stop + 1]], ignore_index=True) if held else pdf.iloc[: stop + 1].reset_index(drop=True), drop_last=True)
            held = [pdf.iloc[stop:]]
        if held:
            yield emit(pd.concat(held, ignore_index=True), drop_last=False)

    def emit(pdf: pd.DataFrame, drop_last: bool) -> pd.DataFrame:
        many = np.flatnonzero(pdf["more"].notna().to_numpy())
        out = pdf[[*names, "utc_us", "cost"]]
        if len(many):
            out = out.copy()
            ends_here = shared.value.get(int(pdf["block"].iat[0]), {})
            for i, k in _pick(pdf[source].to_numpy(), many, lambda i: _cell(pdf, i), ends_here).items():
                out.iat[i, len(names)], out.iat[i, len(names) + 1] = pdf["more"].iat[i][k]["utc_us"], pdf["more"].iat[i][k]["cost"]
        return out.iloc[:-1] if drop_last else out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", utc_us bigint, cost double"
    return blocks.select(*names, *([source] if source not in names else []), "fmt", "utc_us", "cost", "more", "block").mapInPandas(decide, schema)


def instants_of_tables(file_metrics: DataFrame, snapshot: DataFrame, repos: DataFrame, estates: DataFrame) -> DataFrame:
    """(table_name, row_id, field, value, utc_us) of file_metrics.first_change, last_change and snapshot.taken_at.

    The source of a value is its repo or estate and column. Snapshots are taken in the order they were loaded; files have but their
    row ids; a redelivered row stands beside itself and changes no path. A repo or estate that is not listed gives UTC and no date
    order. A value whose only readings are against the declared order denotes no instant.
    """
    zone = lambda t, k: t.groupBy(k).agg(F.min("tz").alias("tz"), F.min("date_order").alias("date_order"))
    fields = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("first_change", "last_change")]
    fm = (
        file_metrics.select(F.lit("file_metrics").alias("table_name"), F.col("metric_id").alias("row_id"), F.col("repo").alias("owner"), F.inline(F.array(*fields)))
        .withColumn("at", F.col("row_id"))
        .join(zone(repos, "repo").withColumnRenamed("repo", "owner"), "owner", "left")
    )
    sn = snapshot_values(snapshot).join(zone(estates, "estate").withColumnRenamed("estate", "owner"), "owner", "left")
    rows = fm.unionByName(sn).where("value IS NOT NULL AND row_id IS NOT NULL")
    rows = rows.withColumn("source", F.concat_ws("|", "table_name", "field", F.coalesce("owner", F.lit(""))))
    return choose(rows, "source", "at", ["table_name", "row_id", "field", "value"]).where(F.col("cost") < AGAINST)


def loaded(col: str = "loaded_at") -> Column:
    """A load time as a number to sort by; unknown ones come first."""
    return F.coalesce(F.unix_micros(F.col(col).cast("timestamp")), F.lit(0))


def snapshot_values(snapshot: DataFrame) -> DataFrame:
    """(table_name, row_id, owner, field, value, at): taken_at of each snapshot once, at its first load."""
    one = snapshot.groupBy("snapshot_id", "estate", "taken_at").agg(F.min(loaded()).alias("at"))
    return one.select(F.lit("snapshot").alias("table_name"), F.col("snapshot_id").alias("row_id"), F.col("estate").alias("owner"), F.lit("taken_at").alias("field"), F.col("taken_at").alias("value"), "at")


def undeclared(snapshot: DataFrame, estates: DataFrame) -> DataFrame:
    """(estate, values, ambiguous, agree): taken_at read as if no estate declared an order of day and month.

    ambiguous: values that the declared order and the other read differently; agree: those of them that the path along the loads reads
    as declared. A check of the path, not a source of instants.
    """
    tz = estates.groupBy("estate").agg(F.min("tz").alias("tz"), F.min("date_order").alias("date_order")).withColumnRenamed("estate", "owner")
    rows = snapshot_values(snapshot).where("owner IS NOT NULL AND value IS NOT NULL AND row_id IS NOT NULL").join(tz, "owner", "left").withColumn("none", F.lit(None).cast("string"))
    free = cut(choose(rows, "owner", "at", ["owner", "row_id", "value", "tz", "date_order"], date_order="none"))
    held = candidates(free.withColumnRenamed("cost", "_paid")).withColumn("one", F.filter("cands", lambda x: x["cost"] < AGAINST)[0]["utc_us"])
    split = F.coalesce(F.exists("cands", lambda x: (x["cost"] >= AGAINST) & x["fmt"].isin("dmy", "mdy") & (x["utc_us"] != F.col("one"))), F.lit(False))
    return held.groupBy(F.col("owner").alias("estate")).agg(
        F.count("*").alias("values"), F.count_if(split).alias("ambiguous"), F.count_if(split & (F.col("utc_us") == F.col("one"))).alias("agree")
    )


def found(file_metrics: DataFrame, snapshot: DataFrame, repos: DataFrame, estates: DataFrame) -> DataFrame:
    """p4_found: every instant whose text is not already the canonical form."""
    return (
        instants_of_tables(file_metrics, snapshot, repos, estates)
        .where(~F.col("value").rlike(CANONICAL))
        .select("table_name", "row_id", "field", "utc_us")
        .distinct()
    )
