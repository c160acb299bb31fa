import itertools
import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from conftest import rows

from terrane.operators import instants

V = "row_id bigint, source string, value string, tz string, date_order string"


def us(y, mo, d, h=0, mi=0, s=0, micro=0, tz="UTC"):
    t = datetime(y, mo, d, h, mi, s, micro)
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1) - int(t.replace(tzinfo=ZoneInfo(tz)).utcoffset().total_seconds()) * 1_000_000


CASES = [
    ("2025-01-06T14:34:53+11:00[Australia/Sydney]", us(2025, 1, 6, 3, 34, 53)),
    ("2025-08-22 18:23:56 +0000", us(2025, 8, 22, 18, 23, 56)),
    ("2025-04-29T01:31:51−05:00", us(2025, 4, 29, 6, 31, 51)),
    ("1760152843683", 1760152843683000),
    ("1759677627 +0200", 1759677627000000),
    ("1747035577378381", 1747035577378381),
    ("1747035577378381999", 1747035577378381),
    ("2026-05-29 18:04:17,037", us(2026, 5, 29, 18, 4, 17, 37000, "Europe/Berlin")),
    ("31/07/25 13:41", us(2025, 7, 31, 13, 41, tz="Europe/Berlin")),
    ("07.06.2026 05:15:28", us(2026, 6, 7, 5, 15, 28, tz="Europe/Berlin")),
    ("2025-04-18T22:28:56.364815487+00:00", us(2025, 4, 18, 22, 28, 56, 364815)),
    ("20260616T235937Z", us(2026, 6, 16, 23, 59, 37)),
    ("Fri, 15 May 2026 20:40:22 +0530", us(2026, 5, 15, 15, 10, 22)),
    ("Tue Mar 24 17:45:05 2026 +0530", us(2026, 3, 24, 12, 15, 5)),
    ("May 05, 2026 05:53:35", us(2026, 5, 5, 5, 53, 35, tz="Europe/Berlin")),
    ("29 May 2026 13:00:57", us(2026, 5, 29, 13, 0, 57, tz="Europe/Berlin")),
    ("2026-03-21 02:38:26 CET", us(2026, 3, 21, 1, 38, 26)),
    ("2026-06-02 22:15:52 Europe/London", us(2026, 6, 2, 22, 15, 52, tz="Europe/London")),
    ("2026-05-09", us(2026, 5, 9, tz="Europe/Berlin")),
    ("2025-10-26 02:30:00", us(2025, 10, 26, 0, 30)),  # the hour that occurs twice: its first pass
    ("2025-03-30 02:30:00", us(2025, 3, 30, 1, 30)),  # a skipped hour: the offset before the change
    ("2025-02-30 10:15:00", None), ("2025-13-04T08:00:00Z", None), ("0000-00-00T00:00:00Z", None), ("unknown", None), ("", None), ("  ", None), (None, None),
    ("13/13/2025 10:00:00", None), ("x" * 20000, None), ("2025-01-01 10:00:00 QQQ", None),
]


def test_forms(spark, clash):
    df = spark.createDataFrame([(k, "s", v, "Europe/Berlin", "DMY") for k, (v, _) in enumerate(CASES)], V)
    got = dict(rows(instants.choose(clash(df), "source", "row_id", ["row_id"]).select("row_id", "utc_us")))
    for k, (v, want) in enumerate(CASES):
        assert got.get(k) == want, (v, got.get(k), want)


def test_order_and_zone_of_the_source(spark):
    df = spark.createDataFrame([(1, "s", "03/04/2026 01:00:00 PM", "America/New_York", "MDY"), (2, "s", "03/04/2026 13:00:00", None, "DMY"), (3, "s", "03/04/2026 13:00:00", "No/Zone", "DMY")], V)
    got = dict(rows(instants.choose(df, "source", "row_id", ["row_id"]).select("row_id", "utc_us")))
    assert got == {1: us(2026, 3, 4, 13, tz="America/New_York"), 2: us(2026, 4, 3, 13), 3: us(2026, 4, 3, 13)}


def test_viterbi_reads_an_undeclared_source_by_its_order(spark):
    days = ["25/01/2026", "02/02/2026", "03/02/2026", "05/02/2026", "14/02/2026"]  # only day first never goes back
    df = spark.createDataFrame([(k, "s", d, "UTC", None) for k, d in enumerate(days)], V)
    got = [r[1] for r in rows(instants.choose(df, "source", "row_id", ["row_id"]).select("row_id", "utc_us"))]
    assert got == [us(2026, 1, 25), us(2026, 2, 2), us(2026, 2, 3), us(2026, 2, 5), us(2026, 2, 14)]


def test_the_path_overrides_the_cheapest_single_reading(spark):
    # at 02:50 and then 02:10 of the night the clock goes back; the first pass is the cheaper reading of either alone
    texts = ["2025-10-26 01:30:00", "2025-10-26 02:50:00", "2025-10-26 02:10:00", "2025-10-26 03:10:00"]
    df = spark.createDataFrame([(k, "s", v, "Europe/Berlin", "DMY") for k, v in enumerate(texts)], V)
    free = dict(rows(instants.choose(df, "source", "row_id", ["row_id"], second_pass=1.5).select("row_id", "utc_us")))
    held = dict(rows(instants.choose(df, "source", "row_id", ["row_id"]).select("row_id", "utc_us")))
    assert free[2] == us(2025, 10, 26, 1, 10) and free[1] == us(2025, 10, 26, 0, 50)
    assert held[2] == us(2025, 10, 26, 0, 10)  # a rule stands above the path


def test_every_reading_is_made_and_none_that_may_win_is_dropped(spark):
    texts = [("03/04/2026", "DMY"), ("03/04/2026", None), ("25/04/2026", "MDY"), ("1760152843", None)]
    df = spark.createDataFrame([(k, "s", v, "UTC", o) for k, (v, o) in enumerate(texts)], V)
    got = {r["row_id"]: [(c["fmt"], c["cost"]) for c in r["cands"]] for r in instants.candidates(df).collect()}
    assert got[0] == [("dmy", 0.0), ("mdy", instants.AGAINST)] and got[1] == [("dmy", 0.0), ("mdy", 0.0)]
    assert got[2] == [("dmy", instants.AGAINST)] and [c for _, c in got[3]] == [0.0] + [instants.AGAINST] * 3
    assert instants.AGAINST > instants.GAIN


def test_a_long_ambiguous_run_spans_batches(spark):
    days = [f"{1 + k // 40 % 12:02d}/{1 + k // 500:02d}/2026" for k in range(2000)]  # ambiguous throughout
    df = spark.createDataFrame([(k, "s", d, "UTC", None) for k, d in enumerate(days)], V)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = [r[1] for r in sorted(instants.choose(df, "source", "row_id", ["row_id"]).select("row_id", "utc_us").collect())]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 2000
    assert sum(b < a for a, b in zip(got, got[1:])) <= 4


def test_undeclared_estates_are_read_along_their_loads(spark):
    from datetime import datetime as T

    taken = ["28/12/2025", "01/01/2026", "02/01/2026", "05/01/2026", "09/01/2026", "14/01/2026"]
    sn = spark.createDataFrame([(9 - k, "e", t, T(2026, 1, 1 + k)) for k, t in enumerate(taken)], "snapshot_id bigint, estate string, taken_at string, loaded_at timestamp_ntz")
    es = spark.createDataFrame([("e", "UTC", "DMY")], "estate string, tz string, date_order string")
    assert rows(instants.undeclared(sn, es)) == [("e", 6, 3, 3)]


def best(seq):
    """The least cost over all paths."""
    def cost(path):
        c = sum(x["cost"] for x in path)
        for p, q in zip(path, path[1:]):
            c += instants.SWITCH * (p["fmt"] != q["fmt"]) + instants.BACKWARD * (q["utc_us"] < p["utc_us"])
        return c
    return min(cost(p) for p in itertools.product(*seq))


@pytest.mark.parametrize("seed", range(3))
def test_blocks_give_the_global_optimum(spark, seed):
    rnd = random.Random(seed)
    data, n = [], 0
    for s in ("p", "q", "r"):
        for _ in range(rnd.randint(1, 9)):
            n += 1
            data.append((n, s, f"{rnd.randint(1, 28 if rnd.random() < .3 else 12):02d}/{rnd.randint(1, 12):02d}/2026", "UTC", None))
    df = spark.createDataFrame(data, V).repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = dict(rows(instants.choose(df, "source", "row_id", ["row_id"]).select("row_id", "utc_us")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    cands = {r["row_id"]: [c.asDict() for c in r["cands"]] for r in instants.candidates(df).collect()}
    for s in ("p", "q", "r"):
        seq = [cands[k] for k, x, *_ in data if x == s and cands[k]]
        if not seq:
            continue
        # readings of one instant in two formats leave the format open
        picked = [[c for c in cands[k] if c["utc_us"] == got[k]] for k, x, *_ in data if x == s and cands[k]]
        assert best(picked) == pytest.approx(best(seq))


def test_empty(spark):
    assert instants.choose(spark.createDataFrame([], V), "source", "row_id", ["row_id"]).count() == 0


def test_found_leaves_out_what_is_canonical(spark):
    fm = spark.createDataFrame([(1, "r", "2026-05-09T10:00:00Z", "2026-05-09"), (1, "r", "2026-05-09T10:00:00Z", "2026-05-09"), (2, None, None, "-")], "metric_id bigint, repo string, first_change string, last_change string")
    sn = spark.createDataFrame([(7, "e", "1736022998", None)], "snapshot_id bigint, estate string, taken_at string, loaded_at timestamp_ntz")
    z = spark.createDataFrame([("r", "Asia/Tokyo", "DMY")], "repo string, tz string, date_order string")
    es = spark.createDataFrame([], "estate string, tz string, date_order string")
    assert rows(instants.found(fm, sn, z, es)) == [("file_metrics", 1, "last_change", us(2026, 5, 9, tz="Asia/Tokyo")), ("snapshot", 7, "taken_at", 1736022998000000)]
