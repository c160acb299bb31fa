"""What changed between full snapshots: content-defined chunks of key-sorted snapshots, digests first, rows after.

A snapshot is parsed, sorted and chunked inside its own row, so nothing but chunk digests is shuffled to find the chunks that differ;
then the rows of those chunks alone are read again and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.text import strip
from terrane.operators import instants
from terrane.session import cut

#: A key whose hash has this many zero bits starts a chunk, so a chunk has 16 keys on average wherever it lies.
CHUNK_MASK = 15
#: So many rows of (record, digest), some 100 bytes each, may be broadcast; more of them meet the chunks by a shuffle.
MOST_SENT = 200_000
KINDS = ("service", "route")
ID = ["estate", "snapshot_id", "record_type"]


def route_key(path: Column) -> Column:
    """A path with every parameter as {} and no slash at the end."""
    p = F.regexp_replace(path, r"/(?:\{[^/]*\}|<[^/]*>|:[^/]*)(?=/|$)", "/{}")
    return F.regexp_replace(p, r"/+$", "")


def _entries(kind: str) -> Column:
    """The sorted (key, val) of a snapshot's array; val is the sorted set of methods, empty for services. Null for a null array."""
    if kind == "service":
        names = F.array_sort(F.array_distinct(F.filter(F.transform("services", strip), lambda r: r != "")))
        return F.transform(names, lambda r: F.struct(r.alias("key"), F.lit("").alias("val")))
    shape = r"^(\S+)\s+(\S+)\s+(\S.*)$"
    read = F.transform(F.filter(F.transform("routes", strip), lambda r: r.rlike(shape)), lambda r: F.struct(
        F.concat_ws(" ", F.regexp_extract(r, shape, 1), route_key(F.regexp_extract(r, shape, 3))).alias("key"), F.upper(F.regexp_extract(r, shape, 2)).alias("val")
    ))
    return F.array_sort(F.array_distinct(read))


def _grouped(e: Column) -> Column:
    """Sorted distinct (key, val) with the vals of a key joined, by slices between the places where the key changes."""
    starts = F.when(F.size(e) > 0, F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.element_at(e, i + 1)["key"] != F.element_at(e, F.greatest(i, F.lit(1)))["key"]))).otherwise(F.array().cast("array<int>"))
    return starts, lambda s: F.transform(s, lambda x, i: F.struct(
        F.element_at(e, x + 1)["key"].alias("key"),
        F.array_join(F.transform(F.slice(e, x + 1, F.coalesce(F.try_element_at(s, i + 2), F.size(e)) - x), lambda y: y["val"]), ",").alias("val"),
    ))


def entries(snapshot: DataFrame) -> DataFrame:
    """(estate, snapshot_id, record_type, loaded_at, entries): one row per delivered array, in place."""
    made = snapshot.where("estate IS NOT NULL").select("estate", "snapshot_id", "loaded_at", _entries("service").alias("_s"), _entries("route").alias("_r"))
    starts, join = _grouped(F.col("_r"))
    made = made.withColumn("_at", F.when(F.col("_r").isNotNull(), starts)).withColumn("_g", F.when(F.col("_r").isNotNull(), join(F.col("_at"))))
    both = F.array(F.struct(F.lit("service").alias("record_type"), F.col("_s").alias("entries")), F.struct(F.lit("route").alias("record_type"), F.col("_g").alias("entries")))
    return made.select("estate", "snapshot_id", "loaded_at", F.inline(both)).where("entries IS NOT NULL")


def chunked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``entries`` replaced by chunks: array of (digest, items).

    A chunk starts at the first entry and at every key whose hash ends in zeros, so an insertion moves no other cut.
    """
    e = F.col("entries")
    starts = F.when(F.size(e) > 0, F.filter(
        F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (F.xxhash64(F.element_at(e, i + 1)["key"]).bitwiseAND(F.lit(CHUNK_MASK)) == 0)
    )).otherwise(F.array().cast("array<int>"))
    items = F.transform("_from", lambda s, i: F.slice(e, s + 1, F.coalesce(F.try_element_at("_from", i + 2), F.size(e)) - s))
    out = rows.withColumn("_from", starts).withColumn("_items", items)
    made = F.transform("_items", lambda x: F.struct(F.substring(F.sha2(F.to_json(x), 256), 1, 20).alias("digest"), x.alias("items")))
    return out.withColumn("chunks", made).drop("_from", "_items", "entries")


def ranked(rows: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 1 within ``part`` by ``order``, a hot part being numbered by many tasks.

    Range partitions are sorted and numbered each for itself; the counts of a part in the partitions before are added. These
    counts are at most two rows a partition beyond one row a part.
    """
    keys = [*part, *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = cut(placed.withColumn("_pid", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    per = local.groupBy(*part, "_pid").agg(F.count("*").alias("_n"), F.min("_i").alias("_least"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = per.withColumn("_before", before).drop("_n")
    return local.join(shift, [*part, "_pid"]).withColumn("rank", F.col("_i") - F.col("_least") + F.col("_before") + 1).drop("_pid", "_i", "_least", "_before")


def differing(skeleton: DataFrame) -> DataFrame:
    """(estate, snapshot_id, record_type, loaded_at, digest, side, later) of the chunks of neighbouring snapshots that the other has not.

    skeleton is (estate, snapshot_id, record_type, loaded_at, rank, digests). side is 1 for the later snapshot, -1 for the earlier;
    ``later`` is the later one's snapshot_id. Only digests meet here, no records.
    """
    part = ["estate", "record_type"]
    a = skeleton.select(*part, "rank", F.col("snapshot_id").alias("later"), F.col("loaded_at").alias("a_at"), F.col("digests").alias("a"))
    b = skeleton.select(*part, (F.col("rank") + 1).alias("rank"), F.col("snapshot_id").alias("earlier"), F.col("loaded_at").alias("b_at"), F.col("digests").alias("b"))
    met = a.join(b, [*part, "rank"])
    sides = F.array(
        F.struct(F.col("later").alias("snapshot_id"), F.col("a_at").alias("loaded_at"), F.lit(1).alias("side"), F.array_except("a", "b").alias("digests")),
        F.struct(F.col("earlier").alias("snapshot_id"), F.col("b_at").alias("loaded_at"), F.lit(-1).alias("side"), F.array_except("b", "a").alias("digests")),
    )
    return met.select(*part, "later", F.inline(sides)).select("estate", "snapshot_id", "record_type", "loaded_at", F.explode("digests").alias("digest"), "side", "later")


def snapshot_changes(snapshot: DataFrame, estates: DataFrame) -> DataFrame:
    """p3_found: changes of services and routes between consecutive snapshots of an estate.

    Snapshots are ordered by the instant of taken_at; equal instants by loaded_at, then snapshot_id. A snapshot whose
    taken_at denotes no instant, or without an estate, has no place and is left out. A null array was not delivered: the next one
    compares with the one before it. An empty array means none. Of several deliveries of one snapshot the last with the array holds;
    deliveries of one time count once.
    """
    zone = estates.groupBy("estate").agg(F.min("tz").alias("tz"), F.min("date_order").alias("date_order"))
    stamped = (
        snapshot.where("estate IS NOT NULL").groupBy("snapshot_id", "estate", F.col("taken_at").alias("value"))
        .agg(F.min("loaded_at").alias("loaded_at"), F.min(instants.loaded()).alias("at")).join(zone, "estate", "left")
    )
    at = instants.choose(stamped, "estate", "at", ["estate", "snapshot_id", "loaded_at"]).where(F.col("cost") < instants.AGAINST)
    at = at.groupBy("estate", "snapshot_id").agg(F.min("utc_us").alias("utc_us"), F.min("loaded_at").alias("since"))
    chunks = chunked(entries(snapshot))
    time = F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    slim = chunks.select(*ID, time.alias("loaded_at"), F.transform("chunks", lambda x: x["digest"]).alias("digests"))
    held = slim.groupBy(*ID).agg(F.max_by(F.struct("loaded_at", "digests"), F.struct("loaded_at", F.hash("digests"))).alias("x")).select(*ID, "x.*")
    skeleton = ranked(held.join(at, ["estate", "snapshot_id"]), ["estate", "record_type"], ["utc_us", "since", "snapshot_id"])
    need = cut(differing(skeleton))
    wanted = need.select(*ID, "loaded_at", "digest").distinct()
    if need.count() <= MOST_SENT:
        wanted = F.broadcast(wanted)
    rows = chunks.select(*ID, time.alias("loaded_at"), F.inline("chunks")).join(wanted, [*ID, "loaded_at", "digest"], "left_semi")
    once = rows.groupBy(*ID, "loaded_at", "digest").agg(F.first("items").alias("items"))
    keyed = need.join(once, [*ID, "loaded_at", "digest"]).select("estate", "later", "record_type", "side", F.inline("items"))
    both = keyed.groupBy("estate", "later", "record_type", "key").agg(
        F.max(F.when(F.col("side") > 0, F.col("val"))).alias("new"), F.max(F.when(F.col("side") < 0, F.col("val"))).alias("old")
    )
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") != F.col("old"), "changed")
    return both.withColumn("change_type", change).where("change_type IS NOT NULL").select("estate", F.col("later").alias("snapshot_id"), "record_type", F.col("key").alias("record_key"), "change_type")
