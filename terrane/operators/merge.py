"""Write algebra: deliveries of nodes and edges merged by key, so that appends stay idempotent and replay-safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.text import strip

LATEST = ("name", "container", "file", "line", "repo", "lang", "service", "extra")


def latest(col: str, at: str = "loaded_at") -> Column:
    """The latest non-null value; of several at one time the greatest. Combines map-side."""
    return F.max(F.when(F.col(col).isNotNull(), F.struct(F.col(at), F.col(col))))[col].alias(col)


def earliest(col: str, *at: str) -> Column:
    return F.min(F.struct(*[F.col(a) for a in at or ("loaded_at",)], F.col(col)))[col].alias(col)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: kind and source of the first delivery, every other field the latest non-null; live if not removed.

    An ``extra`` of ``{}`` counts as null. Blank and null ids are dropped.
    """
    rows = nodes.withColumn("id", strip("id")).where("id <> ''").withColumn("extra", F.when(F.trim("extra") != "{}", F.col("extra")))
    return rows.groupBy("id").agg(earliest("kind"), earliest("source"), *[latest(c) for c in LATEST], F.bool_or(F.col("deleted_at").isNull()).alias("live"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, kind, evidence or ''): weights added, highest confidence, EXTRACTED if any delivery is.

    Redelivered rows (same id) count once; source and extra stay those of the first. Self-loops and rows with a blank end or kind are
    dropped; null provenance, confidence and weight are INFERRED, 0.5 and 1.
    """
    once = edges.select(
        "id", strip("src").alias("src"), strip("dst").alias("dst"), "kind", F.coalesce("evidence", F.lit("")).alias("evidence"),
        F.coalesce("provenance", F.lit("INFERRED")).alias("provenance"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("weight", F.lit(1.0)).alias("weight"), "source", "extra", "loaded_at",
    ).where("src <> '' AND dst <> '' AND kind <> '' AND src <> dst")
    # the redelivery rule needs no shuffle of its own: rows of one id share the edge key, so both fold in one exchange
    per_id = once.groupBy("src", "dst", "kind", "evidence", "id").agg(
        F.max("provenance").alias("p_max"), F.min("provenance").alias("provenance"), F.max("confidence").alias("confidence"), F.max("weight").alias("weight"),
        F.min("loaded_at").alias("loaded_at"), F.min("source").alias("source"), F.min("extra").alias("extra"),
    )
    return per_id.groupBy("src", "dst", "kind", "evidence").agg(
        F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"),
        F.when(F.bool_or(F.col("provenance") == "EXTRACTED"), "EXTRACTED").otherwise("INFERRED").alias("provenance"),
        earliest("source", "loaded_at", "id"), earliest("extra", "loaded_at", "id"),
    )


def upsert_coupling(coupling: DataFrame) -> DataFrame:
    """One row per unordered pair, a < b; of repeated deliveries the strongest holds, ends swapped with their own figures."""
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    rows = coupling.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("a_repo", "b_repo").alias("a_repo"), pick("b_repo", "a_repo").alias("b_repo"),
        "shared", pick("a_revs", "b_revs").alias("a_revs"), pick("b_revs", "a_revs").alias("b_revs"), "degree", "cross_repo",
    )
    w = Window.partitionBy("a", "b").orderBy(F.col("shared").desc_nulls_last(), F.col("degree").desc_nulls_last(), F.col("a_revs").desc_nulls_last(), F.col("b_revs").desc_nulls_last())
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def reconcile_libraries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the ends of a service that only doubles a library of the same name moved to the library, then merged again."""
    lib = nodes.where("kind = 'library'").groupBy("name").agg(F.min("id").alias("to"))
    move = nodes.where("kind = 'service'").join(lib, "name").select(F.col("id").alias("from"), "to")
    at = lambda end: move.select(F.col("from").alias(end), F.col("to").alias(f"{end}_to"))
    moved = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    moved = moved.withColumns({"src": F.coalesce("src_to", "src"), "dst": F.coalesce("dst_to", "dst")}).where("src <> dst")
    return moved.groupBy("src", "dst", "kind", "evidence").agg(
        F.sum("weight").alias("weight"), F.max("confidence").alias("confidence"),
        F.when(F.bool_or(F.col("provenance") == "EXTRACTED"), "EXTRACTED").otherwise("INFERRED").alias("provenance"),
    )


def reconcile_containers(nodes: DataFrame, edges: DataFrame, containers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, gaps) without the services named in ``containers`` (name): directories, not services."""
    gone = nodes.where("kind = 'service'").join(containers, "name", "left_semi").select("id", "name")
    kept = nodes.join(gone, "id", "left_anti")
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    gaps = gone.select(F.lit("container-directory").alias("category"), F.col("name").alias("detail"))
    return kept, left, gaps


def cache_changes(cached: DataFrame, current: DataFrame) -> DataFrame:
    """(key, hash, action): what an incremental parse must do: ``parse`` new or changed contents, ``prune`` vanished keys."""
    c, n = cached.select("key", F.col("hash").alias("was")), current.select("key", "hash")
    return (
        n.join(c, "key", "full")
        .withColumn("action", F.when(F.col("hash").isNull(), "prune").when(F.col("was").isNull() | (F.col("was") != F.col("hash")), "parse").otherwise("keep"))
        .select("key", F.coalesce("hash", "was").alias("hash"), "action")
    )


def upsert_ranks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, id, rank): the kinds of ``new`` replace their old rows whole, all others stay; keyed by kind and id, so kinds don't overwrite each other."""
    kept = old.join(new.select("kind").distinct(), "kind", "left_anti").select("kind", "id", "rank")
    return kept.unionByName(new.groupBy("kind", "id").agg(F.max("rank").alias("rank")))
