"""References to records that do not exist: direct orphans by interval anti-join, inherited ones by a fixpoint cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import strip
from terrane.session import cut, hot_keys

FOREVER = "9999-12-31 00:00:00"
#: Kinds of edges whose src is the parent of their dst, which exists only in it: files and their symbols, services and
#: their routes and tables. An orphaned src leaves the dst orphaned. Edges of all other kinds refer to both ends and pass nothing on.
CONTAINS = ("defines", "exposes", "defines-table")


def validity(nodes: DataFrame, id_col: str = "id", from_col: str = "loaded_at", to_col: str = "deleted_at") -> DataFrame:
    """(key, since, until) of each delivery of a record; one row per key and start, so redeliveries collapse map-side."""
    return (
        nodes.select(
            strip(id_col).alias("key"),
            F.col(from_col).alias("since"),
            F.coalesce(F.col(to_col), F.lit(FOREVER).cast("timestamp_ntz")).alias("until"),
        )
        .where("key <> '' AND since IS NOT NULL AND since < until")
        .groupBy("key", "since")
        .agg(F.max("until").alias("until"))
    )


def reference_ends(edges: DataFrame, id_col: str = "id", ends: Sequence[str] = ("src", "dst"), at_col: str = "loaded_at") -> DataFrame:
    """(edge_id, end_name, key, at): one row per end that is neither null nor blank. The scan reads four columns."""
    return (
        edges.select(
            F.col(id_col).alias("edge_id"),
            F.col(at_col).alias("at"),
            F.inline(F.array(*[F.struct(F.lit(e).alias("end_name"), strip(e).alias("key")) for e in ends])),
        )
        .where("key <> ''")
    )


def _salted(ends: DataFrame, facts: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """Both with a column ``part``: ends of hot keys spread over ``salt`` parts, the facts on these keys repeated to match."""
    hot = hot_keys(ends, "key")
    if not hot:
        return ends.withColumn("part", F.lit(0)), facts.withColumn("part", F.lit(0))
    spread = F.when(F.col("key").isin(hot), F.pmod(F.xxhash64("edge_id", "end_name"), F.lit(salt)).cast("int")).otherwise(0)
    copies = F.when(F.col("key").isin(hot), F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0)))
    return ends.withColumn("part", spread), facts.withColumn("part", F.explode(copies))


def direct_orphans(edges: DataFrame, nodes: DataFrame, salt: int = 16, **cols) -> DataFrame:
    """Ends for which no record with that id is valid when the edge is loaded: (edge_id, end_name, key, at).

    A hot id is found by a bounded sketch and spread over ``salt`` parts; its few validity rows are repeated to match.
    An edge without a load time can't be placed in time: its end is an orphan only if no record ever had the id.
    """
    ends = reference_ends(edges, **cols)
    alive = validity(nodes)
    ends, alive = _salted(ends, alive, salt)
    e, a = ends.alias("e"), alive.alias("a")
    holds = (
        (F.col("e.key") == F.col("a.key"))
        & (F.col("e.part") == F.col("a.part"))
        & (F.col("e.at").isNull() | ((F.col("e.at") >= F.col("a.since")) & (F.col("e.at") < F.col("a.until"))))
    )
    return e.join(a, holds, "left_anti").select("edge_id", "end_name", "key", "at")


def orphan_cascade(
    edges: DataFrame,
    nodes: DataFrame,
    child_kinds: Sequence[str] = ("defines",),
    references: bool = False,
    salt: int = 16,
) -> DataFrame:
    """All orphan ends as (edge_id, end_name, key, at, origin, depth).

    Depth 0 (``direct``): no valid record has the id. Then, to a fixpoint: an edge of a containment kind whose src is an
    orphan leaves its dst without a parent, so every containment edge that names that dst as its src is orphaned
    too (``inherited``), and so on down the foreign-key graph. Each round is a semi-join of the containment edges with
    the newly orphaned ids, until one finds no rows; rows once found leave by anti-join, so cycles end.

    With ``references``, each end of an edge of any other kind that names a record orphaned so is ``inherited`` too; depth
    is then that of the containment edges that start at the record. Such an edge orphans nothing else.

    Null or blank ends are no references. Rows that differ only in payload, and redeliveries, give one row per
    (edge_id, end_name). Empty tables give an empty result. Extra columns are never read.
    """
    direct = cut(
        direct_orphans(edges, nodes).groupBy("edge_id", "end_name").agg(F.first("key").alias("key"), F.min("at").alias("at"))
    ).withColumns({"origin": F.lit("direct"), "depth": F.lit(0)})
    links = (
        edges.where(F.col("kind").isin(*child_kinds))
        .select(F.col("id").alias("edge_id"), strip("src").alias("src"), strip("dst").alias("dst"), F.col("loaded_at").alias("at"))
        .where("src <> '' AND dst <> '' AND src <> dst")
    )
    done = direct
    seen = direct.where("end_name = 'src'").select("edge_id")
    lost = links.join(seen, "edge_id", "left_semi").select(F.col("dst").alias("id")).distinct()
    known = lost.withColumn("depth", F.lit(1))
    depth = 0
    while True:
        depth += 1
        step = cut(
            links.join(lost, links["src"] == lost["id"], "left_semi")
            .join(seen, "edge_id", "left_anti")
            .groupBy("edge_id").agg(F.first("src").alias("src"), F.first("dst").alias("dst"), F.min("at").alias("at"))
        )
        if step.isEmpty():
            break
        done = done.unionByName(
            step.select("edge_id", F.lit("src").alias("end_name"), F.col("src").alias("key"), "at", F.lit("inherited").alias("origin"), F.lit(depth).alias("depth"))
        )
        seen = seen.unionByName(step.select("edge_id"))
        lost = step.select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti")
        known = known.unionByName(lost.withColumn("depth", F.lit(depth + 1)))
        if depth % 8 == 0:  # keeps the plan short on deep chains
            done, seen, lost, known = cut(done), cut(seen), cut(lost), cut(known)
    if not references:
        return done
    ends, orphaned = _salted(reference_ends(edges.where(~F.coalesce("kind", F.lit("")).isin(*child_kinds))), cut(known).withColumnRenamed("id", "key"), salt)
    named = (
        ends.join(orphaned, ["key", "part"]).join(direct, ["edge_id", "end_name"], "left_anti")
        .groupBy("edge_id", "end_name").agg(F.first("key").alias("key"), F.min("at").alias("at"), F.min("depth").alias("depth"))
    )
    return done.unionByName(named.withColumn("origin", F.lit("inherited")))


def orphan_report(orphans: DataFrame, table_name: str = "edges") -> DataFrame:
    """Orphan ends per table, end, month of load, and origin."""
    return (
        orphans.groupBy(
            F.lit(table_name).alias("table_name"), "end_name", F.date_format("at", "yyyy-MM").alias("month"), "origin"
        )
        .agg(F.count("*").alias("n"), F.countDistinct("key").alias("ids"))
    )
