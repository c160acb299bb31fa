"""Queries of the general problems (p2, p3, p4) over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.operators import instants, orphans, snapshots
from terrane.session import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    got = orphans.orphan_cascade(table(spark, sf, "edges"), table(spark, sf, "nodes"))
    return got.where("origin = 'direct'").select("edge_id", "end_name")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    got = orphans.orphan_cascade(table(spark, sf, "edges"), table(spark, sf, "nodes"), orphans.CONTAINS, references=True)
    return orphans.orphan_report(got)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.snapshot_changes(*(table(spark, sf, t) for t in ("snapshot", "estates")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return instants.found(*(table(spark, sf, t) for t in ("file_metrics", "snapshot", "repos", "estates")))


def p4_undeclared(spark: SparkSession, sf: str) -> DataFrame:
    """How often the path alone finds the order of day and month of an estate that declares none."""
    return instants.undeclared(*(table(spark, sf, t) for t in ("snapshot", "estates")))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p4_found, p4_undeclared)}

#: Fixed by the problem: an end is a case if no delivery of its id is valid at the edge's load.
P2_SQL = r"""
WITH v AS (SELECT trim(id, E' \\t\\n\\r') AS k, loaded_at AS a, coalesce(deleted_at, TIMESTAMP '9999-12-31') AS b FROM nodes),
e AS (SELECT id AS edge_id, 'src' AS end_name, trim(src, E' \\t\\n\\r') AS k, loaded_at AS t FROM edges UNION ALL SELECT id, 'dst', trim(dst, E' \\t\\n\\r'), loaded_at FROM edges)
SELECT DISTINCT edge_id, end_name FROM e WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM v WHERE v.k = e.k AND e.t >= v.a AND e.t < v.b)
"""
#: The cascade: ``lost`` are the records left without a parent, whatever their depth.
REPORT_SQL = P2_SQL[: P2_SQL.index("e AS (SELECT id AS edge_id")].replace("WITH v", "WITH RECURSIVE v") + r"""
g AS (SELECT id, trim(src, E' \\t\\n\\r') AS src, trim(dst, E' \\t\\n\\r') AS dst, coalesce(kind, '') AS kind, loaded_at AS t FROM edges),
ends AS (SELECT id AS edge_id, 'src' AS end_name, src AS k, t, kind FROM g UNION ALL SELECT id, 'dst', dst, t, kind FROM g),
direct AS (SELECT edge_id, end_name, min(k) AS k, min(t) AS t FROM ends WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM v WHERE v.k = ends.k AND (ends.t IS NULL OR (ends.t >= v.a AND ends.t < v.b))) GROUP BY 1, 2),
gone AS (SELECT edge_id FROM direct WHERE end_name = 'src'), links AS (SELECT * FROM g WHERE kind IN ('defines', 'exposes', 'defines-table') AND src <> '' AND dst <> '' AND src <> dst),
lost AS (SELECT dst AS id FROM links WHERE id IN (FROM gone) UNION SELECT l.dst FROM links l JOIN lost ON l.src = lost.id),
inherited AS (SELECT id AS edge_id, 'src' AS end_name, min(src) AS k, min(t) AS t FROM links WHERE src IN (FROM lost) AND id NOT IN (FROM gone) GROUP BY 1
  UNION ALL SELECT edge_id, end_name, min(k), min(t) FROM ends WHERE kind NOT IN ('defines', 'exposes', 'defines-table') AND k IN (FROM lost) AND (edge_id, end_name) NOT IN (SELECT (edge_id, end_name) FROM direct) GROUP BY 1, 2),
orphans AS (SELECT *, 'direct' AS origin FROM direct UNION ALL SELECT *, 'inherited' FROM inherited)
SELECT 'edges' AS table_name, end_name, strftime(t, '%Y-%m') AS month, origin, count(*) AS n, count(DISTINCT k) AS ids FROM orphans GROUP BY end_name, month, origin
"""
ORACLE: dict[str, str] = {"p2_found": P2_SQL.replace("\\\\", "\\"), "p2_report": REPORT_SQL.replace("\\\\", "\\")}
