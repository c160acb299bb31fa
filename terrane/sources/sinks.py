"""Sinks: partition overwrite by source, JSON export, snapshots with retention, Mermaid, Markdown and HTML over small results."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_source(df: DataFrame, path: str) -> None:
    """Writes rows partitioned by ``source``, replacing only the sources they hold; other contributions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def export_json(df: DataFrame, path: str, most: int = 20_000, force: bool = False) -> bool:
    """Writes JSON lines unless there are more than ``most`` rows; tells whether it did."""
    if not force and df.limit(most + 1).count() > most:
        return False
    df.write.mode("overwrite").json(path)
    return True


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_snapshot(df: DataFrame, root: str, taken_at: str, keep: int = 30) -> None:
    """Writes one snapshot directory and removes all but the newest ``keep``."""
    spark = df.sparkSession
    df.write.mode("overwrite").json(f"{root}/taken_at={taken_at.replace(':', '')}")
    fs, p = _fs(spark, root)
    dirs = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory())
    for d in dirs[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(d), True)


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.json(root)


def mermaid(pairs: DataFrame, most: int = 120) -> str:
    """A flow chart of (source, target, count) arrows, the heaviest ``most``."""
    rows = pairs.orderBy(F.col("count").desc(), "source", "target").limit(most).collect()
    ids = {n: f"n{i}" for i, n in enumerate(dict.fromkeys(x for r in rows for x in (r["source"], r["target"])))}
    lines = ["graph LR", *(f'  {v}["{k.replace(chr(34), chr(39))}"]' for k, v in ids.items()), *(f"  {ids[r['source']]} -->|{r['count']}| {ids[r['target']]}" for r in rows)]
    return "\n".join(lines)


def sequence(steps: DataFrame) -> str:
    """A sequence diagram of (src, dst, label) steps in order of ``step``."""
    rows = steps.orderBy("step").limit(500).collect()
    return "\n".join(["sequenceDiagram", *(f"  {r['src']}->>{r['dst']}: {r['label']}" for r in rows)])


def markdown(sections: dict[str, DataFrame], most: int = 50) -> str:
    """A report with one table per section, each of at most ``most`` rows."""
    out = []
    for title, df in sections.items():
        rows = df.limit(most).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)


def html_graph(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, most: int = 1200) -> str:
    """A page with the ``most`` best-ranked nodes that are no libraries and the edges among them."""
    top = nodes.where("kind <> 'library'").join(ranks, "id").orderBy(F.col("rank").desc(), "id").limit(most).select("id", "name", "kind")
    ends = top.select("id")
    inner = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind").distinct()
    data = {"nodes": [r.asDict() for r in top.collect()], "edges": [r.asDict() for r in inner.limit(20 * most).collect()]}
    return f"<!doctype html><meta charset=utf-8><title>Estate</title><script type='application/json' id=graph>{html.escape(json.dumps(data), quote=False)}</script>"


def write_acks(acks: DataFrame) -> str:
    """The text of an acknowledgement file, sorted by key."""
    return "".join(f"{r['key']}: {r['reason']}\n" for r in acks.orderBy("key").toLocalIterator())
