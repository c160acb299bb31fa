"""Exported call traces: Prometheus text, dependency JSON, CSV; one DataFrame (client, server, calls, errors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names under which exports give the two ends, in order of preference.
CLIENT = ("client", "source", "src", "parent", "caller", "from", "client_service", "source_service")
SERVER = ("server", "target", "dst", "child", "callee", "to", "server_service", "target_service", "destination_service")
CALLS = ("calls", "callCount", "call_count", "count", "value")
ERRORS = ("errors", "errorCount", "error_count", "failed")


def _first(cols: list[str], names: tuple[str, ...]):
    low = {c.lower(): c for c in cols}
    there = [F.nullif(F.trim(F.col(low[n.lower()]).cast("string")), F.lit("")) for n in names if n.lower() in low]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def prometheus(lines: DataFrame) -> DataFrame:
    """From (value) lines: service-graph metrics with both labels, failures as errors. Other lines give nothing."""
    shape = r"^([a-zA-Z_:][A-Za-z0-9_:]*)\{([^}]*)\}\s+([0-9.eE+-]+)\s*$"
    p = lines.select(F.lower(F.regexp_extract("value", shape, 1)).alias("metric"), F.regexp_extract("value", shape, 2).alias("labels"), F.regexp_extract("value", shape, 3).try_cast("double").alias("v"))
    label = lambda names: F.coalesce(*[F.nullif(F.regexp_extract("labels", rf'(?:^|,)\s*{n}\s*=\s*"([^"]*)"', 1), F.lit("")) for n in names])
    rows = p.where(F.col("metric").rlike("service_?graph") & F.col("v").isNotNull()).withColumns({"client": label(CLIENT), "server": label(SERVER)})
    bad = F.col("metric").rlike("failed|error")
    counts = F.col("metric").rlike("(_total|_count)$|request") & ~bad
    return rows.select("client", "server", F.when(counts, F.col("v")).otherwise(0.0).alias("calls"), F.when(bad, F.col("v")).otherwise(0.0).alias("errors")).where("client IS NOT NULL AND server IS NOT NULL")


def table_rows(rows: DataFrame) -> DataFrame:
    """From a table whose columns have any of the known names; without a count each row is one call."""
    c = rows.columns
    out = rows.select(_first(c, CLIENT).alias("client"), _first(c, SERVER).alias("server"), F.coalesce(_first(c, CALLS).try_cast("double"), F.lit(1.0)).alias("calls"), F.coalesce(_first(c, ERRORS).try_cast("double"), F.lit(0.0)).alias("errors"))
    return out.where("client IS NOT NULL AND server IS NOT NULL")


def read(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """``form`` is json, prom or csv; else told by the first sign of the text."""
    if form is None:
        head = spark.read.text(path).where("trim(value) <> ''").first()
        first = (head["value"].strip() if head else "")[:1]
        form = "json" if first in "[{" and first else "prom" if head and "{" in head["value"] or first == "#" else "csv"
    if form == "json":
        rows = spark.read.json(path, multiLine=True)
        for wrap in ("data", "dependencies", "links", "edges", "result"):
            if wrap in rows.columns and rows.schema[wrap].dataType.typeName() == "array":
                rows = rows.select(F.inline(wrap))
                break
        return table_rows(rows)
    if form == "prom":
        return prometheus(spark.read.text(path))
    return table_rows(spark.read.csv(path, header=True))


def merge(calls: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(client, server, calls, errors, error_rate): names resolved by ``aliases`` (token, service) first, then added up; no self-calls."""
    if aliases is not None:
        for end in ("client", "server"):
            a = aliases.select(F.col("token").alias(end), F.col("service").alias("_to"))
            calls = calls.join(a, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    got = calls.where("client <> server").groupBy("client", "server").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))
    return got.withColumn("error_rate", F.round(F.coalesce(F.try_divide("errors", "calls"), F.lit(0.0)), 4))
