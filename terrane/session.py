"""Session, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings nodes edges file_metrics "
    "ownership commits coupling snapshot repos file_heads estates eval_items mix_targets size_limits"
).split()


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terrane")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "terrane-warehouse"))
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once per application, as a zip in the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(str(p.relative_to(root.parent)), p.read_bytes())
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/terrane-{uuid.uuid4().hex}.zip")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(target.toString())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + os.path.join(tempfile.gettempdir(), "terrane-shared")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cuts lineage with a table written to the shared folder: smaller than a checkpoint, and read by column. Keeps no order and no partitions."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """While it lasts, expressions too long for the JVM's compiler are split instead of fused into one method that it only interprets."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def stamp(spark: SparkSession, path: str) -> tuple:
    """(path, time of change, bytes) of a file or folder: tells one state of a table from the next."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return path, fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()


def hot_keys(df: DataFrame, key: str, share: float = 0.01, slots: int = 512) -> list[str]:
    """Keys that may hold more than ``share`` of the rows: one pass with a frequent-items sketch.

    The result has at most 1/share keys, whatever the input; it steers salting only, never results.
    """
    row = df.agg(
        F.count(key).alias("n"), F.expr(f"approx_top_k(`{key}`, {min(int(1 / share), slots)}, {slots})").alias("top")
    ).first()
    return [x["item"] for x in row["top"] or [] if x["item"] is not None and x["count"] > share * row["n"]]
