"""Emission: what each extractor writes, as append-only sightings of nodes and edges that ``merge`` folds into the graph.

Every function takes FILE rows (unit, path, lang, bytes, text) and returns edges (src, dst, kind, evidence, provenance,
confidence, weight, source) or nodes (id, kind, name, container, file, line, repo, lang, service, source). Contributions stay
separable by ``source``, so one extractor can be run again alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import code
from terrane.model import ids
from terrane.operators import estate, resolve, views
from terrane.sources import files as readers


def _nodes(df: DataFrame, source: str, **cols: Column) -> DataFrame:
    names = ("id", "kind", "name", "container", "file", "line", "repo", "lang", "service")
    return df.select(*[cols.get(c, F.lit(None)).cast("int" if c == "line" else "string").alias(c) for c in names], F.lit(source).alias("source")).distinct()


def _edges(df: DataFrame, source: str, src: Column, dst: Column, kind, evidence: Column, confidence: float, provenance: str = "EXTRACTED") -> DataFrame:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(src.alias("src"), dst.alias("dst"), k.alias("kind"), evidence.alias("evidence"), F.lit(provenance).alias("provenance"), F.lit(confidence).alias("confidence"), F.lit(1.0).alias("weight"), F.lit(source).alias("source")).distinct()


def _file_id() -> Column:
    none = F.lit(None).cast("string")
    return ids.symbol_id(F.col("unit"), F.col("lang"), F.col("path"), none, none, none)


def _at(line: Column | str) -> Column:
    return F.concat(F.col("path"), F.lit(":"), (F.col(line) if isinstance(line, str) else line).cast("string"))


def symbols(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files, classes and functions, and ``defines`` from each file (1.0). Methods belong to the last class above them."""
    d = readers.definitions(files)
    w = Window.partitionBy("unit", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("owner", F.last(F.when(F.col("kind") == "class", F.col("name")), ignorenulls=True).over(w))
    d = d.withColumn("container", F.when(F.col("kind") == "function", F.col("owner")))
    d = d.withColumn("id", ids.symbol_id(F.col("unit"), F.col("lang"), F.col("path"), F.col("container"), F.col("name"), F.col("kind")))
    own = _nodes(d, "symbols", id=F.col("id"), kind=F.col("kind"), name=F.col("name"), container=F.col("container"), file=F.col("path"), line=F.col("line"), repo=F.col("unit"), lang=F.col("lang"))
    f = _nodes(files, "symbols", id=_file_id(), kind=F.lit("file"), name=F.element_at(F.split("path", "/"), -1), file=F.col("path"), repo=F.col("unit"), lang=F.col("lang"))
    return f.unionByName(own), _edges(d, "symbols", _file_id(), F.col("id"), "defines", _at("line"), 1.0)


def calls(files: DataFrame) -> DataFrame:
    """``calls`` from a file to the one function of a name (0.65), or to the one in its own unit (0.55); inferred."""
    n, _ = symbols(files)
    defs = n.where("kind = 'function'").select("name", "repo", "id", "file")
    sites = code.call_sites(code.blanked(files.withColumn("doc_id", F.concat_ws("\x01", "unit", "lang", "path"))).select("doc_id", "text"))
    key = F.split("doc_id", "\x01")
    uses = sites.select("name", "line_no", key[0].alias("repo"), key[0].alias("unit"), key[1].alias("lang"), key[2].alias("path"))
    hit = resolve.by_name(uses, defs.select("name", "repo", "id"), 0.65, 0.55).where("state = 'resolved'")
    hit = hit.join(defs.select("id", F.col("file").alias("to")), "id").where("path <> to")
    return hit.select(_file_id().alias("src"), F.col("id").alias("dst"), F.lit("calls").alias("kind"), _at("line_no").alias("evidence"), F.lit("INFERRED").alias("provenance"), "confidence", F.lit(1.0).alias("weight"), F.lit("symbols").alias("source")).distinct()


def tables(files: DataFrame, owner: Column) -> tuple[DataFrame, DataFrame]:
    """Tables and who defines (1.0), reads and writes them (0.8), by the service that ``owner`` gives for a file."""
    f = files.withColumn("doc_id", F.concat_ws("\x01", owner, "path"))
    key = F.split("doc_id", "\x01")
    use = code.sql_tables(f).select(key[0].alias("svc"), key[1].alias("path"), "table_name", F.when(F.col("mode") == "write", "writes-table").otherwise("reads-table").alias("k"))
    made = code.declared_tables(f).select(key[0].alias("svc"), key[1].alias("path"), "table_name", F.lit("defines-table").alias("k"))
    first = use.unionByName(made).groupBy("svc", "table_name", "k").agg(F.min("path").alias("path"))
    to = ids.named_id("table", F.col("table_name"))
    n = first.groupBy("table_name").agg(F.min(F.when(F.col("k") == "defines-table", F.col("svc"))).alias("svc"))
    e = _edges(first, "sqlschema", ids.named_id("service", F.col("svc")), to, F.col("k"), F.col("path"), 0.8)
    return _nodes(n, "sqlschema", id=to, kind=F.lit("table"), name=F.col("table_name"), service=F.col("svc")), e.withColumn("confidence", F.when(F.col("kind") == "defines-table", 1.0).otherwise(0.8))


def routes(files: DataFrame, owner: Column) -> tuple[DataFrame, DataFrame]:
    """Routes of annotated controllers and specifications: ``exposes`` from the service, ``handled-by`` to the file (0.95)."""
    r = views.controller_routes(files).join(files.select("unit", "path", "lang", owner.alias("svc")), ["unit", "path"])
    rid = ids.named_id("route", F.concat_ws(" ", "svc", "method", "route"))
    spec = readers.specs(files).where("kind = 'route' AND owner IS NOT NULL").select(F.col("owner").alias("svc"), "method", F.col("name").alias("route"), "path")
    both = r.select("svc", "method", "route", "path").unionByName(spec)
    n = _nodes(both, "topology", id=rid, kind=F.lit("route"), name=F.concat_ws(" ", "method", "route"), service=F.col("svc"))
    e = _edges(both, "topology", ids.named_id("service", F.col("svc")), rid, "exposes", F.col("path"), 0.95)
    return n, e.unionByName(_edges(r, "topology", rid, _file_id(), "handled-by", F.col("path"), 0.95))


def dependencies(files: DataFrame, known: DataFrame) -> DataFrame:
    """``depends-on`` to a known module (name), else ``uses-library``; both read from manifests (1.0)."""
    m = readers.manifests(files).join(known.select("name").distinct().withColumn("own", F.lit(True)), "name", "left")
    own = F.coalesce("own", F.lit(False))
    return _edges(m, "builddeps", ids.named_id("service", F.col("unit")), F.when(own, ids.named_id("service", F.col("name"))).otherwise(ids.named_id("library", F.col("name"))), F.when(own, "depends-on").otherwise("uses-library"), F.col("path"), 1.0)


def containers(files: DataFrame) -> DataFrame:
    """``depends-on`` of compose files as calls (0.6), data sources as ``uses-datastore`` (1.0)."""
    c = readers.compose(files)
    svc = ids.named_id("service", F.col("service"))
    call = c.select("service", "path", F.explode("depends_on").alias("to"))
    url = r"^(?:jdbc:)?([a-z0-9+]+)://([^/]+)/(\w+)"
    store = resolve.datastore_identity(F.regexp_extract("dsn", url, 1), F.regexp_extract("dsn", url, 2), F.regexp_extract("dsn", url, 3))
    return _edges(call, "compose", svc, ids.named_id("service", F.col("to")), "http", F.col("path"), 0.6).unionByName(
        _edges(c.where("dsn IS NOT NULL"), "compose", svc, ids.named_id("datastore", store), "uses-datastore", F.col("path"), 1.0)
    )


def observed(calls_: DataFrame) -> DataFrame:
    """One ``http`` edge per pair of (client, server, calls, errors, error_rate): observed traffic, the strongest evidence (1.0)."""
    e = _edges(calls_, "traces", ids.named_id("service", F.col("client")), ids.named_id("service", F.col("server")), "http", F.lit("runtime traces"), 1.0)
    extra = calls_.select(ids.named_id("service", F.col("client")).alias("src"), ids.named_id("service", F.col("server")).alias("dst"), F.to_json(F.struct(F.col("calls"), F.col("error_rate"), F.col("errors"), F.lit(True).alias("runtime"))).alias("extra"))
    return e.join(extra, ["src", "dst"])


def secrets(files: DataFrame) -> DataFrame:
    """(category, detail, key): places of credentials as gaps, never their values."""
    rows = code.secret_places(files.withColumn("doc_id", F.concat_ws("/", "unit", "path")))
    detail = F.concat("doc_id", F.lit(":"), F.col("line_no").cast("string"))
    return rows.select(F.lit("credential-in-source").alias("category"), detail.alias("detail")).withColumn("key", estate.ack_key(F.col("category"), F.col("detail")))
