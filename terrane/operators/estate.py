"""Questions about an estate: architecture, schemas, impact, pull requests, coverage, snapshots of the surface."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.model import ids, vocab
from terrane.operators import graph


def _ends(edges: DataFrame, nodes: DataFrame, src: Sequence[str], dst: Sequence[str]) -> DataFrame:
    """edges with s_* and d_* fields of their nodes, of the wanted ones."""
    side = lambda p: nodes.select(F.col("id").alias(p), F.col("kind").alias(f"{p[0]}_kind"), F.col("name").alias(f"{p[0]}_name"), F.col("service").alias(f"{p[0]}_service"), F.col("repo").alias(f"{p[0]}_repo"))
    got = edges.join(side("src"), "src").join(side("dst"), "dst")
    if src:
        got = got.where(F.col("s_kind").isin(*src))
    return got.where(F.col("d_kind").isin(*dst)) if dst else got


def architecture_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, count, kinds, provenance, evidence): one arrow per ordered pair of services; INFERRED wins."""
    got = _ends(edges.where(F.col("kind").isin(*vocab.RUNTIME_KINDS)), nodes, ["service"], ["service"])
    per = got.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"), F.bool_or(F.col("provenance") == "INFERRED").alias("weak"), F.min("evidence").alias("evidence"))
    return per.groupBy(F.col("src").alias("source"), F.col("dst").alias("target")).agg(
        F.sum("n").alias("count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat_ws("=", x["kind"], x["n"].cast("string"))), ",").alias("kinds"),
        F.when(F.bool_or("weak"), "INFERRED").otherwise("EXTRACTED").alias("provenance"), F.min("evidence").alias("evidence"),
    )


def waypoints(edges: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """(id, kind, writers, readers, services, significant): queues and stores that at least ``least`` services meet in."""
    run = edges.where(F.col("kind").isin(*vocab.RUNTIME_KINDS))
    out = _ends(run, nodes, ["service"], vocab.WAYPOINT_KINDS).select(
        F.col("dst").alias("id"), F.col("d_kind").alias("kind"), F.col("src").alias("svc"),
        F.col("kind").isin(*vocab.WRITING_KINDS).alias("writes"), (F.col("kind") == "reads-table").alias("reads"),
    )
    into = _ends(run, nodes, vocab.WAYPOINT_KINDS, ["service"]).select(F.col("src").alias("id"), F.col("s_kind").alias("kind"), F.col("dst").alias("svc"), F.lit(False).alias("writes"), F.lit(True).alias("reads"))
    return (
        out.unionByName(into).where("writes OR reads").groupBy("id", "kind")
        .agg(F.countDistinct(F.when(F.col("writes"), F.col("svc"))).alias("writers"), F.countDistinct(F.when(F.col("reads"), F.col("svc"))).alias("readers"), F.countDistinct("svc").alias("services"))
        .where(F.col("services") >= least).withColumn("significant", F.col("writers") > 1)
    )


def data_matrix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, name, owner, readers, writers, declared_by, touched): who reads, writes and declares each table, as sorted names."""
    acc = edges.where(F.col("kind").isin("reads-table", "writes-table", "defines-table")).select(F.col("dst").alias("id"), "kind", ids.tail(F.col("src")).alias("svc")).distinct()
    names = lambda k: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("svc")))), ",")
    agg = acc.groupBy("id").agg(names("reads-table").alias("readers"), names("writes-table").alias("writers"), names("defines-table").alias("declared_by"), F.countDistinct("svc").alias("touched"))
    t = nodes.where("kind = 'table'").select("id", "name", F.col("service").alias("owner"))
    none = F.lit("")
    return t.join(agg, "id", "left").select("id", "name", "owner", F.coalesce("readers", none).alias("readers"), F.coalesce("writers", none).alias("writers"), F.coalesce("declared_by", none).alias("declared_by"), F.coalesce("touched", F.lit(0)).alias("touched"))


def shared_tables(edges: DataFrame) -> DataFrame:
    """(id, services, writers, readers_only): tables that more than one service reads or writes."""
    acc = edges.where(F.col("kind").isin("reads-table", "writes-table")).groupBy(F.col("dst").alias("id"), F.col("src").alias("svc")).agg(F.bool_or(F.col("kind") == "writes-table").alias("w"))
    return acc.groupBy("id").agg(F.count("*").alias("services"), F.sum(F.col("w").cast("bigint")).alias("writers"), F.sum((~F.col("w")).cast("bigint")).alias("readers_only")).where("services > 1")


def topics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, producers, consumers, state): every topic seen, and which lack a producer or a consumer."""
    made = edges.where("kind = 'produces'").select(F.col("dst").alias("id"), F.col("src").alias("p"), F.lit(None).cast("string").alias("c"))
    used = edges.where("kind = 'consumed-by'").select(F.col("src").alias("id"), F.lit(None).cast("string").alias("p"), F.col("dst").alias("c"))
    said = nodes.where("kind = 'topic'").select("id", F.lit(None).cast("string").alias("p"), F.lit(None).cast("string").alias("c"))
    g = made.unionByName(used).unionByName(said).groupBy("id").agg(F.countDistinct("p").alias("producers"), F.countDistinct("c").alias("consumers"))
    state = F.when(F.col("producers") == 0, F.when(F.col("consumers") == 0, "direction-unknown").otherwise("unproduced")).when(F.col("consumers") == 0, "unconsumed").otherwise("ok")
    return g.withColumn("state", state)


def events(edges: DataFrame) -> DataFrame:
    """(src, dst, topic): producer to consumer of one topic, not to itself."""
    p = edges.where("kind = 'produces'").select(F.col("dst").alias("topic"), F.col("src").alias("p")).distinct()
    c = edges.where("kind = 'consumed-by'").select(F.col("src").alias("topic"), F.col("dst").alias("c")).distinct()
    return p.join(c, "topic").where("p <> c").select(F.col("p").alias("src"), F.col("c").alias("dst"), "topic")


def surface(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(section, item): services, routes, topics and service links of the graph, as one comparable list."""
    s = nodes.where("kind = 'service'").select(F.lit("service").alias("section"), F.col("name").alias("item"))
    r = nodes.where("kind = 'route'").select(F.lit("route").alias("section"), F.concat_ws(" ", F.coalesce("service", F.lit("?")), "name").alias("item"))
    t = nodes.where("kind = 'topic'").select(F.lit("topic").alias("section"), F.col("name").alias("item"))
    e = _ends(edges, nodes, ["service"], ["service"]).where("s_name <> d_name").select(F.lit("edge").alias("section"), F.concat("s_name", F.lit(" -"), "kind", F.lit("-> "), "d_name").alias("item"))
    w = _ends(edges.where("kind = 'writes-table'"), nodes, [], []).select(F.lit("writer").alias("section"), F.concat_ws(" <- ", "d_name", "s_name").alias("item"))
    return s.unionByName(r).unionByName(t).unionByName(e).unionByName(w).distinct()


def surface_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(section, item, change): added and removed, by one full comparison on the key."""
    o, n = old.withColumn("o", F.lit(1)), new.withColumn("n", F.lit(1))
    return n.join(o, ["section", "item"], "full").where("o IS NULL OR n IS NULL").select("section", "item", F.when(F.col("o").isNull(), "added").otherwise("removed").alias("change"))


def writer_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table_name, gained, lost, became_multi) from (table_name, writer) of two times, for tables in both."""
    agg = lambda d, n: d.groupBy("table_name").agg(F.collect_set("writer").alias(n))
    both = agg(old, "o").join(agg(new, "n"), "table_name")
    text = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return both.select("table_name", text("n", "o").alias("gained"), text("o", "n").alias("lost"), ((F.size("o") <= 1) & (F.size("n") > 1)).alias("became_multi")).where("gained <> '' OR lost <> ''")


def affected_services(edges: DataFrame, nodes: DataFrame, members: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(service, reason): where a change to ``start`` (id) lives, what depends on it, and who calls those services.

    A node's service is the one its membership names; one without a service node goes by what it says itself and has no callers.
    """
    start = start.select("id").distinct()
    deps = graph.reach(edges, start, vocab.SYMBOL_KINDS, depth).select("id")
    hit = start.withColumn("reason", F.lit("origin")).unionByName(deps.withColumn("reason", F.lit("symbol")))
    svc = nodes.where("kind = 'service'").select(F.col("id").alias("grp"), "name")
    said = nodes.select("id", F.coalesce("service", "repo").alias("said"))
    first = hit.join(said, "id").join(members, "id", "left").join(svc, "grp", "left").select("grp", F.coalesce("name", "said").alias("service"), "reason").where("service IS NOT NULL").distinct()
    called = first.where("grp IS NOT NULL").select(F.col("grp").alias("dst"), F.col("service").alias("of")).distinct()
    callers = edges.where(F.col("kind").isin(*vocab.SERVICE_KINDS)).join(called, "dst").join(nodes.select(F.col("id").alias("src"), F.col("name").alias("service")), "src")
    return first.select("service", "reason").unionByName(callers.where("service <> of").select("service", F.lit("caller").alias("reason"))).distinct()


def contracts_of(edges: DataFrame, nodes: DataFrame, services: DataFrame) -> DataFrame:
    """(service, kind, name) of routes exposed and topics produced by ``services`` (id of the service node)."""
    named = nodes.join(services.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("src"), F.col("name").alias("service"))
    hit = edges.where(F.col("kind").isin("exposes", "produces")).select("src", "dst").join(named, "src")
    return hit.join(nodes.where("kind IN ('route', 'topic')").select(F.col("id").alias("dst"), "kind", "name"), "dst").select("service", "kind", "name").distinct()


def owner_scores(own: DataFrame, repos: DataFrame, file: tuple[str, str] | None = None, k: int = 5) -> DataFrame:
    """(author, score): commits of the top five per repo added up, plus five times those of the file's own top five."""
    per = own.join(repos.select("repo").distinct(), "repo", "left_semi").groupBy("repo", "author").agg(F.sum("commits").alias("c"))
    w = Window.partitionBy("repo").orderBy(F.col("c").desc(), "author")
    parts = per.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("author", "c")
    if file:
        f = own.where((F.col("repo") == file[0]) & (F.col("path") == file[1])).groupBy("author").agg((F.sum("commits") * 5).alias("c"))
        parts = parts.unionByName(f.orderBy(F.col("c").desc(), "author").limit(5))
    return parts.groupBy("author").agg(F.sum("c").alias("score")).orderBy(F.col("score").desc(), "author").limit(k)


def pr_context(edges: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(section, item) for changed (repo, rel): services touched, tables and multi-writer tables they use, routes handled, unmatched files."""
    files = nodes.where("kind = 'file'").select(F.col("repo"), F.col("file").alias("rel"), "id", F.coalesce("service", "repo").alias("service"))
    hit = changed.join(files, ["repo", "rel"])
    lost = changed.join(files, ["repo", "rel"], "left_anti").select(F.lit("unmatched").alias("section"), F.concat_ws("/", "repo", "rel").alias("item"))
    svcs = hit.select("service").distinct()
    use = _ends(edges.where("kind IN ('reads-table', 'writes-table')"), nodes, [], [])
    touched = use.join(svcs, use["s_name"] == svcs["service"], "left_semi").select("d_name").distinct()
    multi = use.where("kind = 'writes-table'").join(touched, "d_name", "left_semi").groupBy("d_name").agg(F.countDistinct("s_name").alias("n")).where("n > 1")
    routes = edges.where("kind = 'handled-by'").join(hit.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("id").alias("src"), "name"), "src")
    named = lambda d, s, c: d.select(F.lit(s).alias("section"), F.col(c).alias("item"))
    return (
        named(svcs, "service", "service").unionByName(named(touched, "table", "d_name")).unionByName(named(multi, "multi-writer", "d_name"))
        .unionByName(named(routes, "route", "name")).unionByName(lost).distinct()
    )


def flow(edges: DataFrame, nodes: DataFrame, members: DataFrame, entity: str, entries: int = 12) -> DataFrame:
    """(stage, item, service): entry routes of an entity, then the tables, topics and consumers of the services that hold them."""
    routes = nodes.where((F.col("kind") == "route") & F.col("name").ilike(f"%{entity}%")).orderBy("name", "id").limit(entries)
    names = nodes.where("kind = 'service'").select(F.col("id").alias("src"), F.col("name").alias("service"))
    svcs = routes.select("id").join(members.select("id", F.col("grp").alias("src")), "id").select("src").distinct().join(names, "src")
    e = edges.join(svcs, "src")
    entry = routes.select(F.lit("entry").alias("stage"), F.col("name").alias("item"), "service")
    data = e.where("kind IN ('reads-table', 'writes-table')").select(F.lit("data").alias("stage"), ids.tail(F.col("dst")).alias("item"), "service")
    event = e.where("kind = 'produces'").select(F.lit("event").alias("stage"), F.col("dst").alias("t"), "service")
    used = edges.where("kind = 'consumed-by'").select(F.col("src").alias("t"), F.col("dst").alias("c")).join(event.select("t").distinct(), "t")
    return entry.unionByName(data).unionByName(event.select("stage", ids.tail(F.col("t")).alias("item"), "service")).unionByName(
        used.select(F.lit("consumer").alias("stage"), ids.tail(F.col("c")).alias("item"), ids.tail(F.col("c")).alias("service"))
    ).distinct()


def service_table(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, name, files, inbound, outbound) of each service."""
    s = nodes.where("kind = 'service'").select("id", "name")
    files = nodes.where("kind = 'file' AND service IS NOT NULL").groupBy(F.col("service").alias("name")).agg(F.count("*").alias("files"))
    link = edges.where(F.col("kind").isin(*vocab.SERVICE_KINDS))
    n_in, n_out = link.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inbound")), link.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outbound"))
    return s.join(files, "name", "left").join(n_in, "id", "left").join(n_out, "id", "left").fillna(0, ["files", "inbound", "outbound"])


def coverage(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(measure, n): provenance split, runtime-observed edges, nodes and edges in all."""
    e = edges.agg(
        F.count("*").alias("edges"), F.sum((F.col("provenance") == "EXTRACTED").cast("bigint")).alias("extracted"), F.sum((F.col("provenance") == "INFERRED").cast("bigint")).alias("inferred"),
        F.sum(F.coalesce(F.get_json_object("extra", "$.runtime") == "true", F.lit(False)).cast("bigint")).alias("runtime"), F.sum(F.col("kind").isin(*vocab.BUILD_KINDS).cast("bigint")).alias("build_time"),
    )
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("repo").alias("repos"))
    both = e.crossJoin(n)  # one row each
    return both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n")) for c in ("edges", "extracted", "inferred", "runtime", "build_time", "nodes", "repos")])))


def find(nodes: DataFrame, name: str, ranks: DataFrame | None = None, limit: int = 25, **exact: str) -> DataFrame:
    """(id, name, kind, pass_no): exact names first, then names and files that contain the text; no case; optional equal fields."""
    rows = nodes
    for c, v in exact.items():
        rows = rows.where(F.col(c) == v)
    p = F.when(F.lower("name") == name.lower(), 1).when(F.col("file") == name, 2).when(F.col("file").endswith(name), 3).when(F.col("name").ilike(f"%{name}%") | F.col("file").ilike(f"%{name}%"), 4)
    got = rows.withColumn("pass_no", p).where("pass_no IS NOT NULL")
    score = F.lit(0.0)
    if ranks is not None:
        got, score = got.join(ranks, "id", "left"), F.coalesce("rank", F.lit(0.0))
    return got.orderBy("pass_no", score.desc(), "name", "id").limit(limit).select("id", "name", "kind", "pass_no")


def audit(checks: Sequence[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(name, probed, produced, ratio) from (name, probe rows, found rows), both (key); ratio null where nothing was probed."""
    out = None
    for name, probe, made in checks:
        row = probe.select("key").distinct().join(made.select("key").distinct().withColumn("hit", F.lit(1)), "key", "left").agg(F.count("*").alias("probed"), F.coalesce(F.sum("hit"), F.lit(0)).alias("produced"))
        row = row.select(F.lit(name).alias("name"), "probed", "produced", F.round(F.try_divide(F.col("produced").cast("double"), F.col("probed")), 4).alias("ratio"))
        out = row if out is None else out.unionByName(row)
    return out


def ack_key(category: Column, detail: Column) -> Column:
    """First 8 hex signs of the hash of a finding, without line numbers and counts, so it holds from scan to scan."""
    d = F.regexp_replace(F.trim(F.coalesce(detail, F.lit(""))), r":[0-9]+\b", "")
    d = F.lower(F.regexp_replace(F.regexp_replace(d, r"\b[0-9]+\b", "#"), r"\s+", " "))
    return F.substring(F.sha2(F.concat(F.lower(F.trim(F.coalesce(category, F.lit("")))), F.lit("|"), d), 256), 1, 8)
