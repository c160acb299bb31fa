"""Views a person opens: node detail, service, package and file levels, questions, gaps, modules, central code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.model import vocab
from terrane.operators import estate, graph


def node_detail(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """(side, kind, id, name, evidence): every edge of one node with the node at its other end."""
    out = edges.where(F.col("src") == node_id).select(F.lit("out").alias("side"), "kind", F.col("dst").alias("id"), "evidence")
    into = edges.where(F.col("dst") == node_id).select(F.lit("in").alias("side"), "kind", F.col("src").alias("id"), "evidence")
    return out.unionByName(into).join(nodes.select("id", "name"), "id", "left").select("side", "kind", "id", "name", "evidence")


def file_view(edges: DataFrame, nodes: DataFrame, repo: str, file: str) -> DataFrame:
    """(src, dst, kind): edges that touch the nodes of one file: the file and its neighbours one hop away."""
    own = nodes.where((F.col("repo") == repo) & (F.col("file") == file)).select("id")
    hit = lambda end: edges.join(own.select(F.col("id").alias(end)), end, "left_semi").select("src", "dst", "kind")
    return hit("src").unionByName(hit("dst")).distinct()


def service_view(edges: DataFrame, nodes: DataFrame, service: str, depth: int) -> DataFrame:
    """(source, target, kind, count): the packages of one service, and the actors and tables they touch."""
    own = F.coalesce("service", "repo") == service
    group = F.when(own & F.col("file").isNotNull(), F.concat(F.lit("package "), graph.package_key(F.col("file"), depth))).when(F.col("kind").isin(*vocab.TOP_KINDS, "table"), F.col("id"))
    inner = nodes.where(own & F.col("file").isNotNull()).select("id")
    touched = edges.join(inner.select(F.col("id").alias("src")), "src", "left_semi").unionByName(
        edges.join(inner.select(F.col("id").alias("dst")), "dst", "left_semi").join(inner.select(F.col("id").alias("src")), "src", "left_anti").select(edges.columns)
    )
    rolled = graph.rollup(touched, nodes.select("id", group.alias("grp")))
    return rolled.where(F.col("source").startswith("package ") | F.col("target").startswith("package ")).select("source", "target", "kind", "count")


def modules(nodes: DataFrame, kinds: Sequence[str] = ("service", "library")) -> DataFrame:
    """(id, name, kind, repo, artifact): services and libraries with the build artifact they come from."""
    return nodes.where(F.col("kind").isin(*kinds)).select("id", "name", "kind", "repo", F.get_json_object("extra", "$.artifactId").alias("artifact"))


def central_code(edges: DataFrame, nodes: DataFrame, ranks: DataFrame, k: int = 20) -> DataFrame:
    """(id, name, kind, inbound, rank): classes and functions something depends on, best ranked first."""
    inbound = edges.where(F.col("kind").isin(*vocab.SYMBOL_KINDS)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inbound"))
    got = nodes.where("kind IN ('class', 'function')").select("id", "name", "kind").join(inbound, "id").join(ranks, "id")
    return got.orderBy(F.col("rank").desc(), "id").limit(k)


def gaps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(category, detail): what the graph shows to be missing or doubtful."""
    t = estate.topics(edges, nodes).where("state IN ('unproduced', 'unconsumed', 'direction-unknown')")
    topic = t.select(F.when(F.col("state") == "unproduced", "unproduced-topic").when(F.col("state") == "unconsumed", "unconsumed-topic").otherwise("topic-direction-unknown").alias("category"), F.col("id").alias("detail"))
    shared = estate.shared_tables(edges).where("writers > 1").select(F.lit("shared-table").alias("category"), F.concat("id", F.lit(": "), F.col("services").cast("string"), F.lit(" services")).alias("detail"))
    twice = nodes.where("kind = 'table'").groupBy("name").agg(F.countDistinct("repo").alias("n")).where("n > 1").select(F.lit("table-declared-twice").alias("category"), F.col("name").alias("detail"))
    return topic.unionByName(shared).unionByName(twice).distinct()


def with_keys(found: DataFrame, acks: DataFrame | None = None) -> DataFrame:
    """(category, detail, key, hidden): findings with their stable keys; ``acks`` (key) hides those agreed upon."""
    keyed = found.withColumn("key", estate.ack_key(F.col("category"), F.col("detail")))
    if acks is None:
        return keyed.withColumn("hidden", F.lit(False))
    return keyed.join(acks.select("key").distinct().withColumn("a", F.lit(True)), "key", "left").select("category", "detail", "key", F.coalesce("a", F.lit(False)).alias("hidden"))


#: How many questions of each rule are asked.
QUESTION_CAPS = {
    "who owns the table": 5, "who reads the topic": 5, "who writes the topic": 5, "is the service alive": 5, "who else knows the file": 5, "who declares the table": 5,
    "is the link real": 5, "what does the service offer": 5, "why do they change together": 5, "does the library need to be so common": 3, "which node do all lean on": 3,
}


def questions(edges: DataFrame, nodes: DataFrame, bus: DataFrame, coupled: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """(rule, subject, place): what to ask the owners, the most pressing of each rule up to its cap.

    Tables with several writers, read or written but nowhere declared; topics without a reader or a writer; services nobody calls, or that
    offer nothing; links between services that are inferred only; files one person holds (``bus``: repo, path, author_share); files of
    different directories that change together (``coupled``: a, b, degree); libraries most use; nodes most symbols depend on.
    """
    caps = QUESTION_CAPS | (caps or {})
    as_ = lambda d, rule, subject, weight: d.select(F.lit(rule).alias("rule"), subject.alias("subject"), weight.cast("double").alias("weight"))
    col = F.col
    shared, topic, svc = estate.shared_tables(edges), estate.topics(edges, nodes), estate.service_table(edges, nodes)
    declared = edges.where("kind = 'defines-table'").select("dst").distinct()
    bare = edges.where("kind IN ('reads-table', 'writes-table')").join(declared, "dst", "left_anti").groupBy("dst").agg(F.countDistinct("src").alias("n"))
    offers = edges.where("kind IN ('exposes', 'produces')").select(col("src").alias("id")).distinct()
    s = nodes.where("kind = 'service'").select("id")
    link = edges.where(col("kind").isin(*vocab.SERVICE_KINDS)).join(s.select(col("id").alias("src")), "src", "left_semi").join(s.select(col("id").alias("dst")), "dst", "left_semi")
    weak = link.groupBy("src", "dst").agg(F.count("*").alias("n"), F.bool_and(col("provenance") == "INFERRED").alias("only")).where("only")
    dir_ = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    used = edges.where("kind = 'uses-library'").groupBy("dst").agg(F.countDistinct("src").alias("n"))
    leaned = edges.where(col("kind").isin(*vocab.SYMBOL_KINDS)).groupBy("dst").agg(F.count("*").alias("n"))
    parts = [
        as_(shared.where("writers > 1"), "who owns the table", col("id"), col("writers")), as_(bare, "who declares the table", col("dst"), col("n")),
        as_(topic.where("state = 'unconsumed'"), "who reads the topic", col("id"), col("producers")), as_(topic.where("state = 'unproduced'"), "who writes the topic", col("id"), col("consumers")),
        as_(svc.where("inbound = 0"), "is the service alive", col("id"), col("files")), as_(svc.join(offers, "id", "left_anti"), "what does the service offer", col("id"), col("files")),
        as_(weak, "is the link real", F.concat("src", F.lit(" > "), "dst"), col("n")), as_(bus, "who else knows the file", F.concat_ws("/", "repo", "path"), col("author_share")),
        as_(coupled.where(dir_(col("a")) != dir_(col("b"))), "why do they change together", F.concat("a", F.lit(" + "), "b"), col("degree")),
        as_(used, "does the library need to be so common", col("dst"), col("n")), as_(leaned, "which node do all lean on", col("dst"), col("n")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    place = F.row_number().over(Window.partitionBy("rule").orderBy(col("weight").desc(), "subject"))
    # per-rule top-k: Spark prunes each partition to the largest cap before it shuffles
    ranked = every.withColumn("place", place).where(col("place") <= max(caps.values()))
    return ranked.where(col("place") <= F.element_at(cap, col("rule"))).select("rule", "subject", col("place").cast("bigint").alias("place"))


def version_drift(uses: DataFrame) -> DataFrame:
    """(name, versions) of packages used in more than one version, from (name, version)."""
    return uses.groupBy("name").agg(F.countDistinct("version").alias("versions")).where("versions > 1")


def topology(edges: DataFrame, nodes: DataFrame, cites: int = 3) -> DataFrame:
    """(source, target, count, confidence, evidence): service links with their first ``cites`` citations."""
    s = nodes.where("kind = 'service'")
    links = edges.where(F.col("kind").isin(*vocab.SERVICE_KINDS)).select("src", "dst", "confidence", "evidence")
    hit = links.join(s.select(F.col("id").alias("src"), F.col("name").alias("source")), "src").join(s.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst")
    w = Window.partitionBy("source", "target").orderBy("evidence")
    few = hit.withColumn("k", F.row_number().over(w))
    return few.groupBy("source", "target").agg(F.count("*").alias("count"), F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= cites, F.col("evidence")))), ",").alias("evidence"))


def visible(edges: DataFrame, styles: Sequence[str], inferred: bool = True, libraries: bool = False) -> DataFrame:
    """Edges as a viewer's switches leave them: style classes, inferred ones, third-party libraries."""
    e = edges.where(vocab.lookup(vocab.EDGE_STYLE, "kind", "other").isin(*styles))
    if not inferred:
        e = e.where("provenance = 'EXTRACTED'")
    return e if libraries else e.where(~F.col("dst").startswith("cart . library "))


def route_of(prefix: Column, path: Column) -> Column:
    """A class prefix and a method path as one route: empty parts dropped, one slash between."""
    parts = F.filter(F.split(F.concat_ws("/", F.coalesce(prefix, F.lit("")), F.coalesce(path, F.lit(""))), "/"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def controller_routes(files: DataFrame) -> DataFrame:
    """(unit, path, method, route): annotated handlers of Java files, under the mapping of their class."""
    value = r"\((?:[^()]*?(?:value|path)\s*=\s*)?\{?\s*\"([^\"]*)\"[^()]*\)"
    klass = F.regexp_extract("text", r"(?s)@RequestMapping\s*" + value + r"(?:(?!@\w+Mapping|\bclass\b).)*\bclass\b", 1)
    spots = files.where(F.col("text").contains("Mapping")).select("unit", "path", klass.alias("base"), F.explode(F.regexp_extract_all("text", F.lit(r"@((?:Get|Post|Put|Delete|Patch)Mapping\s*(?:\([^()]*\))?)"), 1)).alias("a"))
    method = F.upper(F.regexp_extract("a", "^(Get|Post|Put|Delete|Patch)", 1))
    return spots.select("unit", "path", method.alias("method"), route_of(F.col("base"), F.regexp_extract("a", value, 1)).alias("route"))


def substitute(exprs: DataFrame, constants: DataFrame) -> DataFrame:
    """(id, value) of ``+``-joined literals and constant names; null where a name has no single value. exprs (id, expr)."""
    terms = exprs.select("id", F.posexplode(F.transform(F.split("expr", r"\s*\+\s*"), F.trim)).alias("k", "term"))
    name = F.element_at(F.split("term", r"\."), -1)
    x = terms.withColumn("name", F.when(~F.col("term").startswith('"'), name)).join(constants, "name", "left")
    x = x.withColumn("v", F.coalesce("value", F.when(F.col("term").startswith('"'), F.expr("trim(BOTH '\"' FROM term)"))))
    got = x.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("v", F.lit("")).alias("v")))).alias("vs"), F.bool_or(F.col("v").isNull()).alias("open"))
    return got.select("id", F.when(~F.col("open"), F.array_join(F.transform("vs", lambda s: s["v"]), "")).alias("value"))


def imports(uses: DataFrame, files: DataFrame) -> DataFrame:
    """(use_id, id): the file a qualified name means: its path ends in the package path, else the only file of that simple name.

    uses (use_id, fqn), files (id, path). The suffix is an equi join on the exploded suffixes of each path without its extension.
    """
    u = uses.withColumn("want", F.regexp_replace("fqn", r"\.", "/")).withColumn("simple", F.substring_index("fqn", ".", -1)).where(F.col("simple").rlike("^[A-Z]"))
    bare = F.regexp_replace("path", r"\.[A-Za-z]+$", "")
    parts = F.split(bare, "/")
    suf = files.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("want"))
    exact = u.join(suf, "want").groupBy("use_id").agg(F.min("id").alias("exact"))
    only = files.groupBy(F.element_at(parts, -1).alias("simple")).agg(F.min("id").alias("one"), F.count("*").alias("n")).where("n = 1")
    return u.join(exact, "use_id", "left").join(only, "simple", "left").select("use_id", F.coalesce("exact", "one").alias("id"))


def closest_module(names: DataFrame, modules_: DataFrame, least: int = 4) -> DataFrame:
    """(name, module): the module whose name contains or is contained in the name, longest overlap first, at least ``least`` signs.

    Containment is an equi join: the pieces of each name meet the modules that are such a piece, and the other way round.
    """
    m = modules_.select(F.col("name").alias("module")).where(F.length("name") >= least).distinct()
    n = names.select("name").where(F.length("name") >= least).distinct()

    def pieces(c: str):
        size = F.length(c)
        return F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size - least + 1), lambda i: F.transform(F.sequence(F.lit(least), size - i + 1), lambda k: F.substring(F.col(c), i, k))))))

    inside = n.select("name", pieces("name").alias("module")).join(m, "module").select("name", "module")
    around = m.select("module", pieces("module").alias("name")).join(n, "name").select("name", "module")
    size = F.least(F.length("name"), F.length("module"))
    return inside.unionByName(around).groupBy("name").agg(F.max(F.struct(size.alias("n"), "module"))["module"].alias("module"))


def of_repos(nodes: DataFrame, edges: DataFrame, repos: DataFrame) -> DataFrame:
    """(id) of the nodes a filter by ``repos`` (repo) leaves: those of the repos, and shared ones without a repo that touch one of them."""
    own = nodes.join(repos.select("repo").distinct(), "repo", "left_semi").select("id")
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("near")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("near")))
    touching = ends.join(own.select(F.col("id").alias("near")), "near", "left_semi").select("id").distinct()
    return own.unionByName(nodes.where("repo IS NULL").select("id").join(touching, "id", "left_semi"))


def capped(found: DataFrame, caps: dict[str, int]) -> DataFrame:
    """(category, detail): each detail of a category once, at most ``caps[category]`` of them, in order of the detail; others uncapped."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    once = found.select("category", "detail").distinct()
    place = F.row_number().over(Window.partitionBy("category").orderBy("detail"))
    limited = once.where(F.col("category").isin(*caps)).withColumn("place", place).where(F.col("place") <= max(caps.values())).where(F.col("place") <= F.element_at(cap, F.col("category"))).drop("place")
    return once.where(~F.coalesce(F.col("category").isin(*caps), F.lit(False))).unionByName(limited)


def repo_map(nodes: DataFrame, ranks: DataFrame, symbols: int = 12) -> DataFrame:
    """(repo, file, score, names): files by half their own rank plus the ranks of their symbols, each with its best ``symbols`` names."""
    n = nodes.where("repo IS NOT NULL AND file IS NOT NULL").select("id", "kind", "name", "repo", "file").join(ranks, "id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    own = n.where("kind = 'file'").groupBy("repo", "file").agg(F.max("rank").alias("own"))
    w = Window.partitionBy("repo", "file").orderBy(F.col("rank").desc(), "id")
    inner = n.where("kind IN ('class', 'function')").withColumn("place", F.row_number().over(w))
    # the sum takes every symbol, the names the first few
    per = inner.groupBy("repo", "file").agg(F.sum("rank").alias("sum"), F.array_sort(F.collect_list(F.when(F.col("place") <= symbols, F.struct("place", "name")))).alias("few"))
    got = own.join(per, ["repo", "file"], "full")
    score = F.round(F.lit(0.5) * F.coalesce("own", F.lit(0.0)) + F.coalesce("sum", F.lit(0.0)), 6)
    return got.select("repo", "file", score.alias("score"), F.array_join(F.transform(F.coalesce("few", F.array().cast("array<struct<place:int,name:string>>")), lambda x: x["name"]), ",").alias("names"))


def package_nodes(nodes: DataFrame, ranks: DataFrame, service: str, depth: int, most: int = 40) -> DataFrame:
    """(package, files, rank, left_out): the best ranked packages of a service, each row telling how many packages are left out."""
    own = nodes.where((F.coalesce("service", "repo") == service) & F.col("file").isNotNull()).withColumn("package", graph.package_key(F.col("file"), depth))
    per = own.join(ranks, "id", "left").groupBy("package").agg(F.countDistinct("file").alias("files"), F.round(F.sum(F.coalesce("rank", F.lit(0.0))), 6).alias("rank"))
    whole = per.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("left_out"))
    return per.orderBy(F.col("rank").desc(), "package").limit(most).crossJoin(F.broadcast(whole))


def question_key(question: Column) -> Column:
    """What two questions must share to be the same: the clause before a dash, letters and digits only, in lower case, 70 signs."""
    return F.substring(F.regexp_replace(F.lower(F.substring_index(question, "\u2014", 1)), "[^a-z0-9]", ""), 1, 70)


def age(since: Column, now: Column) -> Column:
    """A time gone by in its largest whole unit: 5s, 3m, 2h, 4d."""
    s = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(since.cast("timestamp"))
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def sorted_json(text: Column) -> Column:
    """A flat JSON object with its keys in order, values as they are written; null for what is none."""
    entries = F.array_sort(F.map_entries(F.from_json(text, "map<string,string>")))
    return F.when(F.size(entries) >= 0, F.to_json(F.map_from_entries(entries)))
