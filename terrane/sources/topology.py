"""Topology read from text: who calls, publishes to, listens to, stores in and routes to whom.

FILE rows (unit, path, lang, text) are searched line by line with built-in expressions; what a file names is a token, and only a token
that resolves to a known service (``resolve.resolve_tokens``) other than the file's own becomes an edge. Edges have the shape of
``extract``: (src, dst, kind, evidence, provenance, confidence, weight, source).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import code
from terrane.model import ids
from terrane.operators import resolve, views
from terrane.sources.extract import _edges, _file_id, _nodes

#: What a reference to another service looks like, and how far it is to be believed.
SYNC = {
    "env": (r"(?i)\b([a-z][a-z0-9_.-]{2,60}?)[_.-](?:base[_-]?ur[li]|ur[li]|host(?:name)?|endpoint|addr(?:ess)?|server)\b", 0.85),
    "url": (r"(?i)https?://([a-z0-9_.-]+)", 0.9),
    "client": (r"(?i)@(?:feign|grpc|registerrest|ribbon)client\s*\(\s*(?:[^)]*?(?:name|value|serviceid|configkey)\s*=\s*)?[\"']([^\"']+)", 0.95),
    "discovery": (r"(?i)\b(?:lb|service|discovery)://([a-z0-9_.-]+)", 0.95),
    "cluster": (r"(?i)\b([a-z0-9-]{2,60})\.[a-z0-9-]{2,40}\.svc\b", 0.95),
}
NAME = r"[\"']([A-Za-z0-9_][A-Za-z0-9_./-]{2,119})[\"']"
#: Calls and annotations that send to or listen on a topic, and the endings of event names.
PRODUCE = rf"(?i)\b(?:send|publish|produce|emit|dispatch|sendmessage|publishevent)\s*\(\s*{NAME}"
CONSUME = (
    rf"(?i)@(?:kafka|rabbit|stream|jms|sqs|event)listener\s*\((?:[^)]*?(?:topics?|queues?|destination|value|channel)\s*=\s*)?\s*\{{?\s*{NAME}|"
    rf"\b(?:subscribe|consume|listen)\s*\(\s*\[?\s*{NAME}|consumer\s*\((?:[^)]*?topics?\s*=\s*)?\[?\s*{NAME}"
)
EVENT = (
    r"[\"']([a-z][A-Za-z0-9_-]*(?:[.-][A-Za-z0-9_-]+)*\.(?:created|updated|deleted|changed|completed|failed|received|submitted|cancelled|shipped|placed|"
    r"approved|rejected|processed|synced|expired|requested|confirmed))[\"']"
)
STORE = r"(?i)\b(?:jdbc:)?(postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|cassandra|clickhouse|oracle|sqlserver)://([^\s\"'/?;]+)(?:/([A-Za-z0-9_-]+))?"
CACHE = r"@(\w*Cacheable|CacheEvict|CachePut)\b"
COMMENT = r"^\s*(?://|#|\*|/\*|<!--|--)"
_LISTENER = re.compile(r"@\w*Listener\s*\(")
CONSTANT = r"\bfinal\s+String\s+([A-Z][A-Z0-9_]*)\s*=\s*\"([^\"]*)\""


def _lines(files: DataFrame) -> DataFrame:
    """(unit, path, lang, line_no, line) of the lines that are no comments; nothing is cut off, however long the line."""
    rows = files.where("text IS NOT NULL").select("unit", "path", "lang", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return rows.where(~F.col("line").rlike(COMMENT)).select("unit", "path", "lang", (F.col("p") + 1).cast("bigint").alias("line_no"), "line")


def references(files: DataFrame) -> DataFrame:
    """(unit, path, line_no, form, token, confidence): every mention of what may be a service."""
    def of(form: str) -> Column:
        shape, sure = SYNC[form]
        return F.transform(F.regexp_extract_all("line", F.lit(shape), 1), lambda x: F.struct(F.lit(form).alias("form"), x.alias("token"), F.lit(sure).alias("confidence")))

    found = F.array(*map(of, SYNC))
    rows = _lines(files).select("unit", "path", "line_no", F.inline(F.flatten(found))).where("token <> ''")
    # in-cluster names are told whole; the host of a URL is its first label, unless it is an address
    host = F.when(F.col("form") == "url", F.when(~F.col("token").rlike(r"^[0-9.]+$|^localhost$"), F.regexp_extract("token", r"^([^.]+)", 1))).otherwise(F.col("token"))
    return rows.where(~F.lower("token").isin(*code.NOISE_HOSTS)).withColumn("whole", F.col("token")).withColumn("token", host).where("token <> ''")


def sync(files: DataFrame, services: DataFrame, owner: Column) -> tuple[DataFrame, DataFrame]:
    """(edges, gaps): ``http`` from the owner of a file to each other service it names, each pair and file at its surest form; hosts of
    one label that no service answers to are gaps."""
    refs = references(files).join(files.select("unit", "path", owner.alias("svc")).distinct(), ["unit", "path"])
    known = resolve.resolve_tokens(refs.select("token").distinct(), services)
    hit = refs.join(known, "token", "left")
    pairs = hit.where("service IS NOT NULL AND service <> svc").groupBy("svc", "service", "path").agg(F.max("confidence").alias("confidence"), F.min("line_no").alias("line_no"))
    e = _edges(pairs, "topology", ids.named_id("service", F.col("svc")), ids.named_id("service", F.col("service")), "http", F.concat_ws(":", "path", "line_no"), 1.0)
    sure = pairs.select(ids.named_id("service", F.col("svc")).alias("src"), ids.named_id("service", F.col("service")).alias("dst"), F.concat_ws(":", "path", "line_no").alias("evidence"), F.col("confidence").alias("c"))
    lost = hit.where("service IS NULL AND form = 'url' AND instr(whole, '.') = 0").select(F.lit("unknown-host").alias("category"), F.lower("whole").alias("detail")).distinct()
    return e.join(sure, ["src", "dst", "evidence"]).withColumn("confidence", F.col("c")).drop("c"), lost


def messages(files: DataFrame) -> DataFrame:
    """(unit, path, line_no, way, topic): ``consume``, ``produce`` or, where the direction is unknown, ``mention``; the first that a line shows of a topic."""
    two = F.regexp_extract_all("line", F.lit(CONSUME), 0)
    names = lambda a: F.filter(F.transform(a, lambda x: F.regexp_extract(x, NAME, 1)), lambda x: x != "")
    tag = lambda a, w, k: F.transform(a, lambda x: F.struct(F.lit(k).alias("rank"), F.lit(w).alias("way"), x.alias("topic")))
    found = F.concat(tag(names(two), "consume", 1), tag(F.regexp_extract_all("line", F.lit(PRODUCE), 1), "produce", 2), tag(F.regexp_extract_all("line", F.lit(EVENT), 1), "mention", 3))
    rows = _lines(files).select("unit", "path", "line_no", F.inline(found))
    return rows.groupBy("unit", "path", "line_no", "topic").agg(F.min(F.struct("rank", "way"))["way"].alias("way"))


def listener_spans(files: DataFrame) -> DataFrame:
    """(unit, path, first, last): character ranges of listener annotations with their balanced brackets, last excluded."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for unit, path, text in zip(pdf["unit"], pdf["path"], pdf["text"]):
                out += [(unit, path, m.start(), code.balanced(text, m.end() - 1)) for m in _LISTENER.finditer(text or "")]
            yield pd.DataFrame(out, columns=["unit", "path", "first", "last"])

    return files.select("unit", "path", "text").where(F.col("text").contains("Listener")).mapInPandas(run, "unit string, path string, first int, last int")


def topic_constants(files: DataFrame) -> DataFrame:
    """(name, value) of constants that hold a topic's name, from files that speak of messaging; of one value everywhere."""
    hint = F.lower("path").rlike("topic|kafka|queue|event|messag|channel") | F.substring("text", 1, 4000).contains("Kafka")
    enum = r"\b([A-Z][A-Z0-9_]*)\s*\(\s*\"([^\"]+)\""
    rows = files.where(hint).select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(CONSTANT), 0), F.regexp_extract_all("text", F.lit(enum), 0))).alias("m"))
    name, value = F.coalesce(F.nullif(F.regexp_extract("m", CONSTANT, 1), F.lit("")), F.regexp_extract("m", enum, 1)), F.coalesce(F.nullif(F.regexp_extract("m", CONSTANT, 2), F.lit("")), F.regexp_extract("m", enum, 2))
    return resolve.constants(rows.select(name.alias("name"), value.alias("value")).where(F.col("value").rlike(r"^[a-z][a-z0-9_-]*(?:[.-][a-z0-9_-]+)+$")))


def constant_messages(files: DataFrame) -> DataFrame:
    """(unit, path, line_no, way, topic) of topics named by a constant: inside a listener's brackets it is consumed, on a sending line
    produced, else mentioned; the declaring line names nobody."""
    names = topic_constants(files)
    used = files.where(F.col("text").rlike(r"[A-Z][A-Z0-9]*_[A-Z0-9_]+")).select("unit", "path", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Z0-9]*_[A-Z0-9_]+)\b"), 1))).alias("name")).join(names, "name")
    at = used.select("unit", "path", "name", "value", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.col("line").contains(F.col("name")))
    at = at.where(~F.col("line").rlike(CONSTANT) & ~F.col("line").rlike(r"^\s*[A-Z][A-Z0-9_]*\s*\(\s*\"")).withColumn("line_no", (F.col("p") + 1).cast("bigint"))
    before = lambda c: (F.regexp_count(F.substring("text", F.lit(1), F.col(c)), F.lit("\n")) + 1).cast("bigint")
    spans = listener_spans(files).join(files.select("unit", "path", "text"), ["unit", "path"]).select("unit", "path", before("first").alias("a"), before("last").alias("b"))
    inside = at.join(spans, ["unit", "path"]).where("line_no BETWEEN a AND b").select("unit", "path", "line_no", "name").distinct().withColumn("heard", F.lit(True))
    way = F.when(F.col("heard"), "consume").when(F.col("line").rlike(r"(?i)\b(?:send|publish|produce|emit|dispatch)\w*\s*\("), "produce").otherwise("mention")
    return at.join(inside, ["unit", "path", "line_no", "name"], "left").select("unit", "path", "line_no", way.alias("way"), F.col("value").alias("topic"))


def asynchronous(found: DataFrame, files: DataFrame, owner: Column) -> tuple[DataFrame, DataFrame]:
    """(topics, edges) from (unit, path, line_no, way, topic): ``produces`` and ``consumed-by`` (0.9), ``event`` from each producer to each
    consumer of a topic (0.85). A topic only mentioned is a node without edges."""
    m = found.join(files.select("unit", "path", owner.alias("svc")).distinct(), ["unit", "path"])
    tid, sid = ids.named_id("topic", F.col("topic")), ids.named_id("service", F.col("svc"))
    first = m.groupBy("svc", "topic", "way").agg(F.min(F.concat_ws(":", "path", "line_no")).alias("at"))
    p, c = first.where("way = 'produce'"), first.where("way = 'consume'")
    e = _edges(p, "topology", sid, tid, "produces", F.col("at"), 0.9).unionByName(_edges(c, "topology", tid, sid, "consumed-by", F.col("at"), 0.9))
    met = p.select("topic", "svc").join(c.select("topic", F.col("svc").alias("to")), "topic").where("svc <> to")
    event = _edges(met, "topology", sid, ids.named_id("service", F.col("to")), "event", F.concat(F.lit("topic "), "topic"), 0.85, "INFERRED")
    return _nodes(m, "topology", id=tid, kind=F.lit("topic"), name=F.col("topic")), e.unionByName(event)


def stores(files: DataFrame, owner: Column) -> tuple[DataFrame, DataFrame]:
    """(datastores, edges): ``uses-datastore`` (0.9) of database URLs outside compose files; unresolved placeholders are skipped."""
    rows = _lines(files.where(~F.col("path").rlike(r"(^|/)(docker-)?compose[^/]*$"))).where(F.col("line").contains("://")).join(files.select("unit", "path", owner.alias("svc")).distinct(), ["unit", "path"])
    m = rows.select("svc", "path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(STORE), 0)).alias("u")).where(~F.col("u").contains("${"))
    key = resolve.datastore_identity(F.regexp_extract("u", STORE, 1), F.regexp_extract("u", STORE, 2), F.nullif(F.regexp_extract("u", STORE, 3), F.lit("")))
    first = m.groupBy("svc", key.alias("store")).agg(F.min(F.concat_ws(":", "path", "line_no")).alias("at"))
    sid = ids.named_id("datastore", F.col("store"))
    return _nodes(first, "topology", id=sid, kind=F.lit("datastore"), name=F.col("store")), _edges(first, "topology", ids.named_id("service", F.col("svc")), sid, "uses-datastore", F.col("at"), 0.9)


def shared_stores(edges: DataFrame) -> DataFrame:
    """(id, services): data stores that more than one service uses."""
    return edges.where("kind = 'uses-datastore'").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("services")).where("services > 1")


def caches(files: DataFrame, owner: Column) -> DataFrame:
    """(service, place, kinds): the first cache annotation of each service and how many different ones it has."""
    rows = _lines(files).where(F.col("line").contains("Cach")).join(files.select("unit", "path", owner.alias("svc")).distinct(), ["unit", "path"])
    m = rows.select(F.col("svc").alias("service"), "path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(CACHE), 1)).alias("a"))
    return m.groupBy("service").agg(F.min(F.struct("path", "line_no")).alias("f"), F.countDistinct("a").alias("kinds")).select("service", F.concat_ws(":", "f.path", "f.line_no").alias("place"), "kinds")


def path_constants(files: DataFrame) -> DataFrame:
    """(name, value) of string constants in files named for it, of one value in the whole repository."""
    rows = files.where(F.lower("path").rlike("constant|apipath")).select(F.explode(F.regexp_extract_all("text", F.lit(CONSTANT), 0)).alias("m"))
    return resolve.constants(rows.select(F.regexp_extract("m", CONSTANT, 1).alias("name"), F.regexp_extract("m", CONSTANT, 2).alias("value")))


#: Import statements of each language, the imported name as the group.
IMPORTS = {
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;", "kotlin": r"^\s*import\s+([\w.]+)", "scala": r"^\s*import\s+([\w.]+)",
    "python": r"^\s*(?:from\s+([.\w]+)\s+import|import\s+([.\w]+))", "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$",
    "typescript": r"""^\s*(?:import|export)\b.*?["']([^"']+)["']""", "javascript": r"""^\s*(?:import|export)\b.*?["']([^"']+)["']""",
    "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "rust": r"^\s*use\s+([\w:]+)", "php": r"^\s*use\s+([\w\\]+)\s*;",
    "ruby": r"""^\s*require(?:_relative)?\s+["']([^"']+)""", "c": r"^\s*#\s*include\s*[<\"]([^>\"]+)", "cpp": r"^\s*#\s*include\s*[<\"]([^>\"]+)",
}


def imports(files: DataFrame) -> DataFrame:
    """(unit, path, lang, line_no, name, static): what each file imports; a static import names a member of a type."""
    rows = files.where(F.col("lang").isin(*IMPORTS) & F.col("text").isNotNull()).select("unit", "path", "lang", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    name = F.lit(None).cast("string")
    for lang, p in IMPORTS.items():
        got = F.regexp_extract("line", p, 1)
        if lang == "python":
            got = F.concat(got, F.regexp_extract("line", p, 2))
        name = F.when(F.col("lang") == lang, got).otherwise(name)
    rows = rows.select("unit", "path", "lang", (F.col("p") + 1).cast("bigint").alias("line_no"), name.alias("name"), F.col("line").rlike(r"^\s*(?:import|using)\s+static\s").alias("static"))
    return rows.where("name <> ''")


def import_edges(files: DataFrame) -> DataFrame:
    """``imports`` from a file to the file that holds the named type (0.9, of a static member's type too), else to the name outside (1.0)."""
    use = imports(files).withColumn("use_id", F.concat_ws("\x01", "unit", "path", "line_no", "name"))
    type_ = F.when(F.col("static"), F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("name"))
    own = files.withColumn("id", _file_id())
    hit = views.imports(use.select("use_id", type_.alias("fqn")).distinct(), own.select("id", "path"))
    x = use.join(hit, "use_id", "left")
    outside = F.concat(F.lit("cart . external "), "name")
    e = _edges(x, "symbols", _file_id(), F.coalesce("id", outside), "imports", F.concat_ws(":", "path", "line_no"), 1.0)
    return e.where("src <> dst").withColumn("confidence", F.when(F.col("dst").startswith("cart . external "), 1.0).otherwise(0.9))


def supertypes(files: DataFrame) -> DataFrame:
    """(unit, path, lang, line_no, name, parent): the types each class extends or implements, at most eight, without their parameters.

    A declaration may go on over line breaks up to its opening brace.
    """
    decl = r"(?s)\b(?:class|interface|record|enum|struct)\s+([A-Z]\w*)\s*(?:<[^{]*?>)?\s*((?:extends|implements|:|\()[^{;]*?)(?=\{|:\s*\n|;|\z)"
    f = files.where("text IS NOT NULL").select("unit", "path", "lang", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(decl), 0))).alias("d"))
    flat = F.regexp_replace(F.regexp_extract("d", decl, 2), r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", "")
    names = F.split(F.regexp_replace(flat, r"[()]", " "), r"\bextends\b|\bimplements\b|,|:")
    parents = F.slice(F.filter(F.transform(names, lambda x: F.regexp_extract(F.trim(x), r"^(?:[a-z]\w*\.)*([A-Z]\w*)$", 1)), lambda x: x != ""), 1, 8)
    line = (F.regexp_count(F.substring("text", F.lit(1), F.instr("text", F.col("d"))), F.lit("\n")) + 1).cast("bigint")
    return f.select("unit", "path", "lang", line.alias("line_no"), F.regexp_extract("d", decl, 1).alias("name"), F.explode(parents).alias("parent")).where("name <> parent")


def supertype_edges(files: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stubs, edges): ``extends`` to the one type of the name (0.95), to the one of the own unit (0.8), else to a library stub (0.9).

    types (name, repo, id) holds classes only, so a method never answers for a type; a name with several owners elsewhere is left out.
    """
    s = supertypes(files)
    src = ids.symbol_id(F.col("unit"), F.col("lang"), F.col("path"), F.lit(None).cast("string"), F.col("name"), F.lit("class"))
    uses = s.select(F.col("parent").alias("name"), F.col("unit").alias("repo"), src.alias("src"), F.concat_ws(":", "path", "line_no").alias("at"))
    got = resolve.by_name(uses, types, 0.95, 0.8)
    stub = ids.named_id("library", F.col("name"))
    kept = got.where("state <> 'ambiguous'").withColumns({"dst": F.coalesce("id", stub), "c": F.coalesce("confidence", F.lit(0.9))})
    e = _edges(kept, "symbols", F.col("src"), F.col("dst"), "extends", F.col("at"), 1.0)
    e = e.join(kept.select("src", "dst", F.col("at").alias("evidence"), "c").distinct(), ["src", "dst", "evidence"]).withColumn("confidence", F.col("c")).drop("c")
    return _nodes(got.where("state = 'external'"), "symbols", id=stub, kind=F.lit("library"), name=F.col("name")), e


def proxies(files: DataFrame) -> DataFrame:
    """(unit, path, prefix, target, rewritten): the rules of development proxies, from JSON or module files."""
    rows = files.where(F.lower("path").rlike(r"proxy[^/]*\.(?:json|js|ts|mjs)$") & F.col("text").isNotNull())
    rule = r"(?s)[\"']?(/[\w/*.-]*)[\"']?\s*:\s*\{(.*?)\}"
    m = rows.select("unit", "path", F.explode(F.regexp_extract_all("text", F.lit(rule), 0)).alias("m"))
    body = F.regexp_extract("m", rule, 2)
    return m.select(
        "unit", "path", F.regexp_replace(F.regexp_extract("m", rule, 1), r"/?\*+$", "").alias("prefix"),
        F.regexp_extract(body, r"""target["']?\s*:\s*["']([^"']+)""", 1).alias("target"), body.contains("pathRewrite").alias("rewritten"),
    ).where("target <> ''")


def proxy_services(rules: DataFrame, services: DataFrame) -> DataFrame:
    """(unit, path, prefix, target, service): the first two parts of the prefix joined, then the first alone, else the first label of the host."""
    parts = F.filter(F.split("prefix", "/"), lambda p: p != "")
    label = F.regexp_extract("target", r"^\w+://([^.:/]+)", 1)
    tries = F.array(F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, 2), "-")), F.try_element_at(parts, F.lit(1)), label)
    t = rules.select("unit", "path", "prefix", "target", F.posexplode(tries).alias("place", "token")).where("token <> ''")
    known = resolve.resolve_tokens(t.select("token").distinct(), services)
    best = t.join(known, "token").groupBy("unit", "path", "prefix", "target").agg(F.min(F.struct("place", "service"))["service"].alias("service"))
    return rules.select("unit", "path", "prefix", "target").distinct().join(best, ["unit", "path", "prefix", "target"], "left")


def http_calls(files: DataFrame) -> DataFrame:
    """(unit, path, line_no, method, url): calls of front-end code with a path in them, outside its tests; templates keep their holes."""
    rows = _lines(files.where(F.col("lang").isin("typescript", "javascript") & ~F.col("path").rlike(r"\.(?:spec|test)\.|__tests__")))
    call = r"""(?i)\b(?:http(?:client)?|axios|api|client|\$http)\s*\.\s*(get|post|put|delete|patch)\s*(?:<[^>]*>)?\s*\(\s*["'`]([^"'`]+)["'`]"""
    fetch = r"""\bfetch\s*\(\s*["'`]([^"'`]+)["'`](?:[^)]*?method\s*:\s*["'](\w+))?"""
    made = rows.select("unit", "path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(call), 0)).alias("m")).select("unit", "path", "line_no", F.upper(F.regexp_extract("m", call, 1)).alias("method"), F.regexp_extract("m", call, 2).alias("url"))
    got = rows.select("unit", "path", "line_no", F.explode(F.regexp_extract_all("line", F.lit(fetch), 0)).alias("m"))
    got = got.select("unit", "path", "line_no", F.upper(F.coalesce(F.nullif(F.regexp_extract("m", fetch, 2), F.lit("")), F.lit("GET"))).alias("method"), F.regexp_extract("m", fetch, 1).alias("url"))
    return made.unionByName(got).where(~F.col("url").rlike(r"\.(?:svg|png|jpe?g|gif|css|js|html|ico|woff2?)(?:\?|$)") & F.col("url").contains("/"))


def call_edges(files: DataFrame, rules: DataFrame, routes: DataFrame) -> DataFrame:
    """``calls-route`` (0.95) from a front-end file to the route its call reaches through the unit's proxy rules (unit, prefix, service).

    routes (id, service, method, path) with canonical paths. A call's longest prefix tells the service; the rest of its path the route.
    """
    c = http_calls(files).withColumn("p", resolve.canonical_path(F.regexp_replace("url", r"^\w+://[^/]+", "")))
    hit = c.join(rules.where("service IS NOT NULL").select("unit", "prefix", "service").distinct(), "unit").where(F.col("p").startswith(F.col("prefix")))
    key = ["unit", "path", "line_no", "method", "p"]
    best = hit.groupBy(*key).agg(F.max(F.struct(F.length("prefix").alias("n"), "prefix", "service")).alias("b")).select(*key, "b.prefix", "b.service")
    tries = best.withColumn("call", F.concat_ws("\x01", *key)).select("call", "service", "method", F.explode(F.array_distinct(F.array(F.col("p"), F.substring("p", F.length("prefix") + 1, F.length("p"))))).alias("path"))
    met = resolve.match_routes(tries.withColumnRenamed("call", "call_id"), routes)
    k = F.split("call_id", "\x01")
    return _edges(met.select(k[0].alias("unit"), k[1].alias("path"), k[2].alias("line_no"), "id").withColumn("lang", F.when(F.col("path").rlike(r"\.tsx?$"), "typescript").otherwise("javascript")), "frontend", _file_id(), F.col("id"), "calls-route", F.concat_ws(":", "path", "line_no"), 0.95)


def reactor(poms: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modules, edges) of Maven files: a module is a service if it is packed to run (war, Boot application, application config, controller),
    else a library; aggregators (packaging pom) are neither. ``depends-on`` (1.0) where the artifact is one of the estate's."""
    root = F.regexp_replace("path", r"/?pom\.xml$", "")
    m = poms.where("packaging <> 'pom' AND artifact_id IS NOT NULL").withColumn("root", root)
    runs = F.col("text").rlike(r"@SpringBootApplication|@(?:Rest)?Controller\b") | F.col("path").rlike(r"(?:^|/)(?:application(?:-\w+)?\.(?:ya?ml|properties)|Dockerfile)$")
    marked = files.where(runs).select("unit", F.col("path").alias("file"))
    owned = resolve.longest_prefix(marked.select(F.concat_ws("/", "unit", "file").alias("path")).distinct(), m.select(F.when(F.col("root") == "", F.col("unit")).otherwise(F.concat_ws("/", "unit", "root")).alias("root"), F.concat_ws("|", "unit", "artifact_id").alias("unit")).distinct())
    live = owned.select("unit").distinct().withColumn("live", F.lit(True))
    x = m.join(live, F.concat_ws("|", m["unit"], m["artifact_id"]) == live["unit"], "left").drop(live["unit"])
    kind = F.when((F.col("packaging") == "war") | F.coalesce("live", F.lit(False)), "service").otherwise("library")
    mods = x.select("unit", "path", "artifact_id", kind.alias("kind"), "dependencies")
    nid = lambda k, n: ids.named_id(F.col(k), F.col(n))
    nodes = _nodes(mods, "maven", id=nid("kind", "artifact_id"), kind=F.col("kind"), name=F.col("artifact_id"), file=F.col("path"), repo=F.col("unit"))
    to = mods.groupBy(F.col("artifact_id").alias("dep")).agg(F.min("kind").alias("to_kind"))
    deps = mods.select("kind", "artifact_id", "path", F.explode("dependencies").alias("dep")).join(to, "dep").where("dep <> artifact_id")
    return nodes, _edges(deps, "maven", nid("kind", "artifact_id"), nid("to_kind", "dep"), "depends-on", F.col("path"), 1.0)


def changed_files(names: DataFrame, units: DataFrame) -> DataFrame:
    """(repo, rel) of changed files (checkout, path), each in the unit with the longest root: units (checkout, root, repo), root '' for the checkout itself."""
    n = names.select(F.concat_ws("/", "checkout", "path").alias("path")).distinct()
    u = units.select(F.when(F.col("root") == "", F.col("checkout")).otherwise(F.concat_ws("/", "checkout", "root")).alias("root"), F.col("repo").alias("unit"))
    hit = resolve.longest_prefix(n, u).join(u.select("unit", "root"), "unit")
    return hit.select(F.col("unit").alias("repo"), F.substring("path", F.length("root") + 2, F.length("path")).alias("rel")).distinct()
