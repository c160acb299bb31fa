"""Queries of the extractors: texts rendered from the graph are read back, so what went in is what SQL says must come out; and supplied texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import code
from terrane.model import vocab
from terrane.operators import graph, merge, resolve, views
from terrane.plans import estate_queries as base
from terrane.plans.estate_queries import GRAPH, MEMBERS
from terrane.sources import files as readers
from terrane.sources import topology

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark, sf):
            return f(base.Tables(spark, sf))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _named(t, kind: str, src: str, dst: str) -> DataFrame:
    """(a, b) names of the ends of edges of a kind between nodes of two kinds."""
    n = t.n.select("id", "kind", "name")
    a = n.where(F.col("kind") == src).select(F.col("id").alias("src"), F.col("name").alias("a"))
    b = n.where(F.col("kind") == dst).select(F.col("id").alias("dst"), F.col("name").alias("b"))
    return t.e.where(F.col("kind") == kind).join(a, "src").join(b, "dst").select("a", "b").distinct()


def _files(rows: DataFrame, unit: str, line, path: str) -> DataFrame:
    """FILE rows, one per unit: the rendered lines in order."""
    text = F.array_join(F.array_sort(F.collect_set(line)), "\n")
    return rows.groupBy(F.col(unit).alias("unit")).agg(text.alias("text")).select("unit", F.lit(path).alias("path"), F.lit("java").alias("lang"), F.length("text").cast("bigint").alias("bytes"), "text")


def _services(t) -> DataFrame:
    return t.n.where("kind = 'service'").select("name", F.col("name").alias("ord")).distinct()


def _ends(kind: str, src: str, dst: str) -> str:
    return f"SELECT DISTINCT a.name AS a, b.name AS b FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.kind = '{kind}' AND a.kind = '{src}' AND b.kind = '{dst}'"


@query(GRAPH + f""", p AS ({_ends('http', 'service', 'service')})
SELECT 'cart . service ' || a AS src, 'cart . service ' || b AS dst, 'http' AS kind, CASE length(b) % 5 WHEN 0 THEN 0.85 WHEN 1 THEN 0.9 ELSE 0.95 END::DOUBLE AS confidence FROM p WHERE a <> b""")
def links_read_from_config(t):
    """Each http link rendered as a variable, a URL, a discovery address, an in-cluster name or a declarative client, and read back."""
    b, n = F.col("b"), F.length("b") % 5
    line = (
        F.when(n == 0, F.concat(F.upper(F.translate(b, "-", "_")), F.lit("_URL=x"))).when(n == 1, F.concat(F.lit("base: http://"), b, F.lit(":8080/api")))
        .when(n == 2, F.concat(F.lit("uri: lb://"), b)).when(n == 3, F.concat(F.lit("at: "), b, F.lit(".prod.svc"))).otherwise(F.concat(F.lit('@FeignClient(name = "'), b, F.lit('")')))
    )
    files = _files(_named(t, "http", "service", "service"), "a", line, "src/main/resources/application.yml")
    return topology.sync(files, _services(t), F.col("unit"))[0].select("src", "dst", "kind", "confidence")


@query(GRAPH + f""", p AS ({_ends('produces', 'service', 'topic')}), c AS ({_ends('consumed-by', 'topic', 'service')})
SELECT 'cart . service ' || a AS src, 'cart . topic ' || b AS dst, 'produces' AS kind FROM p UNION ALL SELECT 'cart . topic ' || a, 'cart . service ' || b, 'consumed-by' FROM c
UNION ALL SELECT DISTINCT 'cart . service ' || p.a, 'cart . service ' || c.b, 'event' FROM p JOIN c ON p.b = c.a WHERE p.a <> c.b AND p.b IN (SELECT a FROM c)""")
def messages_read_from_code(t):
    """Sends and listeners rendered from the graph, and read back with the events between their services."""
    send = _named(t, "produces", "service", "topic").select("a", F.concat(F.lit('    kafkaTemplate.send("'), "b", F.lit('", order);')).alias("line"))
    hear = _named(t, "consumed-by", "topic", "service").select(F.col("b").alias("a"), F.concat(F.lit('    @KafkaListener(topics = "'), "a", F.lit('", groupId = "x")')).alias("line"))
    files = _files(send.unionByName(hear), "a", F.col("line"), "src/main/java/Topics.java")
    return topology.asynchronous(topology.messages(files), files, F.col("unit"))[1].groupBy("src", "dst", "kind").agg(F.lit(1)).select("src", "dst", "kind")


@query(GRAPH + f""", p AS ({_ends('produces', 'service', 'topic')}), c AS ({_ends('consumed-by', 'topic', 'service')}), k AS (SELECT DISTINCT b FROM p UNION SELECT DISTINCT a FROM c)
SELECT a AS unit, b AS topic, 'produce' AS way FROM p WHERE b IN (FROM k) UNION SELECT b, a, 'consume' FROM c""")
def messages_read_by_constant(t):
    """The same by constants: declared in one file, listened to over several lines, sent by name."""
    upper = lambda c: F.concat(F.lit("T_"), F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "_")))
    p, c = _named(t, "produces", "service", "topic"), _named(t, "consumed-by", "topic", "service")
    send = p.select("a", F.concat(F.lit("    bus.send(Topics."), upper("b"), F.lit(", order);")).alias("line"))
    hear = c.select(F.col("b").alias("a"), F.concat(F.lit("    @KafkaListener(\n        topics = Topics."), upper("a"), F.lit(",\n        groupId = name(1))")).alias("line"))
    said = p.select(F.col("b").alias("x")).unionByName(c.select(F.col("a").alias("x"))).distinct().select(F.lit("shared").alias("a"), F.concat(F.lit("  public static final String "), upper("x"), F.lit(' = "'), "x", F.lit('";')).alias("line"))
    files = _files(send.unionByName(hear), "a", F.col("line"), "src/main/java/Use.java").unionByName(_files(said, "a", F.col("line"), "src/main/java/Topics.java"))
    return topology.constant_messages(files).select("unit", "topic", "way").distinct()


@query(GRAPH + f""", p AS ({_ends('writes-table', 'service', 'table')}), s AS (SELECT a, 'postgres://db-' || lower(split_part(b, '_', 1)) || '/main' AS store FROM p)
SELECT 'cart . datastore ' || store AS id, count(DISTINCT a) AS services FROM s GROUP BY store HAVING count(DISTINCT a) > 1""")
def shared_datastores(t):
    """Data sources rendered from who writes which family of tables; those that several services use."""
    line = F.concat(F.lit("url: jdbc:postgresql://DB-"), F.split("b", "_")[0], F.lit(":5432/main"))
    files = _files(_named(t, "writes-table", "service", "table"), "a", line, "src/main/resources/application.properties")
    return topology.shared_stores(topology.stores(files, F.col("unit"))[1])


@query(GRAPH + f""", p AS ({_ends('http', 'service', 'service')}), x AS (SELECT a, CASE WHEN length(b) % 2 = 0 THEN 'Cacheable' ELSE 'CachePut' END AS k, min(b) AS b FROM p GROUP BY 1, 2)
SELECT a AS service, 'src/main/java/Cache.java:1' AS place, count(DISTINCT k) AS kinds FROM x GROUP BY a""")
def cache_use(t):
    line = F.concat(F.when(F.length("b") % 2 == 0, "    @Cacheable(").otherwise("    @CachePut("), F.lit('"'), "b", F.lit('")'))
    return topology.caches(_files(_named(t, "http", "service", "service"), "a", line, "src/main/java/Cache.java"), F.col("unit"))


@query(GRAPH + f""", p AS ({_ends('http', 'service', 'service')}) SELECT DISTINCT a AS unit, '/' || replace(b, '-', '/') || '/v1' AS prefix, b AS service FROM p WHERE len(string_split(b, '-')) = 2""")
def proxy_targets(t):
    """Proxy rules rendered from links to services of two words, and resolved by the first two parts of their prefix."""
    p = _named(t, "http", "service", "service").where("size(split(b, '-')) = 2")
    rule = F.concat(F.lit('"/'), F.translate("b", "-", "/"), F.lit('/v1/*": {"target": "http://gate:80", "secure": false}'))
    text = p.groupBy(F.col("a").alias("unit")).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_set(rule)), ",\n"), F.lit("}")).alias("text"))
    files = text.select("unit", F.lit("web/proxy.conf.json").alias("path"), F.lit("other").alias("lang"), "text")
    return topology.proxy_services(topology.proxies(files), _services(t)).select("unit", "prefix", "service")


@query(GRAPH + """, r AS (SELECT id, service, split_part(name, ' ', 1) AS method, split_part(name, ' ', 2) AS path FROM n WHERE kind = 'route' AND contains(name, ' ') AND service IS NOT NULL)
SELECT service || '-ui' AS unit, min(id) AS id FROM r WHERE method IN ('GET', 'POST', 'PUT', 'DELETE', 'PATCH') GROUP BY service, method, regexp_replace(regexp_replace(path, '/[0-9]+(/|$)', '/{}\\1', 'g'), '(.)/+$', '\\1')""".replace("\\\\", "\\"))
def front_end_calls(t):
    """Each route called from a rendered front end behind a proxy prefix, and matched to it again."""
    r = t.n.where("kind = 'route' AND contains(name, ' ') AND service IS NOT NULL").select("id", "service", F.split("name", " ")[0].alias("method"), F.split("name", " ")[1].alias("raw"))
    r = r.where("method IN ('GET', 'POST', 'PUT', 'DELETE', 'PATCH')").withColumn("path", resolve.canonical_path(F.col("raw")))
    unit = F.concat("service", F.lit("-ui"))
    line = F.concat(F.lit("  return this.http."), F.lower("method"), F.lit("<Row[]>('/p"), "raw", F.lit("?q=1')"))
    text = r.groupBy(unit.alias("unit")).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("text"))
    files = text.select("unit", F.lit("src/app/row.service.ts").alias("path"), F.lit("typescript").alias("lang"), "text")
    rules = r.select(unit.alias("unit"), F.lit("/p").alias("prefix"), "service").distinct()
    return topology.call_edges(files, rules, r.select("id", "service", "method", "path")).select(F.split("src", " ")[1].alias("unit"), F.col("dst").alias("id")).distinct()


HEAD_LANG = "CASE regexp_extract(path, '\\.([A-Za-z]+)$', 1) WHEN 'java' THEN 'java' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'cs' THEN 'csharp' END".replace("\\\\", "\\")


def _heads(t) -> DataFrame:
    ext = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)
    lang = vocab.lookup({"java": "java", "py": "python", "go": "go", "ts": "typescript", "tsx": "typescript", "cs": "csharp"}, ext)
    return t.file_heads.select(F.col("repo").alias("unit"), "path", lang.alias("lang"), F.col("n_bytes").alias("bytes"), F.col("head").alias("text")).where("lang IS NOT NULL")


@query(rf"""WITH l AS (SELECT repo AS unit, path, {HEAD_LANG} AS lang, unnest(string_split(head, chr(10))) AS line, generate_subscripts(string_split(head, chr(10)), 1) AS line_no FROM file_heads WHERE head IS NOT NULL),
x AS (SELECT unit, path, line_no, CASE lang WHEN 'java' THEN regexp_extract(line, '^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;', 1) WHEN 'python' THEN coalesce(nullif(regexp_extract(line, '^\s*from\s+([.\w]+)\s+import', 1), ''), regexp_extract(line, '^\s*import\s+([.\w]+)', 1))
  WHEN 'go' THEN regexp_extract(line, '^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$', 1) WHEN 'typescript' THEN regexp_extract(line, '^\s*(?:import|export)\b.*?["\x27]([^"\x27]+)["\x27]', 1) WHEN 'csharp' THEN regexp_extract(line, '^\s*using\s+(?:static\s+)?([\w.]+)\s*;', 1) END AS name FROM l)
SELECT unit, path, line_no, name FROM x WHERE name <> ''""")
def imports_read(t):
    """Imports in the supplied heads of five languages."""
    return topology.imports(_heads(t)).select("unit", "path", "line_no", "name")


@query(rf"""WITH l AS (SELECT repo AS unit, path, {HEAD_LANG} AS lang, unnest(string_split(head, chr(10))) AS line, generate_subscripts(string_split(head, chr(10)), 1) AS line_no FROM file_heads WHERE head IS NOT NULL),
x AS (SELECT unit, path, line_no, lang, CASE lang WHEN 'java' THEN regexp_extract(line, '\b(?:class|interface|enum|record)\s+([A-Z]\w*)', 1) WHEN 'python' THEN regexp_extract(line, '^\s*class\s+(\w+)', 1) WHEN 'go' THEN regexp_extract(line, '^type\s+(\w+)\s+(?:struct|interface)', 1)
   WHEN 'typescript' THEN regexp_extract(line, '\bclass\s+(\w+)', 1) WHEN 'csharp' THEN regexp_extract(line, '\b(?:class|interface|struct|record)\s+(\w+)', 1) ELSE '' END AS c,
  CASE lang WHEN 'python' THEN regexp_extract(line, '^\s*(?:async\s+)?def\s+(\w+)', 1) WHEN 'go' THEN regexp_extract(line, '^func\s+(?:\([^)]*\)\s*)?(\w+)', 1) WHEN 'typescript' THEN regexp_extract(line, '\bfunction\s+(\w+)', 1) ELSE '' END AS f FROM l)
SELECT unit, path, line_no AS line, CASE WHEN c <> '' THEN 'class' ELSE 'function' END AS kind, CASE WHEN c <> '' THEN c ELSE f END AS name FROM x WHERE (c <> '' OR f <> '') AND NOT (lang IN ('java', 'csharp') AND c = '')""")
def definitions_read(t):
    """Classes and functions in the supplied heads; heads end before the first Java or C# method."""
    return readers.definitions(_heads(t)).where("NOT (lang IN ('java', 'csharp') AND kind = 'function')").select("unit", "path", "line", "kind", "name")


@query(GRAPH + """, c AS (SELECT DISTINCT repo, name FROM n WHERE kind = 'class' AND regexp_matches(name, '^[A-Z][A-Za-z0-9_]*$') AND repo IS NOT NULL AND name NOT IN ('Base', 'Readable', 'Marker'))
SELECT repo AS unit, name, unnest(['Base', 'Readable', 'Marker']) AS parent FROM c""")
def supertypes_read(t):
    """Declarations rendered from the classes of the graph, over two lines and with type parameters, and read back."""
    c = t.n.where("kind = 'class' AND repo IS NOT NULL").where(F.col("name").rlike("^[A-Z][A-Za-z0-9_]*$")).select("repo", "name").distinct()
    line = F.concat(F.lit("public class "), "name", F.lit("<T extends Number> extends io.x.Base<Map<K, V>>\n    implements Readable, Marker<T> {\n}\n"))
    text = c.select(F.col("repo").alias("unit"), F.concat("name", F.lit(".java")).alias("path"), F.lit("java").alias("lang"), line.alias("text"))
    return topology.supertypes(text).select("unit", "name", "parent")


@query(GRAPH + """SELECT DISTINCT repo, file, CASE WHEN len(p) > 3 AND p[1] = 'src' THEN p[2] WHEN list_contains(p, 'internal') AND list_position(p, 'internal') + 1 < len(p) THEN p[list_position(p, 'internal') + 1] ELSE repo END AS module
FROM (SELECT repo, file, string_split(file, '/') AS p FROM n WHERE kind = 'file' AND repo IS NOT NULL AND NOT list_contains(string_split(file, '/')[2:], 'src')) WHERE NOT (p[1] = 'src' AND len(p) <= 3) """)
def module_owners(t):
    """The module of a file: the part of its path after an anchor, else its repo."""
    n = t.n.where("kind = 'file' AND repo IS NOT NULL").where("NOT array_contains(slice(split(file, '/'), 2, size(split(file, '/'))), 'src') AND NOT (split(file, '/')[0] = 'src' AND size(split(file, '/')) <= 3)")
    return n.select("repo", "file", resolve.module_of(F.col("file"), ("src", "internal"), F.col("repo")).alias("module")).distinct()


@query(GRAPH + """SELECT id, '/api/v1/' || array_to_string(list_filter(string_split(split_part(name, ' ', 2), '/'), lambda x: x <> ''), '/') AS route FROM n WHERE kind = 'route' AND contains(name, ' ')""")
def routes_composed(t):
    return t.n.where("kind = 'route' AND contains(name, ' ')").select("id", views.route_of(F.lit("//api/v1/"), F.split("name", " ")[1]).alias("route"))


@query(GRAPH + """SELECT id, CASE WHEN length(name) % 3 > 0 THEN name || '/x' END AS value FROM n WHERE kind = 'library'""")
def constants_substituted(t):
    """``NAME + "/x"`` for each library; a third of the names are not declared, so their values stay open."""
    lib = t.n.where("kind = 'library'").withColumn("key", F.upper(F.regexp_replace("name", "[^A-Za-z0-9]", "_")))
    known = lib.where("length(name) % 3 > 0").groupBy(F.col("key").alias("name")).agg(F.min("name").alias("value"))
    return views.substitute(lib.select("id", F.concat(F.lit("Paths."), "key", F.lit(' + "/x"')).alias("expr")), known)


ARROW = """, r AS (SELECT a.grp AS s, b.grp AS t, count(*) AS c FROM e JOIN g a ON a.id = e.src JOIN g b ON b.id = e.dst WHERE a.grp <> b.grp GROUP BY 1, 2 ORDER BY c DESC, s, t LIMIT 1)"""


@query(GRAPH + MEMBERS + ARROW + """ SELECT src, dst, e.kind, evidence, provenance, confidence FROM e JOIN g a ON a.id = e.src JOIN g b ON b.id = e.dst JOIN r ON r.s = a.grp AND r.t = b.grp
ORDER BY (provenance <> 'EXTRACTED')::INT, confidence DESC, src, dst, kind, evidence LIMIT 300""")
def arrow_expanded(t):
    """The edges behind the thickest arrow of the estate view: the limit is the feature."""
    m = t.members
    r = graph.rollup(t.e, m).groupBy("source", "target").agg(F.sum("count").alias("c")).orderBy(F.col("c").desc(), "source", "target").first()
    return graph.expand(t.e, m, r["source"], r["target"])


@query(GRAPH + """, v AS (SELECT min(repo) AS repo FROM repos), o AS (SELECT id FROM n WHERE repo IN (FROM v)), x AS (SELECT src AS id FROM e WHERE dst IN (FROM o) UNION SELECT dst FROM e WHERE src IN (FROM o))
SELECT id FROM o UNION ALL SELECT id FROM n WHERE repo IS NULL AND id IN (FROM x)""")
def one_repo(t):
    return views.of_repos(t.n, t.e, t.repos.agg(F.min("repo").alias("repo")))


DEG = ", dg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)"


def _degree_ranks(t) -> DataFrame:
    """Degrees as ranks: whole numbers, so that sums are the same everywhere."""
    return graph.degrees(t.e).select("id", F.col("degree").cast("double").alias("rank"))


@query(GRAPH + DEG + """ SELECT 'global' AS kind, id, CAST(d AS DOUBLE) AS rank FROM dg UNION ALL SELECT 'seeded', id, CAST(d AS DOUBLE) * 2 FROM dg WHERE d > 3""")
def ranks_upserted(t):
    """A new set of seeded ranks replaces the old one; the global ranks of the same nodes stay."""
    r = _degree_ranks(t)
    old = r.withColumn("kind", F.lit("global")).unionByName(r.withColumn("kind", F.lit("seeded")))
    return merge.upsert_ranks(old, r.where("rank > 3").select(F.lit("seeded").alias("kind"), "id", (F.col("rank") * 2).alias("rank")))


@query(GRAPH + """, g AS (SELECT DISTINCT kind AS category, dst AS detail FROM e) SELECT category, detail FROM g QUALIFY row_number() OVER (PARTITION BY category ORDER BY detail) <= CASE category WHEN 'extends' THEN 200 WHEN 'calls' THEN 500 ELSE 1000000000 END""")
def findings_capped(t):
    """Targets of edges stand for findings: 200 of supertypes and 500 of calls are kept, all of the rest; the cap is the feature."""
    return views.capped(t.e.select(F.col("kind").alias("category"), F.col("dst").alias("detail")), {"extends": 200, "calls": 500})


@query(GRAPH + DEG + """, f AS (SELECT n.repo, n.file, max(coalesce(d, 0)) AS own FROM n LEFT JOIN dg USING (id) WHERE kind = 'file' AND repo IS NOT NULL AND file IS NOT NULL GROUP BY 1, 2),
s AS (SELECT n.repo, n.file, n.name, coalesce(d, 0) AS d, row_number() OVER (PARTITION BY n.repo, n.file ORDER BY coalesce(d, 0) DESC, n.id) AS p FROM n LEFT JOIN dg USING (id) WHERE kind IN ('class', 'function') AND repo IS NOT NULL AND file IS NOT NULL),
k AS (SELECT repo, file, sum(d) AS t, string_agg(name, ',' ORDER BY p) FILTER (WHERE p <= 12) AS names FROM s GROUP BY 1, 2)
SELECT repo, file, CAST(0.5 * coalesce(own, 0) + coalesce(t, 0) AS DOUBLE) AS score, coalesce(names, '') AS names FROM f FULL JOIN k USING (repo, file)""")
def repo_map(t):
    return views.repo_map(t.n, _degree_ranks(t))


@query(GRAPH + DEG + """, s AS (SELECT coalesce(service, repo) AS s FROM n WHERE file IS NOT NULL AND coalesce(service, repo) IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""" + base.PK.replace("k0 AS (SELECT *,", "k0 AS (SELECT n.*,") + f""",
q AS (SELECT {base._pkg(3)} AS package, count(DISTINCT file) AS files, CAST(sum(coalesce(d, 0)) AS DOUBLE) AS rank FROM k LEFT JOIN dg USING (id) WHERE file IS NOT NULL AND coalesce(service, repo) IN (FROM s) GROUP BY 1)
SELECT package, files, rank, greatest((SELECT count(*) FROM q) - 5, 0) AS left_out FROM q ORDER BY rank DESC, package LIMIT 5""")
def package_nodes(t):
    """The five best packages of the largest service: the limit is the feature."""
    own = t.n.where("file IS NOT NULL").groupBy(F.coalesce("service", "repo").alias("s")).agg(F.count("*").alias("c")).where("s IS NOT NULL").orderBy(F.col("c").desc(), "s").first()
    return views.package_nodes(t.n, _degree_ranks(t), own["s"], 3, 5)


@query("""SELECT DISTINCT subject, substr(regexp_replace(lower(string_split(subject, '\u2014')[1]), '[^a-z0-9]', '', 'g'), 1, 70) AS key FROM commits WHERE subject IS NOT NULL""".replace("\\u2014", "\u2014"))
def question_keys(t):
    return t.commits.where("subject IS NOT NULL").select("subject", views.question_key(F.col("subject")).alias("key")).distinct()


@query("""WITH x AS (SELECT event_id, CAST(epoch(TIMESTAMP '2026-07-01') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age FROM x""")
def event_ages(t):
    return t.events.select("event_id", views.age(F.col("ts"), F.lit("2026-07-01").cast("timestamp_ntz")).alias("age"))


@query("""SELECT DISTINCT '{"calls":"' || json_extract_string(extra, '$.calls') || '","runtime":"' || json_extract_string(extra, '$.runtime') || '"}' AS extra FROM edges WHERE json_extract_string(extra, '$.calls') IS NOT NULL AND json_extract_string(extra, '$.runtime') IS NOT NULL""")
def extras_sorted(t):
    e = t.edges.where("get_json_object(extra, '$.calls') IS NOT NULL AND get_json_object(extra, '$.runtime') IS NOT NULL")
    return e.select(views.sorted_json(F.col("extra")).alias("extra")).distinct()


@query(r"""WITH w AS (SELECT DISTINCT subject, regexp_extract_all(subject, '([A-Za-z_][A-Za-z0-9_]{2,})', 1) AS ws FROM commits WHERE subject IS NOT NULL AND NOT regexp_matches(subject, '[a-z0-9][A-Z]') AND NOT regexp_matches(subject, '[A-Z]{2}') AND NOT contains(subject, '_'))
SELECT subject, w AS term FROM (SELECT subject, unnest(ws) AS w FROM w) WHERE lower(w) NOT IN (""" + ", ".join(f"'{x}'" for x in vocab.TASK_STOP) + """) GROUP BY subject, w QUALIFY row_number() OVER (PARTITION BY subject, lower(w) ORDER BY w) = 1""")
def task_terms(t):
    """Words of subjects that may be names; those with camel case in them have no short SQL and are tested apart."""
    s = t.commits.where("subject IS NOT NULL").where(~F.col("subject").rlike("[a-z0-9][A-Z]") & ~F.col("subject").rlike("[A-Z]{2}") & ~F.col("subject").contains("_")).select("subject").distinct()
    return s.select("subject", F.explode(code.task_terms(F.col("subject"))).alias("term"))
