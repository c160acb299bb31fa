"""Queries over documents and events: scalar functions, resolution and traces, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.functions import code
from terrane.model import vocab
from terrane.operators import history, resolve
from terrane.plans import estate_queries as base
from terrane.sources import traces

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


NOISE = ", ".join(f"'{x}'" for x in code.CALL_NOISE + code.KEYWORDS)
NOT_TABLES = ", ".join(f"'{x}'" for x in vocab.NOT_TABLES)


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, '{code.BRANCH}')) AS complexity FROM documents WHERE text IS NOT NULL""")
def complexity(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", code.complexity(F.col("text")).cast("bigint").alias("complexity"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\b([A-Za-z_][A-Za-z0-9_]{{2,}})\s*\(', 1)) AS name FROM l WHERE NOT regexp_matches(line, '{code.IMPORT_LINE}'))
SELECT doc_id, name, min(line_no) AS line_no FROM h WHERE name NOT IN ({NOISE}) GROUP BY doc_id, name""")
def call_names(t):
    return code.call_sites(t.documents)


SQLTEXT = r"regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '\s+', ' ', 'g')"
I = code.IDENT


@query(rf"""WITH s AS (SELECT doc_id, {SQLTEXT} AS q FROM documents WHERE regexp_matches(text, '(?i)\b(select|insert|update|delete)\b')),
w0 AS (SELECT doc_id, unnest(regexp_extract_all(q, '(?i)\bINSERT INTO {I}', 1) || regexp_extract_all(q, '(?i)\bDELETE FROM {I}', 1) || regexp_extract_all(q, '(?i)\bUPDATE {I} SET\b', 1)) AS x FROM s),
r0 AS (SELECT doc_id, unnest(regexp_extract_all(q, '(?i)\b(?:FROM|JOIN) {I}', 1)) AS x FROM s),
w AS (SELECT DISTINCT doc_id, upper(x) AS table_name FROM w0 WHERE length(x) > 1 AND lower(x) NOT IN ({NOT_TABLES})), r AS (SELECT DISTINCT doc_id, upper(x) AS table_name FROM r0 WHERE length(x) > 1 AND lower(x) NOT IN ({NOT_TABLES}))
SELECT doc_id, table_name, 'write' AS mode FROM w UNION ALL SELECT doc_id, table_name, 'read' FROM r WHERE (doc_id, table_name) NOT IN (SELECT (doc_id, table_name) FROM w)""")
def sql_tables(t):
    return code.sql_tables(t.documents)


@query(rf"""SELECT DISTINCT doc_id, upper(unnest(regexp_extract_all({SQLTEXT}, '(?i)\bCREATE TABLE (?:IF NOT EXISTS )?{I}', 1))) AS table_name FROM documents WHERE regexp_matches(text, '(?i)create table')""")
def sql_declared(t):
    return code.declared_tables(t.documents)


@query(r"""WITH t AS (SELECT repo || '/' || path AS doc_id, head AS text FROM file_heads UNION ALL SELECT CAST(doc_id AS VARCHAR), 'see http://' || coalesce(repo, 'localhost') || '.internal:8080/x?y=' || doc_id FROM documents),
h AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, 'https?://([A-Za-z0-9_.-]+)', 1))) AS host FROM t WHERE contains(text, '://'))
SELECT doc_id, host FROM h WHERE host NOT IN (%s) AND NOT regexp_matches(host, '^[0-9.]+$')""" % ", ".join(f"'{h}'" for h in code.NOISE_HOSTS))
def url_hosts(t):
    """Hosts in the heads of files, and in a line made of each document's repo."""
    made = F.concat(F.lit("see http://"), F.coalesce("repo", F.lit("localhost")), F.lit(".internal:8080/x?y="), F.col("doc_id").cast("string"))
    heads = t.file_heads.select(F.concat("repo", F.lit("/"), "path").alias("doc_id"), F.col("head").alias("text"))
    return code.url_hosts(heads.unionByName(t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), made.alias("text"))))


@query(r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([a-z]+(?:\.[a-z]+){2,4})', 1)) AS topic FROM documents")
def topic_mentions(t):
    return code.topic_names(t.documents)


@query(r"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents UNION ALL SELECT repo || '/' || path, coalesce(head, '') || chr(10) || 'db.password=' || path || chr(10) || 'user: x' FROM file_heads),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM t WHERE text IS NOT NULL)
SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '(?i)(password|passwd|secret|api_?key|access_?token|private_?key)\s*[:=]\s*["\x27]?[^\s"\x27]{6,}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----')""")
def credential_locations(t):
    """Places, never values: of the documents, and of file heads with a made line, as the supplied texts hold no credential."""
    made = F.concat(F.coalesce("head", F.lit("")), F.lit("\ndb.password="), "path", F.lit("\nuser: x"))
    heads = t.file_heads.select(F.concat("repo", F.lit("/"), "path").alias("doc_id"), made.alias("text"))
    return code.secret_places(t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(heads))


@query("SELECT doc_id, CAST(floor(length(text) / CAST(3.6 AS DOUBLE)) + 1 AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", code.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH f AS (SELECT repo || '/' || path AS path, max(hotspot) AS score, CAST(floor(max(loc) * 30 / CAST(3.6 AS DOUBLE)) + 1 AS BIGINT) AS tokens FROM file_metrics WHERE loc IS NOT NULL AND hotspot IS NOT NULL GROUP BY 1),
r AS (SELECT path, score, tokens, CAST(sum(tokens) OVER (ORDER BY score DESC, path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, row_number() OVER (ORDER BY score DESC, path) AS p FROM f)
SELECT path, score, tokens, running FROM r WHERE running <= 4000 OR p = 1""")
def token_budget_map(t):
    f = t.file_metrics.where("loc IS NOT NULL AND hotspot IS NOT NULL").groupBy(F.concat("repo", F.lit("/"), "path").alias("path"))
    f = f.agg(F.max("hotspot").alias("score"), (F.floor(F.max("loc") * 30 / F.lit(3.6)) + 1).cast("bigint").alias("tokens"))
    return code.budget(f, 4000)


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def content_hash(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("hash"))


CANON = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[?#].*$', ''), '\$\{{[^}}]*\}}', '{{}}', 'g'), '\{{[^}}]*\}}', '{{}}', 'g'), '/[0-9]+(/|$)', '/{{}}\1', 'g'), '/[0-9]+(/|$)', '/{{}}\1', 'g'), '/{{2,}}', '/', 'g'), '(.)/+$', '\1')"


@query(base.GRAPH + f"SELECT id, CASE WHEN c = '' THEN '/' ELSE c END AS canon FROM (SELECT id, {CANON.format('split_part(name, chr(32), 2)')} AS c FROM n WHERE kind = 'route' AND contains(name, ' '))")
def url_canon(t):
    return t.n.where("kind = 'route' AND contains(name, ' ')").select("id", resolve.canonical_path(F.element_at(F.split("name", " "), 2)).alias("canon"))


@query(base.GRAPH + f""", r AS (SELECT id, service, split_part(name, ' ', 1) AS method, {CANON.format("split_part(name, ' ', 2)")} AS path FROM n WHERE kind = 'route' AND contains(name, ' ') AND service IS NOT NULL),
c AS (SELECT id AS call_id, service, CASE WHEN hash_len % 2 = 0 THEN method ELSE 'PATCH' END AS method, path FROM (SELECT *, length(path) AS hash_len FROM r)),
x AS (SELECT c.call_id, r.id, 1 AS priority FROM c JOIN r ON r.service = c.service AND r.method = c.method AND r.path = c.path UNION ALL SELECT c.call_id, r.id, 2 FROM c JOIN r ON r.service = c.service AND r.method = 'ANY' AND r.path = c.path
 UNION ALL SELECT c.call_id, r.id, 3 FROM c JOIN r ON r.service = c.service AND r.method = c.method AND r.path = c.path || '/{{}}' UNION ALL SELECT c.call_id, r.id, 4 FROM c JOIN r ON r.service = c.service AND r.method = 'ANY' AND r.path = c.path || '/{{}}')
SELECT call_id, id, priority FROM x QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY priority, id) = 1""")
def route_match(t):
    r = t.n.where("kind = 'route' AND contains(name, ' ') AND service IS NOT NULL").select("id", "service", F.element_at(F.split("name", " "), 1).alias("method"), resolve.canonical_path(F.element_at(F.split("name", " "), 2)).alias("path"))
    calls = r.select(F.col("id").alias("call_id"), "service", F.when(F.length("path") % 2 == 0, F.col("method")).otherwise("PATCH").alias("method"), "path")
    return resolve.match_routes(calls, r)


RESOLVE = """, d AS (SELECT name, repo, id FROM n WHERE kind = '{kind}' AND repo IS NOT NULL), u AS (SELECT DISTINCT b.name, a.repo FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.kind = '{edge}' AND a.repo IS NOT NULL),
g AS (SELECT name, count(*) AS n, min(id) AS o FROM d GROUP BY name), r AS (SELECT name, repo, count(*) AS n, min(id) AS o FROM d GROUP BY name, repo)
SELECT u.name, u.repo, CASE WHEN g.n = 1 THEN g.o WHEN r.n = 1 THEN r.o END AS id, CASE WHEN g.n = 1 THEN {one} WHEN r.n = 1 THEN {local} END AS confidence,
CASE WHEN g.n = 1 OR r.n = 1 THEN 'resolved' WHEN g.n > 1 THEN 'ambiguous' ELSE 'external' END AS state FROM u LEFT JOIN g USING (name) LEFT JOIN r ON r.name = u.name AND r.repo = u.repo"""


def _uses(t, edge: str, kind: str, one: float, local: float):
    n = t.n.where("repo IS NOT NULL")
    u = t.e.where(F.col("kind") == edge).join(n.select(F.col("id").alias("src"), "repo"), "src").join(t.n.select(F.col("id").alias("dst"), "name"), "dst").select("name", "repo").distinct()
    return resolve.by_name(u, n.where(F.col("kind") == kind).select("name", "repo", "id"), one, local)


@query(base.GRAPH + RESOLVE.format(kind="function", edge="calls", one="CAST(0.65 AS DOUBLE)", local="CAST(0.55 AS DOUBLE)"))
def resolve_calls(t):
    return _uses(t, "calls", "function", 0.65, 0.55)


@query(base.GRAPH + RESOLVE.format(kind="class", edge="extends", one="CAST(0.95 AS DOUBLE)", local="CAST(0.8 AS DOUBLE)"))
def resolve_supertypes(t):
    return _uses(t, "extends", "class", 0.95, 0.8)


@query(base.GRAPH + """, f AS (SELECT DISTINCT repo || '/' || file AS path FROM n WHERE kind = 'file'), u AS (SELECT DISTINCT repo || '/' || regexp_extract(file, '^([^/]+)/', 1) AS root FROM n WHERE kind = 'file' UNION SELECT DISTINCT repo FROM n WHERE kind = 'file')
SELECT path, root AS unit FROM f JOIN u ON path = root OR starts_with(path, root || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) = 1""")
def longest_prefix(t):
    n = t.n.where("kind = 'file'")
    roots = n.select(F.concat("repo", F.lit("/"), F.regexp_extract("file", "^([^/]+)/", 1)).alias("root")).unionByName(n.select(F.col("repo").alias("root"))).distinct()
    return resolve.longest_prefix(n.select(F.concat("repo", F.lit("/"), "file").alias("path")).distinct(), roots.withColumn("unit", F.col("root")))


@query(r"""WITH s AS (SELECT service AS name, min(repo) AS ord FROM repos WHERE service IS NOT NULL GROUP BY service), k AS (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, min({'o': ord, 'n': name}).n AS service FROM s GROUP BY 1),
t AS (SELECT DISTINCT unnest([upper(replace(service, '-', '_')), replace(service, '-', ' '), 'x.' || service || '.y']) AS token FROM repos WHERE service IS NOT NULL)
SELECT token, k.service FROM t JOIN k ON k.key = regexp_replace(lower(token), '[^a-z0-9]', '', 'g')""")
def service_aliases(t):
    """Names of services met in other spellings, of which those that say the whole name resolve to it."""
    s = t.repos.where("service IS NOT NULL").groupBy(F.col("service").alias("name")).agg(F.min("repo").alias("ord"))
    forms = F.array(F.upper(F.translate("service", "-", "_")), F.translate("service", "-", " "), F.concat(F.lit("x."), "service", F.lit(".y")))
    tokens = t.repos.where("service IS NOT NULL").select(F.explode(forms).alias("token")).distinct()
    return resolve.resolve_tokens(tokens, s)


@query("""WITH r AS (SELECT DISTINCT lang AS name, source AS value FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL UNION SELECT source, repo FROM documents WHERE source IS NOT NULL AND repo IS NOT NULL)
SELECT name, min(value) AS value FROM r GROUP BY name HAVING count(DISTINCT value) = 1""")
def single_valued_constants(t):
    d = t.documents
    rows = d.where("lang IS NOT NULL AND source IS NOT NULL").select(F.col("lang").alias("name"), F.col("source").alias("value")).unionByName(d.where("source IS NOT NULL AND repo IS NOT NULL").select(F.col("source").alias("name"), F.col("repo").alias("value")))
    return resolve.constants(rows)


@query("""WITH c AS (SELECT 'svc-' || (user_id % 40) AS client, 'svc-' || (event_id % 40) AS server, CAST(1 AS DOUBLE) AS calls, CASE WHEN event_type = 'error' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS errors FROM events),
r AS (SELECT CASE WHEN CAST(client[5:] AS INT) < 20 THEN 'team-' || (CAST(client[5:] AS INT) % 10) ELSE client END AS client, CASE WHEN CAST(server[5:] AS INT) < 20 THEN 'team-' || (CAST(server[5:] AS INT) % 10) ELSE server END AS server, calls, errors FROM c)
SELECT client, server, sum(calls) AS calls, sum(errors) AS errors, round(sum(errors) / sum(calls), 4) AS error_rate FROM r WHERE client <> server GROUP BY client, server""")
def trace_merge(t):
    """Calls between names of which half are aliases, two to a service."""
    e = t.events.select(F.concat(F.lit("svc-"), (F.col("user_id") % 40).cast("string")).alias("client"), F.concat(F.lit("svc-"), (F.col("event_id") % 40).cast("string")).alias("server"), F.lit(1.0).alias("calls"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("errors"))
    aliases = t.spark.range(20).select(F.concat(F.lit("svc-"), F.col("id").cast("string")).alias("token"), F.concat(F.lit("team-"), (F.col("id") % 10).cast("string")).alias("service"))
    return traces.merge(e, aliases)


@query(r"""WITH p AS (SELECT DISTINCT path FROM (SELECT unnest(files).path AS path FROM commits) WHERE contains(path, ' => '))
SELECT path, CASE WHEN regexp_matches(path, '\{[^{}]* => [^{}]*\}') THEN regexp_replace(regexp_replace(regexp_replace(path, '\{[^{}]* => ([^{}]*)\}', '\1', 'g'), '/{2,}', '/', 'g'), '^/', '') ELSE regexp_extract(path, ' => (.*)$', 1) END AS now FROM p""")
def renames(t):
    """Every rename as numstat prints it, with the path it leads to."""
    return t.commits.select(F.explode("files.path").alias("path")).where("contains(path, ' => ')").distinct().select("path", history.renamed(F.col("path")).alias("now"))
