"""Queries behind views and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.operators import graph, history, views
from terrane.plans import estate_queries as base
from terrane.plans.estate_queries import CHANGES, GRAPH

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


HUB = "(SELECT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)"


def _hub(t) -> str | None:
    r = graph.degrees(t.e).orderBy(F.col("degree").desc(), "id").first()
    return r["id"] if r else None


@query(GRAPH + f"""SELECT 'out' AS side, e.kind, e.dst AS id, n.name, e.evidence FROM e LEFT JOIN n ON n.id = e.dst WHERE e.src = {HUB}
UNION ALL SELECT 'in', e.kind, e.src, n.name, e.evidence FROM e LEFT JOIN n ON n.id = e.src WHERE e.dst = {HUB}""")
def node_detail(t):
    return views.node_detail(t.e, t.n, _hub(t))


@query(GRAPH + """, f AS (SELECT repo, file FROM n WHERE kind = 'file' ORDER BY repo, file LIMIT 1), o AS (SELECT id FROM n JOIN f USING (repo, file))
SELECT DISTINCT src, dst, kind FROM e WHERE src IN (FROM o) OR dst IN (FROM o)""")
def file_view(t):
    f = t.n.where("kind = 'file'").select("repo", "file").orderBy("repo", "file").first()
    return views.file_view(t.e, t.n, f["repo"], f["file"])


@query(GRAPH + base.PK + f""", s AS (SELECT min(service) FROM repos), m AS (SELECT id, CASE WHEN coalesce(service, repo) = (FROM s) AND file IS NOT NULL THEN 'package ' || {base._pkg(3)} WHEN kind IN ({base.TOPS}, 'table') THEN id END AS grp FROM k)
SELECT a.grp AS source, b.grp AS target, e.kind, count(*) AS count FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst WHERE a.grp <> b.grp AND (starts_with(a.grp, 'package ') OR starts_with(b.grp, 'package ')) GROUP BY ALL""")
def service_view(t):
    """Packages of the first service and what they touch."""
    r = t.repos.where("service IS NOT NULL").orderBy("service").first()
    return views.service_view(t.e, t.n, r["service"], 3)


@query(GRAPH + "SELECT id, name, kind, repo, json_extract_string(extra, '$.artifactId') AS artifact FROM n WHERE kind IN ('service', 'library')")
def module_inventory(t):
    return views.modules(t.n)


GAPS = """, x AS (SELECT dst AS id, src AS p, NULL AS c FROM e WHERE kind = 'produces' UNION ALL SELECT src, NULL, dst FROM e WHERE kind = 'consumed-by' UNION ALL SELECT id, NULL, NULL FROM n WHERE kind = 'topic'),
s AS (SELECT id, count(DISTINCT p) AS p, count(DISTINCT c) AS c FROM x GROUP BY id), w AS (SELECT dst AS id, src, bool_or(kind = 'writes-table') AS w FROM e WHERE kind IN ('reads-table', 'writes-table') GROUP BY dst, src),
gp AS (SELECT CASE WHEN p = 0 AND c = 0 THEN 'topic-direction-unknown' WHEN p = 0 THEN 'unproduced-topic' ELSE 'unconsumed-topic' END AS category, id AS detail FROM s WHERE p = 0 OR c = 0
UNION SELECT 'shared-table', id || ': ' || count(*) || ' services' FROM w GROUP BY id HAVING count(*) > 1 AND sum(w::INT) > 1 UNION SELECT 'table-declared-twice', name FROM n WHERE kind = 'table' GROUP BY name HAVING count(DISTINCT repo) > 1)"""


@query(GRAPH + GAPS + "SELECT category, detail FROM gp")
def gaps(t):
    return views.gaps(t.e, t.n)


@query(GRAPH + GAPS + r""", k AS (SELECT category, detail, substr(sha256(lower(category) || '|' || lower(regexp_replace(regexp_replace(regexp_replace(trim(detail), ':[0-9]+\b', '', 'g'), '\b[0-9]+\b', '#', 'g'), '\s+', ' ', 'g'))), 1, 8) AS key FROM gp)
SELECT category, detail, key, key < '8' AS hidden FROM k""")
def gaps_visible(t):
    """Findings with keys; those with a low key stand in for acknowledged ones."""
    keyed = views.with_keys(views.gaps(t.e, t.n))
    return views.with_keys(keyed.select("category", "detail"), keyed.where("key < '8'").select("key"))


@query(GRAPH + """, s AS (SELECT id, name FROM n WHERE kind = 'service'), h AS (SELECT a.name AS source, b.name AS target, e.confidence, e.evidence, row_number() OVER (PARTITION BY a.name, b.name ORDER BY e.evidence) AS k FROM e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst WHERE e.kind IN ('http', 'event', 'depends-on'))
SELECT source, target, count(*) AS count, max(confidence) AS confidence, string_agg(evidence, ',' ORDER BY evidence) FILTER (WHERE k <= 3) AS evidence FROM h GROUP BY source, target""")
def topology(t):
    return views.topology(t.e, t.n)


@query(GRAPH + "SELECT src, dst, kind, evidence FROM e WHERE kind IN ('http', 'event', 'produces', 'consumed-by', 'reads-table', 'writes-table', 'defines-table', 'uses-datastore', 'uses-cache') AND provenance = 'EXTRACTED' AND NOT starts_with(dst, 'cart . library ')")
def visible_edges(t):
    return views.visible(t.e, ["sync", "async", "data"], inferred=False).select("src", "dst", "kind", "evidence")


@query(GRAPH + """, v AS (SELECT DISTINCT dst AS name, json_extract_string(extra, '$.calls') AS version FROM e WHERE kind = 'uses-library' AND json_extract_string(extra, '$.calls') IS NOT NULL) SELECT name, count(DISTINCT version) AS versions FROM v GROUP BY name HAVING count(DISTINCT version) > 1""")
def version_drift(t):
    """The supplied uses carry no version; the number in their extra stands for it."""
    version = F.get_json_object("extra", "$.calls")
    return views.version_drift(t.e.where("kind = 'uses-library'").select(F.col("dst").alias("name"), version.alias("version")).where("version IS NOT NULL"))


@query(GRAPH + """, f AS (SELECT id, file AS path FROM n WHERE kind = 'file' AND file IS NOT NULL), b AS (SELECT id, path, regexp_replace(path, '\\.[A-Za-z]+$', '') AS bare FROM f),
u AS (SELECT DISTINCT e.src || '|' || m.file AS use_id, regexp_replace(regexp_replace(regexp_replace(m.file, '^src/(main|test)/java/', ''), '\\.[A-Za-z]+$', ''), '/', '.', 'g') AS fqn FROM e JOIN n m ON m.id = e.dst WHERE e.kind = 'imports' AND m.file LIKE '%.java'),
w AS (SELECT use_id, replace(fqn, '.', '/') AS want, string_split(fqn, '.')[-1] AS simple FROM u WHERE regexp_matches(string_split(fqn, '.')[-1], '^[A-Z]')),
x AS (SELECT use_id, min(b.id) AS exact FROM w JOIN b ON b.bare = want OR ends_with(b.bare, '/' || want) GROUP BY use_id), o AS (SELECT string_split(bare, '/')[-1] AS simple, min(id) AS one FROM b GROUP BY 1 HAVING count(*) = 1)
SELECT w.use_id, coalesce(exact, one) AS id FROM w LEFT JOIN x USING (use_id) LEFT JOIN o USING (simple)""")
def resolve_imports(t):
    n = t.n
    fqn = F.regexp_replace(F.regexp_replace(F.regexp_replace("file", "^src/(main|test)/java/", ""), r"\.[A-Za-z]+$", ""), "/", ".")
    u = t.e.where("kind = 'imports'").join(n.where("file LIKE '%.java'").select(F.col("id").alias("dst"), "file"), "dst").select(F.concat("src", F.lit("|"), "file").alias("use_id"), fqn.alias("fqn")).distinct()
    return views.imports(u, n.where("kind = 'file' AND file IS NOT NULL").select("id", F.col("file").alias("path")))


@query(GRAPH + """, m AS (SELECT DISTINCT name AS module FROM n WHERE kind = 'service'), r AS (SELECT DISTINCT repo AS name FROM repos)
SELECT name, max({'n': least(length(name), length(module)), 'm': module}).m AS module FROM r JOIN m ON contains(name, module) OR contains(module, name) WHERE least(length(name), length(module)) >= 4 GROUP BY name""")
def closest_module(t):
    return views.closest_module(t.repos.select(F.col("repo").alias("name")), t.n.where("kind = 'service'").select("name"))


@query(CHANGES.replace("WITH ", GRAPH + ", ", 1) + base.COCHANGE[: base.COCHANGE.index("\nSELECT p.repo")] + """, m0 AS (SELECT repo, path, max(commits) / CAST(sum(commits) AS DOUBLE) AS share, sum(commits) AS r FROM own GROUP BY repo, path), bus AS (SELECT repo || '/' || path AS subject, round(share, 4) AS w FROM m0 WHERE share >= 0.8 AND r >= 3),
w AS (SELECT dst AS id, src, bool_or(kind = 'writes-table') AS w FROM e WHERE kind IN ('reads-table', 'writes-table') GROUP BY dst, src),
tp AS (SELECT dst AS id, count(DISTINCT src) AS p FROM e WHERE kind = 'produces' GROUP BY dst), lone AS (SELECT n.id, n.name FROM n WHERE kind = 'service' AND id NOT IN (SELECT dst FROM e WHERE kind IN ('http', 'event', 'depends-on'))),
sv AS (SELECT id, name FROM n WHERE kind = 'service'), fc AS (SELECT service, count(*) AS c FROM n WHERE kind = 'file' GROUP BY service),
cp AS (SELECT p.repo || '/' || p.a AS a, p.repo || '/' || p.b AS b, round(CAST(shared AS DOUBLE) / ((ra.n + rb.n) / CAST(2 AS DOUBLE)), 4) AS degree FROM p JOIN rv ra ON ra.repo = p.repo AND ra.path = p.a JOIN rv rb ON rb.repo = p.repo AND rb.path = p.b WHERE CAST(shared AS DOUBLE) / ((ra.n + rb.n) / CAST(2 AS DOUBLE)) >= 0.30),
qs AS (SELECT 'who owns the table' AS rule, id AS subject, CAST(sum(w::INT) AS DOUBLE) AS weight FROM w GROUP BY id HAVING count(*) > 1 AND sum(w::INT) > 1
UNION ALL SELECT 'who declares the table', dst, CAST(count(DISTINCT src) AS DOUBLE) FROM e WHERE kind IN ('reads-table', 'writes-table') AND dst NOT IN (SELECT dst FROM e WHERE kind = 'defines-table') GROUP BY dst
UNION ALL SELECT 'who reads the topic', id, CAST(p AS DOUBLE) FROM tp WHERE id NOT IN (SELECT src FROM e WHERE kind = 'consumed-by')
UNION ALL SELECT 'who writes the topic', src, CAST(count(DISTINCT dst) AS DOUBLE) FROM e WHERE kind = 'consumed-by' AND src NOT IN (SELECT id FROM tp) GROUP BY src
UNION ALL SELECT 'is the service alive', id, CAST(coalesce((SELECT c FROM fc WHERE fc.service = lone.name), 0) AS DOUBLE) FROM lone UNION ALL SELECT 'who else knows the file', subject, w FROM bus
UNION ALL SELECT 'what does the service offer', id, CAST(coalesce((SELECT c FROM fc WHERE fc.service = sv.name), 0) AS DOUBLE) FROM sv WHERE id NOT IN (SELECT src FROM e WHERE kind IN ('exposes', 'produces'))
UNION ALL SELECT 'is the link real', src || ' > ' || dst, CAST(count(*) AS DOUBLE) FROM e WHERE kind IN ('http', 'event', 'depends-on') AND src IN (SELECT id FROM sv) AND dst IN (SELECT id FROM sv) GROUP BY src, dst HAVING bool_and(provenance = 'INFERRED')
UNION ALL SELECT 'why do they change together', a || ' + ' || b, degree FROM cp WHERE regexp_replace(a, '/[^/]*$', '') <> regexp_replace(b, '/[^/]*$', '')
UNION ALL SELECT 'does the library need to be so common', dst, CAST(count(DISTINCT src) AS DOUBLE) FROM e WHERE kind = 'uses-library' GROUP BY dst
UNION ALL SELECT 'which node do all lean on', dst, CAST(count(*) AS DOUBLE) FROM e WHERE kind IN ('calls', 'imports', 'extends') GROUP BY dst)
SELECT rule, subject, row_number() OVER (PARTITION BY rule ORDER BY weight DESC, subject) AS place FROM qs QUALIFY place <= CASE WHEN rule IN ('does the library need to be so common', 'which node do all lean on') THEN 3 ELSE 5 END""")
def questions(t):
    own = t.own
    bus = own.groupBy("repo", "path").agg(F.sum("commits").alias("r"), (F.max("commits") / F.sum("commits").cast("double")).alias("share")).where("share >= 0.8D AND r >= 3")
    return views.questions(t.e, t.n, bus.select("repo", "path", F.round("share", 4).alias("author_share")), history.cochange(t.ch))


@query("""SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def daily_events(t):
    return t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(CHANGES + "SELECT month, repo, count(DISTINCT sha) AS commits, CAST(sum(added) AS BIGINT) AS added, grouping(month) + 2 * grouping(repo) AS level FROM ch GROUP BY CUBE (month, repo)")
def activity_cube(t):
    """Extension: activity by month and repo with all subtotals."""
    return t.ch.cube("month", "repo").agg(F.countDistinct("sha").alias("commits"), F.sum("added").alias("added"), (F.grouping("month").cast("bigint") + 2 * F.grouping("repo").cast("bigint")).alias("level"))


@query(GRAPH + """SELECT id, name FROM n WHERE kind = 'service' AND id NOT IN (SELECT src FROM e WHERE kind IN ('exposes', 'produces') AND provenance = 'EXTRACTED' AND confidence >= 0.95)""")
def services_without_contract(t):
    """Services without a contract that is beyond doubt."""
    return t.n.where("kind = 'service'").select("id", "name").join(t.e.where("kind IN ('exposes', 'produces') AND provenance = 'EXTRACTED' AND confidence >= 0.95D").select(F.col("src").alias("id")), "id", "left_anti")


@query(GRAPH + base._steps(5, "SELECT id, 1.0 / (SELECT count(*) FROM v) AS p FROM v").replace(" SELECT id, round(rank, 9) AS rank FROM r5", """, i AS (SELECT dst AS id, count(*) AS inbound FROM e WHERE kind IN ('calls', 'imports', 'extends') GROUP BY dst)
SELECT n.id, n.name, n.kind, i.inbound FROM n JOIN i USING (id) JOIN r5 USING (id) WHERE n.kind IN ('class', 'function') ORDER BY round(rank, 9) DESC, n.id LIMIT 20"""))
def central_code(t):
    """Top-k report: the limit is the feature."""
    ranks = graph.pagerank(graph.adjacency(t.e), iterations=5, tolerance=None).select("id", F.round("rank", 9).alias("rank"))
    return views.central_code(t.e, t.n, ranks).select("id", "name", "kind", "inbound")


@query()
def central_code_converged(t):
    """Top-k report on converged ranks; central_code takes the five steps of its SQL."""
    ranks = graph.pagerank(graph.adjacency(t.e)).select("id", F.round("rank", 9).alias("rank"))
    return views.central_code(t.e, t.n, ranks).select("id", "name", "kind", "inbound")
