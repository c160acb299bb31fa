"""Queries over the graph tables: the reference operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import strip
from terrane.model import ids, vocab
from terrane.operators import estate, graph, history, instants, merge
from terrane.session import stamp, table, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

WS = "E' \\t\\n\\r'"
#: The merged graph in SQL: fields of the latest delivery, edges by their four-part key.
GRAPH = f"""
WITH n0 AS (SELECT * REPLACE (trim(id, {WS}) AS id, CASE WHEN trim(extra) <> '{{}}' THEN extra END AS extra) FROM nodes WHERE trim(id, {WS}) <> ''),
n AS (SELECT id, min({{'t': loaded_at, 'v': kind}}).v AS kind, min({{'t': loaded_at, 'v': source}}).v AS source,
  {", ".join(f"(max({{'t': loaded_at, 'v': {c}}}) FILTER (WHERE {c} IS NOT NULL)).v AS {c}" for c in merge.LATEST)},
  bool_or(deleted_at IS NULL) AS live FROM n0 GROUP BY id),
e0 AS (SELECT id, trim(src, {WS}) AS src, trim(dst, {WS}) AS dst, kind, coalesce(evidence, '') AS evidence, coalesce(provenance, 'INFERRED') AS provenance,
  coalesce(confidence, 0.5) AS confidence, coalesce(weight, 1.0) AS weight, source, extra, loaded_at FROM edges),
e1 AS (SELECT src, dst, kind, evidence, id, min(provenance) AS provenance, max(confidence) AS confidence, max(weight) AS weight, min(loaded_at) AS loaded_at,
  min(source) AS source, min(extra) AS extra FROM e0 WHERE src <> '' AND dst <> '' AND kind <> '' AND src <> dst GROUP BY ALL),
e AS (SELECT src, dst, kind, evidence, sum(weight) AS weight, max(confidence) AS confidence,
  CASE WHEN bool_or(provenance = 'EXTRACTED') THEN 'EXTRACTED' ELSE 'INFERRED' END AS provenance,
  min({{'t': loaded_at, 'i': id, 'v': source}}).v AS source, min({{'t': loaded_at, 'i': id, 'v': extra}}).v AS extra
  FROM (SELECT src, dst, kind, evidence, id, min(provenance) AS provenance, max(confidence) AS confidence, max(weight) AS weight, min(loaded_at) AS loaded_at, min(source) AS source, min(extra) AS extra
        FROM e0 WHERE src <> '' AND dst <> '' AND kind <> '' AND src <> dst GROUP BY src, dst, kind, evidence, id) GROUP BY src, dst, kind, evidence)
"""
GRAPH = GRAPH.replace(GRAPH[GRAPH.index("e1 AS (") : GRAPH.index("e AS (SELECT src")], "")
RUNTIME = ", ".join(f"'{k}'" for k in vocab.RUNTIME_KINDS)
#: Counted changes of commits in SQL.
CHANGES = r"""
WITH c AS (SELECT repo, sha, author, date, subject, files FROM commits WHERE repo IS NOT NULL AND sha IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, sha ORDER BY loaded_at DESC NULLS LAST) = 1),
x AS (SELECT repo, sha, author, date, substr(date, 1, 7) AS month, subject, u.path AS p, coalesce(u.added, 0) AS added, coalesce(u.deleted, 0) AS deleted FROM (SELECT *, unnest(files) AS u FROM c)),
y AS (SELECT * EXCLUDE (p), CASE WHEN regexp_matches(p, '\{[^{}]* => [^{}]*\}') THEN regexp_replace(regexp_replace(regexp_replace(p, '\{[^{}]* => ([^{}]*)\}', '\1', 'g'), '/{2,}', '/', 'g'), '^/', '')
  WHEN contains(p, ' => ') THEN regexp_extract(p, ' => (.*)$', 1) ELSE p END AS path FROM x),
ch_all AS (SELECT repo, sha, author, date, month, path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted FROM y WHERE path <> '' GROUP BY ALL),
ch AS (SELECT repo, sha, author, date, month, path, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted FROM y WHERE path <> ''
  AND NOT starts_with(lower(coalesce(subject, '')), 'merge') AND NOT starts_with(lower(coalesce(subject, '')), 'revert')
  AND NOT regexp_matches(path, '(?i)(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|gemfile\.lock|poetry\.lock|cargo\.lock|go\.sum|composer\.lock|changelog(\.md)?)$') GROUP BY ALL),
own AS (SELECT repo, path, author, count(*) AS commits, CAST(sum(added) AS BIGINT) AS added, max(date) AS last FROM ch WHERE author IS NOT NULL GROUP BY ALL)
"""


def query(sql: str | None = None):
    """Registers a function of (nodes, edges, t) or (spark, sf) under its own name."""

    def add(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return f(Tables(spark, sf))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_merged: dict[tuple, DataFrame] = {}


class Tables:
    """The tables of a directory and the views most queries start from."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf, name)

    def _kept(self, name: str, make) -> DataFrame:
        """The merged table, written to the shared folder once for each state of its source and read by column from then on."""
        key = (self.spark.sparkContext.applicationId, name, stamp(self.spark, f"{self.sf}/{name}.parquet"))
        if key not in _merged:
            _merged[key] = written(make(getattr(self, name)), f"merged-{name}")
        return _merged[key]

    @property
    def n(self) -> DataFrame:
        return self._kept("nodes", merge.merge_nodes)

    @property
    def e(self) -> DataFrame:
        return self._kept("edges", merge.merge_edges)

    @property
    def members(self) -> DataFrame:
        return graph.estate_members(self.n, self.repos)

    @property
    def ch(self) -> DataFrame:
        return history.changes(self.commits)

    @property
    def own(self) -> DataFrame:
        return history.ownership(self.ch)


# --- write algebra -----------------------------------------------------------


@query(GRAPH + "SELECT id, kind, source, name, container, file, line, repo, lang, service, extra, live FROM n")
def node_upsert(t):
    return merge.merge_nodes(t.nodes)


@query(GRAPH + "SELECT src, dst, kind, evidence, weight, confidence, provenance, source, extra FROM e")
def edge_upsert(t):
    return merge.merge_edges(t.edges)


@query("""
WITH s AS (SELECT CASE WHEN a > b THEN b ELSE a END AS a, CASE WHEN a > b THEN a ELSE b END AS b, CASE WHEN a > b THEN b_repo ELSE a_repo END AS a_repo,
  CASE WHEN a > b THEN a_repo ELSE b_repo END AS b_repo, shared, CASE WHEN a > b THEN b_revs ELSE a_revs END AS a_revs, CASE WHEN a > b THEN a_revs ELSE b_revs END AS b_revs, degree, cross_repo
  FROM coupling WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY shared DESC NULLS LAST, degree DESC NULLS LAST, a_revs DESC NULLS LAST, b_revs DESC NULLS LAST) = 1
""")
def coupling_upsert(t):
    return merge.upsert_coupling(t.coupling)


@query(GRAPH + """, lib AS (SELECT name, min(id) AS "to" FROM n WHERE kind = 'library' GROUP BY name),
mv AS (SELECT n.id AS f, lib."to" FROM n JOIN lib USING (name) WHERE n.kind = 'service'),
m AS (SELECT coalesce(a."to", src) AS src, coalesce(b."to", dst) AS dst, kind, evidence, weight, confidence, provenance FROM e LEFT JOIN mv a ON a.f = src LEFT JOIN mv b ON b.f = dst)
SELECT src, dst, kind, evidence, sum(weight) AS weight, max(confidence) AS confidence, CASE WHEN bool_or(provenance = 'EXTRACTED') THEN 'EXTRACTED' ELSE 'INFERRED' END AS provenance
FROM m WHERE src <> dst GROUP BY src, dst, kind, evidence""")
def reconciled_libraries(t):
    return merge.reconcile_libraries(t.n, t.e)


@query(GRAPH + """SELECT src, dst, kind, evidence, weight, confidence, provenance FROM e
WHERE src NOT IN (SELECT id FROM n WHERE kind = 'service' AND name IN (SELECT service FROM repos WHERE service IS NOT NULL))
  AND dst NOT IN (SELECT id FROM n WHERE kind = 'service' AND name IN (SELECT service FROM repos WHERE service IS NOT NULL))""")
def reconciled_containers(t):
    dirs = t.repos.where("service IS NOT NULL").select(F.col("service").alias("name")).distinct()
    return merge.reconcile_containers(t.n, t.e, dirs)[1].select("src", "dst", "kind", "evidence", "weight", "confidence", "provenance")


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS hash, doc_id % 3 AS r FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, CASE WHEN r = 1 THEN 'x' ELSE hash END AS hash FROM h WHERE r <> 2), w AS (SELECT doc_id, hash FROM h WHERE r <> 0 OR doc_id % 2 = 0)
SELECT CAST(coalesce(w.doc_id, o.doc_id) AS VARCHAR) AS key, coalesce(w.hash, o.hash) AS hash,
  CASE WHEN w.doc_id IS NULL THEN 'prune' WHEN o.doc_id IS NULL OR o.hash <> w.hash THEN 'parse' ELSE 'keep' END AS action
FROM w FULL JOIN o ON w.doc_id = o.doc_id""")
def content_hash_cache(t):
    """What a cached state (a third changed, a third new) asks an incremental parse to do."""
    h = t.documents.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("key"), F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 3).alias("r"), "doc_id")
    old = h.where("r <> 2").select("key", F.when(F.col("r") == 1, "x").otherwise(F.col("hash")).alias("hash"))
    return merge.cache_changes(old, h.where("r <> 0 OR doc_id % 2 = 0").select("key", "hash"))


# --- filters, projections, limits ------------------------------------------------


@query(GRAPH + "SELECT kind, count(*) AS n, count(DISTINCT repo) AS repos FROM n WHERE live GROUP BY kind")
def counts_by_kind(t):
    return t.n.where("live").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("repos"))


@query(GRAPH + "SELECT kind, provenance, count(*) AS n FROM e GROUP BY kind, provenance")
def edges_by_provenance(t):
    return t.e.groupBy("kind", "provenance").agg(F.count("*").alias("n"))


@query(GRAPH + """SELECT id, name, kind, CASE WHEN lower(name) = 'ledger' THEN 1 WHEN file = 'ledger' THEN 2 WHEN ends_with(file, 'ledger') THEN 3 ELSE 4 END AS pass_no
FROM n WHERE name ILIKE '%ledger%' OR file ILIKE '%ledger%' ORDER BY pass_no, name, id LIMIT 25""")
def find_nodes(t):
    """Top-k search: the limit is the feature."""
    return estate.find(t.n, "ledger")


@query(GRAPH + """SELECT id, name, kind, CASE WHEN lower(name) = 'ledger' THEN 1 WHEN file = 'ledger' THEN 2 WHEN ends_with(file, 'ledger') THEN 3 ELSE 4 END AS pass_no
FROM n WHERE kind = 'class' AND lang = 'java' AND (name ILIKE '%ledger%' OR file ILIKE '%ledger%') ORDER BY pass_no, name, id LIMIT 25""")
def find_filtered(t):
    return estate.find(t.n, "ledger", kind="class", lang="java")


@query(GRAPH + """SELECT id, kind, CASE kind WHEN 'service' THEN 1 WHEN 'topic' THEN 2 WHEN 'infra' THEN 2 WHEN 'datastore' THEN 3 WHEN 'table' THEN 3 WHEN 'library' THEN 4
  WHEN 'host' THEN 0 WHEN 'legacy-page' THEN 0 ELSE 1 END AS layer, split_part(id, ' ', 2) AS scope, CASE WHEN contains(id, '`') THEN split_part(id, '`', 2) END AS symbol FROM n""")
def id_parts(t):
    p = ids.parts(F.col("id"))
    return t.n.select("id", "kind", vocab.lookup(vocab.LAYER, "kind", 1).alias("layer"), p["scope"].alias("scope"), p["symbol"].alias("symbol"))


@query(GRAPH + """SELECT DISTINCT repo, file FROM n WHERE file IS NOT NULL AND NOT regexp_matches(file, '(^|/)(%s)/')""" % "|".join(d.replace(".", r"\.") for d in vocab.SKIP_DIRS))
def pruned_files(t):
    pat = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in vocab.SKIP_DIRS) + ")/"
    return t.n.where(F.col("file").isNotNull() & ~F.col("file").rlike(pat)).select("repo", "file").distinct()


@query(GRAPH + """SELECT id, json_extract_string(extra, '$.artifactId') AS artifact FROM n WHERE json_extract_string(extra, '$.artifactId') IS NOT NULL""")
def json_presence(t):
    return t.n.select("id", F.get_json_object("extra", "$.artifactId").alias("artifact")).where("artifact IS NOT NULL")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    """Bad JSON gives null, as does a missing key."""
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# --- joins -----------------------------------------------------------------------


@query(GRAPH + """SELECT e.kind, a.kind AS src_kind, b.kind AS dst_kind, count(*) AS n FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst GROUP BY ALL""")
def edge_kinds_between(t):
    n = t.n.select("id", "kind")
    e = t.e.select("src", "dst", "kind").join(n.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")), "src").join(n.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind")), "dst")
    return e.groupBy("kind", "src_kind", "dst_kind").agg(F.count("*").alias("n"))


@query(GRAPH + "SELECT id, name FROM n WHERE kind = 'service' AND NOT EXISTS (SELECT 1 FROM e WHERE e.kind IN ('http', 'event') AND e.provenance = 'EXTRACTED' AND e.confidence >= 0.95 AND (e.src = n.id OR e.dst = n.id))")
def lonely_services(t):
    """Services without a link that is beyond doubt."""
    ends = t.e.where("kind IN ('http', 'event') AND provenance = 'EXTRACTED' AND confidence >= 0.95D").select(F.explode(F.array("src", "dst")).alias("id"))
    return t.n.where("kind = 'service'").join(ends, "id", "left_anti").select("id", "name")


@query(GRAPH + """SELECT DISTINCT e.src AS caller FROM e WHERE e.kind = 'http' AND e.dst IN (SELECT src FROM e WHERE kind = 'exposes')""")
def callers_of_exposing(t):
    e = t.e
    return e.where("kind = 'http'").join(e.where("kind = 'exposes'").select(F.col("src").alias("dst")), "dst", "left_semi").select(F.col("src").alias("caller")).distinct()


@query(GRAPH + """, m AS (SELECT repo, path, max(revisions) AS revisions, max(complexity) AS complexity FROM file_metrics GROUP BY repo, path)
SELECT n.id, m.revisions, m.complexity FROM n LEFT JOIN m ON m.repo = n.repo AND m.path = n.file WHERE n.kind = 'file'""")
def files_with_metrics(t):
    m = t.file_metrics.groupBy("repo", F.col("path").alias("file")).agg(F.max("revisions").alias("revisions"), F.max("complexity").alias("complexity"))
    return t.n.where("kind = 'file'").join(m, ["repo", "file"], "left").select("id", "revisions", "complexity")


@query(GRAPH + """, d AS (SELECT repo, file, line, min(id) AS id FROM n WHERE kind IN ('class', 'function') AND line IS NOT NULL GROUP BY repo, file, line),
q AS (SELECT DISTINCT src, evidence, a.repo, a.file, CAST(regexp_extract(evidence, ':([0-9]+)$', 1) AS INT) AS line FROM e JOIN n a ON a.id = e.src WHERE e.kind = 'calls' AND regexp_matches(evidence, ':[0-9]+$') AND a.file IS NOT NULL)
SELECT q.src, q.evidence, q.line, d.id AS enclosing FROM q ASOF LEFT JOIN d ON q.repo = d.repo AND q.file = d.file AND q.line >= d.line""")
def enclosing_asof(t):
    """As-of join: the last definition at or before a cited line, by one sort per file and a running value."""
    from terrane.operators.resolve import enclosing

    n = t.n
    d = n.where("kind IN ('class', 'function') AND line IS NOT NULL").groupBy("repo", "file", "line").agg(F.min("id").alias("id"))
    q = t.e.where("kind = 'calls'").join(n.where("file IS NOT NULL").select(F.col("id").alias("src"), "repo", "file"), "src")
    q = q.where(F.col("evidence").rlike(":[0-9]+$")).select("src", "evidence", "repo", "file", F.regexp_extract("evidence", ":([0-9]+)$", 1).cast("int").alias("line")).distinct()
    return enclosing(q, d).select("src", "evidence", "line", F.col("id").alias("enclosing"))


# --- aggregates over the graph -----------------------------------------------------


@query(GRAPH + f"""SELECT e.src AS source, e.dst AS target, count(*) AS count, CASE WHEN bool_or(e.provenance = 'INFERRED') THEN 'INFERRED' ELSE 'EXTRACTED' END AS provenance, min(e.evidence) AS evidence
FROM e JOIN n a ON a.id = e.src AND a.kind = 'service' JOIN n b ON b.id = e.dst AND b.kind = 'service' WHERE e.kind IN ({RUNTIME}) GROUP BY e.src, e.dst""")
def architecture_pairs(t):
    return estate.architecture_pairs(t.e, t.n).select("source", "target", "count", "provenance", "evidence")


@query(GRAPH + f""", r AS (SELECT e.*, a.kind AS ak, b.kind AS bk FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.kind IN ({RUNTIME})),
w AS (SELECT dst AS id, bk AS kind, src AS svc, kind IN ('writes-table', 'produces', 'uses-datastore', 'uses-cache') AS writes, kind = 'reads-table' AS reads FROM r WHERE ak = 'service' AND bk IN ('topic', 'datastore', 'table')
  UNION ALL SELECT src, ak, dst, false, true FROM r WHERE ak IN ('topic', 'datastore', 'table') AND bk = 'service')
SELECT id, kind, count(DISTINCT svc) FILTER (WHERE writes) AS writers, count(DISTINCT svc) FILTER (WHERE reads) AS readers, count(DISTINCT svc) AS services, count(DISTINCT svc) FILTER (WHERE writes) > 1 AS significant
FROM w WHERE writes OR reads GROUP BY id, kind HAVING count(DISTINCT svc) >= 2""")
def waypoints(t):
    return estate.waypoints(t.e, t.n)


TAIL = "CASE WHEN len(string_split(x, ' ')) > 3 THEN array_to_string(string_split(x, ' ')[4:], ' ') ELSE string_split(x, ' ')[-1] END"


def _tail(c: str) -> str:
    return TAIL.replace("x,", f"{c},")


@query(GRAPH + f""", a AS (SELECT DISTINCT dst AS id, kind, {_tail('src')} AS svc FROM e WHERE kind IN ('reads-table', 'writes-table', 'defines-table')),
g AS (SELECT id, string_agg(svc, ',' ORDER BY svc) FILTER (WHERE kind = 'reads-table') AS readers, string_agg(svc, ',' ORDER BY svc) FILTER (WHERE kind = 'writes-table') AS writers,
  string_agg(svc, ',' ORDER BY svc) FILTER (WHERE kind = 'defines-table') AS declared_by, count(DISTINCT svc) AS touched FROM a GROUP BY id)
SELECT n.id, n.name, n.service AS owner, coalesce(readers, '') AS readers, coalesce(writers, '') AS writers, coalesce(declared_by, '') AS declared_by, coalesce(touched, 0) AS touched
FROM n LEFT JOIN g USING (id) WHERE n.kind = 'table'""")
def data_matrix(t):
    return estate.data_matrix(t.e, t.n)


@query(GRAPH + """, a AS (SELECT dst AS id, src, bool_or(kind = 'writes-table') AS w FROM e WHERE kind IN ('reads-table', 'writes-table') GROUP BY dst, src)
SELECT id, count(*) AS services, CAST(sum(w::INT) AS BIGINT) AS writers, CAST(sum((NOT w)::INT) AS BIGINT) AS readers_only FROM a GROUP BY id HAVING count(*) > 1""")
def shared_tables(t):
    return estate.shared_tables(t.e)


@query(GRAPH + """SELECT regexp_extract(name, '^[A-Za-z]+', 0) AS name, count(DISTINCT repo) AS repos FROM n WHERE kind = 'table' GROUP BY 1 HAVING count(DISTINCT repo) > 1""")
def declared_twice(t):
    """Table families (first word of the name) declared in several repos; whole names never repeat in the supplied estates."""
    return t.n.where("kind = 'table'").groupBy(F.regexp_extract("name", "^[A-Za-z]+", 0).alias("name")).agg(F.countDistinct("repo").alias("repos")).where("repos > 1")


@query(GRAPH + """SELECT DISTINCT e.dst AS id FROM e WHERE e.kind IN ('reads-table', 'writes-table') AND NOT EXISTS (SELECT 1 FROM e d WHERE d.kind = 'defines-table' AND d.dst = e.dst)""")
def undeclared_tables(t):
    e = t.e
    return e.where("kind IN ('reads-table', 'writes-table')").select(F.col("dst").alias("id")).distinct().join(e.where("kind = 'defines-table'").select(F.col("dst").alias("id")), "id", "left_anti")


@query(GRAPH + """, x AS (SELECT dst AS id, src AS p, NULL AS c FROM e WHERE kind = 'produces' UNION ALL SELECT src, NULL, dst FROM e WHERE kind = 'consumed-by' UNION ALL SELECT id, NULL, NULL FROM n WHERE kind = 'topic')
SELECT id, count(DISTINCT p) AS producers, count(DISTINCT c) AS consumers, CASE WHEN count(DISTINCT p) = 0 THEN CASE WHEN count(DISTINCT c) = 0 THEN 'direction-unknown' ELSE 'unproduced' END
  WHEN count(DISTINCT c) = 0 THEN 'unconsumed' ELSE 'ok' END AS state FROM x GROUP BY id""")
def topic_states(t):
    return estate.topics(t.e, t.n)


@query(GRAPH + "SELECT DISTINCT p.src, c.dst, p.dst AS topic FROM e p JOIN e c ON p.dst = c.src WHERE p.kind = 'produces' AND c.kind = 'consumed-by' AND p.src <> c.dst")
def event_links(t):
    return estate.events(t.e)


@query(GRAPH + """SELECT n.id, n.name, coalesce(f.c, 0) AS files, coalesce(i.c, 0) AS inbound, coalesce(o.c, 0) AS outbound FROM n
LEFT JOIN (SELECT service, count(*) c FROM n WHERE kind = 'file' AND service IS NOT NULL GROUP BY service) f ON f.service = n.name
LEFT JOIN (SELECT dst, count(*) c FROM e WHERE kind IN ('http', 'event', 'depends-on') GROUP BY dst) i ON i.dst = n.id
LEFT JOIN (SELECT src, count(*) c FROM e WHERE kind IN ('http', 'event', 'depends-on') GROUP BY src) o ON o.src = n.id WHERE n.kind = 'service'""")
def service_table(t):
    return estate.service_table(t.e, t.n)


@query(GRAPH + """SELECT measure, n FROM (
SELECT 'edges' AS measure, count(*) AS n FROM e UNION ALL SELECT 'extracted', count(*) FROM e WHERE provenance = 'EXTRACTED' UNION ALL SELECT 'inferred', count(*) FROM e WHERE provenance = 'INFERRED'
UNION ALL SELECT 'runtime', count(*) FROM e WHERE json_extract_string(extra, '$.runtime') = 'true' UNION ALL SELECT 'build_time', count(*) FROM e WHERE kind IN ('imports', 'extends', 'calls', 'implemented-by', 'depends-on', 'uses-library')
UNION ALL SELECT 'nodes', count(*) FROM n UNION ALL SELECT 'repos', count(DISTINCT repo) FROM n)""")
def coverage(t):
    return estate.coverage(t.e, t.n)


@query(GRAPH + """SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id""")
def degree(t):
    return graph.degrees(t.e)


@query(GRAPH + """, d AS (SELECT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id HAVING count(*) >= 2)
SELECT src, dst, kind, evidence FROM e WHERE src IN (FROM d) AND dst IN (FROM d)""")
def dead_end_prune(t):
    return graph.prune_dead_ends(t.e).select("src", "dst", "kind", "evidence")


@query(GRAPH + """SELECT e.kind, CAST(sum((a.repo <> b.repo)::INT) AS BIGINT) AS cross_repo, CAST(sum((a.repo = b.repo)::INT) AS BIGINT) AS same_repo FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst
WHERE a.repo IS NOT NULL AND b.repo IS NOT NULL GROUP BY e.kind""")
def cross_repo_edges(t):
    r = t.n.where("repo IS NOT NULL").select("id", "repo")
    e = t.e.join(r.select(F.col("id").alias("src"), F.col("repo").alias("ra")), "src").join(r.select(F.col("id").alias("dst"), F.col("repo").alias("rb")), "dst")
    return e.groupBy("kind").agg(F.sum((F.col("ra") != F.col("rb")).cast("bigint")).alias("cross_repo"), F.sum((F.col("ra") == F.col("rb")).cast("bigint")).alias("same_repo"))


@query(GRAPH + """SELECT src, dst, kind, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY src, dst, kind, evidence) AS idx, count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS n FROM e""")
def edge_curvature(t):
    return graph.curvature(t.e)


# --- roll-ups ------------------------------------------------------------------------

TOPS = ", ".join(f"'{k}'" for k in vocab.TOP_KINDS)
MEMBERS = f""", sv AS (SELECT id, name FROM n WHERE kind = 'service'), home AS (SELECT repo, min(estate) AS estate FROM repos GROUP BY repo),
i0 AS (SELECT n.id, CASE WHEN kind = 'table' THEN service ELSE coalesce(service, repo) END AS via, home.estate FROM n LEFT JOIN home USING (repo) WHERE kind NOT IN ({TOPS})),
i1 AS (SELECT i0.id, coalesce(x.id, u.id) AS grp FROM i0 LEFT JOIN sv x ON x.name = i0.via AND x.id LIKE '% ' || i0.estate || '.' || i0.via LEFT JOIN (SELECT name, min(id) AS id FROM sv GROUP BY name HAVING count(*) = 1) u ON u.name = i0.via),
g AS (SELECT id, id AS grp FROM n WHERE kind IN ({TOPS}) UNION ALL SELECT id, grp FROM i1 WHERE grp IS NOT NULL)"""


@query(GRAPH + MEMBERS + """SELECT a.grp AS source, b.grp AS target, e.kind, count(*) AS count, max(confidence) AS confidence, CASE WHEN bool_or(provenance = 'EXTRACTED') THEN 'EXTRACTED' ELSE 'INFERRED' END AS provenance,
bool_or(coalesce(json_extract_string(extra, '$.runtime') = 'true', false)) AS runtime, max(coalesce(TRY_CAST(json_extract_string(extra, '$.calls') AS DOUBLE), 0.0)) AS calls, min(evidence) FILTER (WHERE evidence <> '') AS evidence
FROM e JOIN g a ON a.id = e.src JOIN g b ON b.id = e.dst WHERE a.grp <> b.grp GROUP BY a.grp, b.grp, e.kind""")
def estate_rollup(t):
    return graph.rollup(t.e, t.members).drop("style")


@query(GRAPH + MEMBERS + "SELECT grp, kind, count(*) AS n FROM g JOIN n USING (id) WHERE id <> grp GROUP BY grp, kind")
def group_contents(t):
    return graph.contents(t.n, t.members)


SCAF = ", ".join(f"'{s}'" for s in vocab.SCAFFOLD)
PKG = f"""(SELECT CASE WHEN len(o) > 0 THEN o ELSE p END FROM (SELECT list_filter(p, lambda x: x NOT IN ({SCAF})) AS o, p FROM (SELECT list_filter(string_split(file, '/')[:-2], lambda x: x <> '') AS p)))"""


def _pkg(depth: int) -> str:
    return f"CASE WHEN coalesce(file, '') = '' THEN NULL WHEN len(pk) = 0 THEN '(root)' ELSE array_to_string(pk[:{depth}], '/') END"


PK = f""", k0 AS (SELECT *, list_filter(string_split(file, '/')[:-2], lambda x: x <> '') AS dirs FROM n),
k AS (SELECT *, CASE WHEN len(list_filter(dirs, lambda x: x NOT IN ({SCAF}))) > 0 THEN list_filter(dirs, lambda x: x NOT IN ({SCAF})) ELSE dirs END AS pk FROM k0)"""


@query(GRAPH + PK + f"SELECT {_pkg(2)} AS package, count(*) AS n FROM k WHERE file IS NOT NULL GROUP BY 1")
def package_sizes(t):
    return t.n.where("file IS NOT NULL").groupBy(graph.package_key(F.col("file"), 2).alias("package")).agg(F.count("*").alias("n"))


@query(GRAPH + PK + f""", c AS (SELECT coalesce(service, repo) AS service, count(DISTINCT {_pkg(2)}) AS k2, count(DISTINCT {_pkg(3)}) AS k3, count(DISTINCT {_pkg(4)}) AS k4, count(DISTINCT {_pkg(5)}) AS k5
  FROM k WHERE coalesce(service, repo) IS NOT NULL AND file <> '' GROUP BY 1),
f AS (SELECT service, k2, k3, k4, k5, CASE WHEN k2 BETWEEN 4 AND 45 THEN 2 WHEN k3 BETWEEN 4 AND 45 THEN 3 WHEN k4 BETWEEN 4 AND 45 THEN 4 WHEN k5 BETWEEN 4 AND 45 THEN 5 END AS d FROM c),
b AS (SELECT service, d, greatest(CASE WHEN k2 <= 45 THEN k2 ELSE 0 END, CASE WHEN k3 <= 45 THEN k3 ELSE 0 END, CASE WHEN k4 <= 45 THEN k4 ELSE 0 END, CASE WHEN k5 <= 45 THEN k5 ELSE 0 END) AS m, k2, k3, k4, k5 FROM f)
SELECT service, coalesce(d, CASE WHEN m = 0 THEN 2 WHEN k2 = m THEN 2 WHEN k3 = m THEN 3 WHEN k4 = m THEN 4 ELSE 5 END) AS depth FROM b""")
def package_depth(t):
    return graph.pick_depth(t.n)


@query(GRAPH + PK + f""", m AS (SELECT id, coalesce(service, repo) || ':' || {_pkg(3)} AS grp FROM k WHERE file IS NOT NULL AND coalesce(service, repo) IS NOT NULL)
SELECT a.grp AS source, b.grp AS target, e.kind, count(*) AS count FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst WHERE a.grp <> b.grp GROUP BY ALL""")
def package_rollup(t):
    m = t.n.where("file IS NOT NULL").select("id", F.concat(F.coalesce("service", "repo"), F.lit(":"), graph.package_key(F.col("file"), 3)).alias("grp"))
    return graph.rollup(t.e, m).select("source", "target", "kind", "count")


@query(GRAPH + """, m AS (SELECT id, repo || '/' || file AS grp FROM n WHERE file IS NOT NULL AND repo IS NOT NULL)
SELECT a.grp AS source, b.grp AS target, e.kind, count(*) AS count, max(confidence) AS confidence FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst WHERE a.grp <> b.grp GROUP BY ALL""")
def file_rollup(t):
    m = t.n.select("id", F.concat("repo", F.lit("/"), "file").alias("grp"))
    return graph.rollup(t.e, m).select("source", "target", "kind", "count", "confidence")


# --- graph algorithms ---------------------------------------------------------------

KW = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in vocab.KIND_WEIGHT.items()) + " ELSE 1.0 END"
ADJ = f""", a0 AS (SELECT src, dst, CAST({KW} AS DOUBLE) * greatest(0.1, CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END) * least(4.0, CASE WHEN weight = 0 THEN 1.0 ELSE weight END) AS w FROM e WHERE kind <> 'uses-library')"""


@query(GRAPH + ADJ + "SELECT src, dst, round(sum(w), 6) AS w FROM a0 GROUP BY src, dst")
def adjacency_weights(t):
    return graph.adjacency(t.e).groupBy("src", "dst").agg(F.round(F.sum("w"), 6).alias("w"))


def _steps(k: int, p: str) -> str:
    """k unrolled PageRank steps; base has (id, p)."""
    out = ADJ + """, l AS (SELECT src, dst, sum(w) AS w FROM a0 GROUP BY src, dst), o AS (SELECT src, sum(w) AS o FROM l GROUP BY src), s AS (SELECT l.src, l.dst, w / o AS share FROM l JOIN o ON o.src = l.src),
v AS (SELECT DISTINCT id FROM (SELECT src AS id FROM l UNION ALL SELECT dst FROM l)), base AS (""" + p + """),
b AS (SELECT id, p, id NOT IN (SELECT src FROM o) AS leaf FROM base), r0 AS MATERIALIZED (SELECT id, p, leaf, p AS rank FROM b)"""
    for i in range(1, k + 1):
        out += f""", r{i} AS MATERIALIZED (SELECT r.id, r.p, r.leaf, 0.15 * r.p + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE leaf) * r.p) AS rank
FROM r{i - 1} r LEFT JOIN (SELECT s.dst, sum(q.rank * s.share) AS got FROM s JOIN r{i - 1} q ON q.id = s.src GROUP BY s.dst) g ON g.dst = r.id)"""
    return out + f" SELECT id, round(rank, 9) AS rank FROM r{k}"


@query(GRAPH + _steps(5, "SELECT id, 1.0 / (SELECT count(*) FROM v) AS p FROM v"))
def pagerank_k(t):
    return graph.pagerank(graph.adjacency(t.e), iterations=5, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


SEEDS = "CASE WHEN lower(name) = 'ledger' THEN 30.0 ELSE 0.0 END + CASE WHEN name ILIKE '%ledger%' OR coalesce(file ILIKE '%ledger%', false) OR coalesce(container ILIKE '%ledger%', false) THEN 10.0 ELSE 0.0 END"


@query(GRAPH + _steps(5, f"""SELECT v.id, (coalesce(z.w, 0) / (SELECT sum(w) FROM z0 JOIN v USING (id)) + 0.15 / (SELECT count(*) FROM v)) / 1.15 AS p FROM v LEFT JOIN z0 z ON z.id = v.id""")
       .replace(", a0 AS (", f", z0 AS (SELECT id, CAST({SEEDS} AS DOUBLE) AS w FROM n WHERE {SEEDS} > 0), a0 AS (", 1))
def pagerank_seeded_k(t):
    return graph.pagerank(graph.adjacency(t.e), graph.seeds_from_terms(t.n, ["ledger"]), iterations=5, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


@query()
def pagerank(t):
    """Ranks to convergence; pagerank_k compares five steps of the same operator with SQL."""
    return graph.pagerank(graph.adjacency(t.e)).select("id", F.round("rank", 9).alias("rank"))


@query()
def pagerank_seeded(t):
    return graph.pagerank(graph.adjacency(t.e), graph.seeds_from_terms(t.n, ["ledger"])).select("id", F.round("rank", 9).alias("rank"))


@query(GRAPH + f"SELECT id, CAST({SEEDS} AS DOUBLE) AS weight FROM n WHERE {SEEDS} > 0")
def seed_terms(t):
    return graph.seeds_from_terms(t.n, ["ledger"])


REACH = """, t0 AS (SELECT min(dst) AS id FROM (SELECT dst, count(*) AS c FROM e WHERE kind = 'calls' GROUP BY dst ORDER BY c DESC, dst LIMIT 1)),
l1 AS (SELECT DISTINCT src AS id FROM e WHERE kind IN ('calls', 'imports', 'extends') AND dst IN (FROM t0) AND src NOT IN (FROM t0)),
l2 AS (SELECT DISTINCT src AS id FROM e WHERE kind IN ('calls', 'imports', 'extends') AND dst IN (FROM l1) AND src NOT IN (FROM t0) AND src NOT IN (FROM l1))"""


def _most_called(t) -> DataFrame:
    """(id) of the target of most calls, none without calls."""
    return t.e.where("kind = 'calls'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "id").limit(1).select("id")


@query(GRAPH + REACH + " SELECT id, 1 AS distance FROM l1 UNION ALL SELECT id, 2 FROM l2")
def blast_radius(t):
    return graph.reach(t.e, _most_called(t), vocab.SYMBOL_KINDS, 2).select("id", "distance")


HOMES = """, hm AS (SELECT n.id, g.grp, coalesce(s.name, n.service, n.repo) AS service FROM n LEFT JOIN g USING (id) LEFT JOIN sv s ON s.id = g.grp)"""


@query(GRAPH + MEMBERS + HOMES + REACH + """, d AS (SELECT id FROM l1 UNION SELECT id FROM l2),
f AS (SELECT grp, service, 'origin' AS reason FROM hm JOIN t0 USING (id) WHERE service IS NOT NULL UNION SELECT grp, service, 'symbol' FROM hm JOIN d USING (id) WHERE service IS NOT NULL)
SELECT service, reason FROM f UNION SELECT DISTINCT c.name, 'caller' FROM e JOIN (SELECT DISTINCT grp, service FROM f WHERE grp IS NOT NULL) s ON e.dst = s.grp JOIN n c ON c.id = e.src WHERE e.kind IN ('http', 'event', 'depends-on') AND c.name <> s.service""")
def affected_services(t):
    return estate.affected_services(t.e, t.n, t.members, _most_called(t))


@query(GRAPH + MEMBERS + """, s AS (SELECT DISTINCT g.grp FROM n JOIN g USING (id) WHERE n.kind = 'route')
SELECT DISTINCT sv.name AS service, n.kind, n.name FROM s JOIN sv ON sv.id = s.grp JOIN e ON e.src = s.grp JOIN n ON n.id = e.dst WHERE e.kind IN ('exposes', 'produces') AND n.kind IN ('route', 'topic')""")
def contracts(t):
    routes = t.n.where("kind = 'route'").select("id").join(t.members, "id")
    return estate.contracts_of(t.e, t.n, routes.select(F.col("grp").alias("id")))


PATHS = """, a0 AS (SELECT src AS id FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), goal AS (SELECT DISTINCT dst AS id FROM e WHERE kind = 'writes-table'),
v0 AS (SELECT id, NULL AS parent, NULL AS via, NULL AS evidence FROM a0)"""
for _k in range(1, 7):
    _seen = " AND ".join(f"dst NOT IN (SELECT id FROM v{j})" for j in range(_k))
    _open = " AND ".join(f"NOT EXISTS (SELECT 1 FROM v{j} JOIN goal USING (id))" for j in range(_k))
    PATHS += f""", w{_k} AS (SELECT dst AS id, min({{'s': src, 'k': kind, 'e': evidence}}) AS x FROM e WHERE src IN (SELECT id FROM v{_k - 1}) AND {_seen} AND {_open} GROUP BY dst),
v{_k} AS MATERIALIZED (SELECT id, x.s AS parent, x.k AS via, x.e AS evidence FROM w{_k})"""
PATHS += ", lv AS (" + " UNION ALL ".join(f"SELECT {k} AS step, * FROM v{k}" for k in range(7)) + "), hit AS (SELECT * FROM lv JOIN goal USING (id) ORDER BY step, id LIMIT 1)"
PATHS = PATHS.replace("SELECT * FROM lv JOIN goal USING (id)", "SELECT lv.* FROM lv JOIN goal USING (id)")
PATHS += ", " + ", ".join(
    [f"p6 AS (SELECT * FROM hit WHERE step = 6)"] + [f"p{k} AS (SELECT * FROM hit WHERE step = {k} UNION ALL SELECT lv.* FROM lv JOIN p{k + 1} q ON lv.step = {k} AND lv.id = q.parent)" for k in range(5, -1, -1)]
)
PATHS += " " + " UNION ALL ".join(f"SELECT step, id, via, evidence FROM p{k}" for k in range(7))


@query(GRAPH + PATHS)
def shortest_path(t):
    """Steps between two hubs of the estate; breadth-first."""
    e = t.e
    top = e.groupBy("src").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "src").limit(1).select(F.col("src").alias("id"))
    far = e.where("kind = 'writes-table'").select(F.col("dst").alias("id")).distinct()
    return graph.shortest_path(e, top, far)


@query()
def service_layers(t):
    e = t.e.where(F.col("kind").isin("http", "event", "depends-on"))
    return graph.layering(e.select("src", "dst"))


# --- history ----------------------------------------------------------------------------


@query(CHANGES + "SELECT repo, path, count(*) AS revisions, count(DISTINCT author) AS authors, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, min(date) AS first_change, max(date) AS last_change FROM ch GROUP BY repo, path")
def file_metrics(t):
    return history.file_metrics(t.ch)


@query(CHANGES + "SELECT repo, path, author, commits, added, last FROM own")
def ownership(t):
    return t.own


@query(CHANGES + """SELECT repo, path, min({'k': -commits, 'a': author}).a AS main_author, round(max(commits) / CAST(sum(commits) AS DOUBLE), 4) AS author_share FROM own GROUP BY repo, path""")
def main_author(t):
    return history.main_author(t.own)


@query(CHANGES + """, m AS (SELECT repo, path, max(commits) / CAST(sum(commits) AS DOUBLE) AS share, sum(commits) AS revisions FROM own GROUP BY repo, path)
SELECT repo, path, round(share, 4) AS author_share FROM m WHERE share >= 0.8 AND revisions >= 3""")
def bus_factor(t):
    own = t.own
    rev = own.groupBy("repo", "path").agg(F.sum("commits").alias("revisions"), (F.max("commits") / F.sum("commits").cast("double")).alias("share"))
    return rev.where("share >= 0.8D AND revisions >= 3").select("repo", "path", F.round("share", 4).alias("author_share"))


@query(CHANGES + "SELECT author, count(DISTINCT repo || '|' || path) AS files, CAST(sum(commits) AS BIGINT) AS commits, count(DISTINCT repo) AS repos, max(last) AS last FROM own GROUP BY author")
def knowledge_map(t):
    return history.knowledge(t.own)


@query(CHANGES + """, s AS (SELECT repo, min(service) AS service FROM repos GROUP BY repo)
SELECT month, coalesce(service, repo) AS service, repo, count(DISTINCT sha) AS commits, count(DISTINCT author) AS authors, count(DISTINCT path) AS files, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted
FROM ch_all LEFT JOIN s USING (repo) GROUP BY ALL""")
def timeline_monthly(t):
    return history.timeline(t.commits, t.repos)


@query(CHANGES + """, s AS (SELECT repo, min(service) AS service FROM repos GROUP BY repo),
tl AS (SELECT month, coalesce(service, repo) AS service, repo, count(DISTINCT sha) AS commits, count(DISTINCT author) AS authors, count(DISTINCT path) AS files, sum(added) AS added, sum(deleted) AS deleted FROM ch_all LEFT JOIN s USING (repo) GROUP BY ALL)
SELECT month, service, CAST(sum(commits) AS BIGINT) AS commits, CAST(sum(files) AS BIGINT) AS files, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, max(authors) AS authors FROM tl GROUP BY month, service""")
def timeline_rollup(t):
    g = history.timeline(t.commits, t.repos).groupBy("month", "service")
    return g.agg(*[F.sum(c).alias(c) for c in ("commits", "files", "added", "deleted")], F.max("authors").alias("authors"))


@query(CHANGES + "SELECT repo, min(month) AS born FROM ch GROUP BY repo")
def births(t):
    return t.ch.groupBy("repo").agg(F.min("month").alias("born"))


@query("""WITH r AS (SELECT repo, path, max(revisions) AS revisions, max(complexity) AS complexity FROM file_metrics GROUP BY repo, path), m AS (SELECT max(revisions) AS mr, max(complexity) AS mc FROM r)
SELECT repo, path, CASE WHEN revisions > 0 AND complexity > 0 THEN round(ln(1 + CAST(revisions AS DOUBLE)) / ln(1 + CAST(mr AS DOUBLE)) * complexity / mc, 6) ELSE 0.0 END AS hotspot FROM r, m""")
def hotspots(t):
    return history.hotspots(t.file_metrics)


@query("""WITH r AS (SELECT repo, path, max(revisions) AS revisions, max(complexity) AS complexity FROM file_metrics GROUP BY repo, path), m AS (SELECT max(revisions) AS mr, max(complexity) AS mc FROM r),
h AS (SELECT repo, path, round(ln(1 + CAST(revisions AS DOUBLE)) / ln(1 + CAST(mr AS DOUBLE)) * complexity / mc, 6) AS hotspot FROM r, m WHERE revisions > 0 AND complexity > 0)
SELECT repo, path, hotspot FROM h WHERE hotspot > 0 AND repo = (SELECT min(repo) FROM file_metrics) ORDER BY hotspot DESC, path LIMIT 25""")
def hotspots_of_repo(t):
    """Top-k report of one repo: the limit is the feature."""
    first = t.file_metrics.agg(F.min("repo")).first()[0]
    return history.hotspots(t.file_metrics, repo=first, least=0.0).orderBy(F.col("hotspot").desc(), "path").limit(25)


@query()
def stale(t):
    """Files not changed since the end of 2025-11, whatever form their last_change has; SQL has no reader of all forms."""
    at = instants.instants_of_tables(t.file_metrics, t.snapshot, t.repos, t.estates).where("field = 'last_change' AND table_name = 'file_metrics'")
    old = at.where(F.col("utc_us") < 1_764_547_200_000_000).select(F.col("row_id").alias("metric_id"), F.timestamp_micros("utc_us").cast("timestamp_ntz").alias("changed"))
    return t.file_metrics.select("metric_id", "repo", "path").distinct().join(old.distinct(), "metric_id").select("repo", "path", "changed")


COCHANGE = """, z AS (SELECT repo, sha FROM ch GROUP BY repo, sha HAVING count(*) BETWEEN 2 AND 40), q AS (SELECT ch.repo, ch.sha, ch.path FROM ch JOIN z USING (repo, sha)),
p AS (SELECT x.repo, x.path AS a, y.path AS b, count(*) AS shared FROM q x JOIN q y ON x.repo = y.repo AND x.sha = y.sha AND x.path < y.path GROUP BY ALL HAVING count(*) >= 3),
rv AS (SELECT repo, path, count(*) AS n FROM ch GROUP BY repo, path)
SELECT p.repo || '/' || a AS a, p.repo || '/' || b AS b, p.repo AS a_repo, p.repo AS b_repo, shared, ra.n AS a_revs, rb.n AS b_revs, round(CAST(shared AS DOUBLE) / ((ra.n + rb.n) / CAST(2 AS DOUBLE)), 4) AS degree
FROM p JOIN rv ra ON ra.repo = p.repo AND ra.path = a JOIN rv rb ON rb.repo = p.repo AND rb.path = b WHERE CAST(shared AS DOUBLE) / ((ra.n + rb.n) / CAST(2 AS DOUBLE)) >= 0.30"""


@query(CHANGES + COCHANGE)
def cochange_pairs(t):
    """Flagship: which files of a repo change together."""
    return history.cochange(t.ch)


def _cross(groups: str, least: int, factor: str, extra: str = "") -> str:
    return CHANGES + f""", k AS ({groups}), f0 AS (SELECT DISTINCT k.key, ch.repo, ch.repo || '/' || ch.path AS f FROM ch JOIN k USING (repo, sha)),
s AS (SELECT key FROM f0 GROUP BY key HAVING count(DISTINCT repo) >= 2 AND count(*) <= 80), f1 AS (SELECT * FROM f0 WHERE key IN (FROM s)),
p AS (SELECT x.f AS a, y.f AS b, count(*) AS shared FROM f1 x JOIN f1 y ON x.key = y.key AND x.f < y.f AND x.repo <> y.repo GROUP BY ALL HAVING count(*) >= {least}),
rv AS (SELECT repo || '/' || path AS f, count(*) AS n FROM ch GROUP BY ALL)
SELECT a, b, shared, ra.n AS a_revs, rb.n AS b_revs, round(least(1.0, CAST(shared AS DOUBLE) / ((ra.n + rb.n) / CAST(2 AS DOUBLE))) * {factor}, 4) AS degree FROM p JOIN rv ra ON ra.f = a JOIN rv rb ON rb.f = b {extra}"""


TICKETS = r"SELECT DISTINCT repo, sha, unnest(regexp_extract_all(subject, '\b([A-Z][A-Z0-9]{1,9}-[0-9]{1,6})\b', 1)) AS key FROM commits WHERE repo IS NOT NULL AND sha IS NOT NULL"
DAYS = "SELECT DISTINCT repo, sha, author || '|' || substr(date, 1, 10) AS key FROM commits WHERE repo IS NOT NULL AND sha IS NOT NULL AND author IS NOT NULL"


WEEKS = "SELECT DISTINCT repo, sha, coalesce(regexp_extract(subject, '([A-Z]{2,})-', 1), '') || '|' || substr(date, 1, 10) AS key FROM commits WHERE repo IS NOT NULL AND sha IS NOT NULL AND regexp_matches(subject, '[A-Z]{2,}-')"


@query(_cross(WEEKS, 1, "CAST(1 AS DOUBLE)"))
def ticket_cochange(t):
    """Files of different repos that a ticket queue moves on one day; whole ticket keys never cross repos in the supplied commits."""
    day = F.concat_ws("|", F.coalesce(F.regexp_extract("subject", "([A-Z]{2,})-", 1), F.lit("")), F.substring("date", 1, 10))
    rows = t.commits.where("repo IS NOT NULL AND sha IS NOT NULL").where(F.col("subject").rlike("[A-Z]{2,}-"))
    return history.cross_cochange(t.ch, rows.select("repo", "sha", day.alias("key")).distinct(), 1)


@query(_cross(DAYS, 1, "CAST(0.5 AS DOUBLE)", f"WHERE (a, b) NOT IN (SELECT (a, b) FROM tk)").replace("WITH c AS", "WITH tk AS (SELECT a, b FROM (" + _cross(WEEKS, 1, "CAST(1 AS DOUBLE)") + ")), c AS", 1))
def weak_cochange(t):
    """Files of different repos one author touches on one day, but for pairs that a ticket queue couples already."""
    return history.cross_cochange(t.ch, history.author_days(t.commits), 1, factor=0.5, known=QUERIES["ticket_cochange"](t.spark, t.sf))


@query("SELECT DISTINCT repo, sha, unnest(regexp_extract_all(subject, '\\b([A-Z][A-Z0-9]{1,9}-[0-9]{1,6})\\b', 1)) AS key FROM commits WHERE repo IS NOT NULL AND sha IS NOT NULL")
def commit_tickets(t):
    return history.tickets(t.commits)


@query(CHANGES + """, a AS (SELECT repo, author, CAST(sum(commits) AS BIGINT) AS commits FROM own GROUP BY ALL)
SELECT repo, author, commits, row_number() OVER (PARTITION BY repo ORDER BY commits DESC, author) AS place FROM a QUALIFY place <= 5""")
def top_owners(t):
    return history.top_owners(t.own)


@query(CHANGES + """, a AS (SELECT repo, author, sum(commits) AS c FROM own WHERE repo IN (SELECT repo FROM repos WHERE estate IN (SELECT min(estate) FROM repos)) GROUP BY ALL),
k AS (SELECT author, c FROM a QUALIFY row_number() OVER (PARTITION BY repo ORDER BY c DESC, author) <= 5)
SELECT author, CAST(sum(c) AS BIGINT) AS score FROM k GROUP BY author ORDER BY score DESC, author LIMIT 5""")
def owners_scored(t):
    first = t.repos.agg(F.min("estate").alias("estate"))
    return estate.owner_scores(t.own, t.repos.join(first, "estate", "left_semi"))


@query(CHANGES + """, cf AS (SELECT DISTINCT repo, split_part(path, '/', -1) AS rel FROM ch WHERE date >= '2026-06-01')
SELECT author, CAST(sum(commits) AS BIGINT) AS commits FROM own JOIN cf ON cf.repo = own.repo AND (own.path = cf.rel OR ends_with(own.path, '/' || cf.rel)) GROUP BY author ORDER BY commits DESC, author LIMIT 6""")
def reviewers(t):
    changed = t.ch.where("date >= '2026-06-01'").select("repo", F.substring_index("path", "/", -1).alias("rel")).distinct()
    return history.reviewers(t.own, changed)


@query("""WITH s AS (SELECT CASE WHEN a > b THEN b ELSE a END AS a, CASE WHEN a > b THEN a ELSE b END AS b, max(shared) AS shared, max(degree) AS degree, bool_or(cross_repo) AS cross_repo FROM coupling WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY 1, 2)
SELECT a, b, shared, degree, cross_repo FROM s ORDER BY cross_repo DESC, degree DESC NULLS LAST, a, b LIMIT 25""")
def coupling_top(t):
    swap = F.col("a") > F.col("b")
    g = t.coupling.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").groupBy(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))
    rows = g.agg(F.max("shared").alias("shared"), F.max("degree").alias("degree"), F.bool_or("cross_repo").alias("cross_repo"))
    return rows.orderBy(F.col("cross_repo").desc(), F.col("degree").desc_nulls_last(), "a", "b").limit(25)


# --- surface, pull requests, audits ---------------------------------------------------

SURFACE = """SELECT 'service' AS section, name AS item FROM n WHERE kind = 'service' UNION SELECT 'route', coalesce(service, '?') || ' ' || name FROM n WHERE kind = 'route' UNION SELECT 'topic', name FROM n WHERE kind = 'topic'
UNION SELECT 'edge', a.name || ' -' || e.kind || '-> ' || b.name FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.kind = 'service' AND b.kind = 'service' AND a.name <> b.name
UNION SELECT 'writer', b.name || ' <- ' || a.name FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.kind = 'writes-table'"""


@query(GRAPH + SURFACE)
def surface(t):
    return estate.surface(t.e, t.n)


@query(GRAPH + f", o AS ({SURFACE}), x AS ({SURFACE.replace('FROM n WHERE', 'FROM n WHERE live AND').replace('JOIN n a ON', 'JOIN (FROM n WHERE live) a ON').replace('JOIN n b ON', 'JOIN (FROM n WHERE live) b ON')}) SELECT section, item, 'removed' AS change FROM (FROM o EXCEPT FROM x) UNION ALL SELECT section, item, 'added' FROM (FROM x EXCEPT FROM o)")
def surface_drift(t):
    """Surface of the nodes ever seen against the live ones; what removal took away."""
    n, e = t.n, t.e
    return estate.surface_diff(estate.surface(e, n), estate.surface(e, n.where("live")))


@query(f"""WITH x AS (SELECT trim(dst, {WS}) AS d, trim(src, {WS}) AS s, loaded_at < TIMESTAMP '2025-10-01' AS early FROM edges WHERE kind = 'writes-table' AND trim(src, {WS}) <> '' AND trim(dst, {WS}) <> ''),
o AS (SELECT d, list(DISTINCT s) AS o FROM x WHERE early GROUP BY d), n AS (SELECT d, list(DISTINCT s) AS n FROM x WHERE NOT early GROUP BY d)
SELECT d AS table_name, array_to_string(list_sort(list_filter(n, lambda q: NOT list_contains(o, q))), ',') AS gained, array_to_string(list_sort(list_filter(o, lambda q: NOT list_contains(n, q))), ',') AS lost, len(o) <= 1 AND len(n) > 1 AS became_multi
FROM o JOIN n USING (d) WHERE gained <> '' OR lost <> ''""")
def writers_gained_lost(t):
    """Writers of each table among the edges loaded before October 2025 against those loaded since."""
    w = t.edges.where("kind = 'writes-table'").select(strip("dst").alias("table_name"), strip("src").alias("writer"), (F.col("loaded_at") < "2025-10-01").alias("early")).where("table_name <> '' AND writer <> ''")
    return estate.writer_changes(w.where("early"), w.where("NOT early"))


@query(CHANGES.replace("WITH ", GRAPH + ", ", 1) + """, cf AS (SELECT DISTINCT repo, path AS rel FROM ch WHERE date >= '2026-06-01'), h AS (SELECT n.id, coalesce(n.service, n.repo) AS service FROM n JOIN cf ON cf.repo = n.repo AND cf.rel = n.file WHERE n.kind = 'file'),
u AS (SELECT e.kind, a.name AS s, b.name AS d FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.kind IN ('reads-table', 'writes-table')), tt AS (SELECT DISTINCT d FROM u WHERE s IN (SELECT service FROM h))
SELECT DISTINCT 'service' AS section, service AS item FROM h UNION SELECT 'table', d FROM tt UNION SELECT 'multi-writer', d FROM u WHERE kind = 'writes-table' AND d IN (FROM tt) GROUP BY d HAVING count(DISTINCT s) > 1
UNION SELECT 'route', r.name FROM e JOIN n r ON r.id = e.src WHERE e.kind = 'handled-by' AND e.dst IN (SELECT id FROM h)
UNION SELECT 'unmatched', repo || '/' || rel FROM cf WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.kind = 'file' AND n.repo = cf.repo AND n.file = cf.rel)""")
def pr_context(t):
    changed = t.ch.where("date >= '2026-06-01'").select("repo", F.col("path").alias("rel")).distinct()
    return estate.pr_context(t.e, t.n, changed)


@query(GRAPH + MEMBERS + f""", r AS (SELECT name, id, service FROM n WHERE kind = 'route' AND name ILIKE '%ledger%' ORDER BY name, id LIMIT 12), s AS (SELECT DISTINCT sv.name AS service, sv.id AS src FROM r JOIN g USING (id) JOIN sv ON sv.id = g.grp),
x AS (SELECT e.*, s.service AS svc FROM e JOIN s USING (src))
SELECT 'entry' AS stage, name AS item, service FROM r UNION SELECT 'data', {_tail('dst')}, svc FROM x WHERE kind IN ('reads-table', 'writes-table') UNION SELECT 'event', {_tail('dst')}, svc FROM x WHERE kind = 'produces'
UNION SELECT 'consumer', {_tail('dst')}, {_tail('dst')} FROM e WHERE kind = 'consumed-by' AND src IN (SELECT dst FROM x WHERE kind = 'produces')""")
def entity_flow(t):
    return estate.flow(t.e, t.n, t.members, "ledger")


@query(GRAPH + """, a AS (SELECT id FROM n WHERE kind = 'route'), b AS (SELECT DISTINCT src AS id FROM e WHERE kind = 'handled-by'), c AS (SELECT id FROM n WHERE kind = 'topic'), d AS (SELECT DISTINCT dst AS id FROM e WHERE kind = 'produces'),
r AS (SELECT 'routes handled' AS name, (SELECT count(*) FROM a) AS probed, (SELECT count(*) FROM a WHERE id IN (FROM b)) AS produced UNION ALL SELECT 'topics produced', (SELECT count(*) FROM c), (SELECT count(*) FROM c WHERE id IN (FROM d)))
SELECT name, probed, produced, round(produced / CAST(nullif(probed, 0) AS DOUBLE), 4) AS ratio FROM r""")
def audit_ratio(t):
    n, e, key = t.n, t.e, lambda d, c: d.select(F.col(c).alias("key"))
    return estate.audit([
        ("routes handled", key(n.where("kind = 'route'"), "id"), key(e.where("kind = 'handled-by'"), "src")),
        ("topics produced", key(n.where("kind = 'topic'"), "id"), key(e.where("kind = 'produces'"), "dst")),
    ])


@query(r"""SELECT DISTINCT source, subject, substr(sha256(lower(trim(coalesce(source, ''))) || '|' || lower(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(subject, '')), ':[0-9]+\b', '', 'g'), '\b[0-9]+\b', '#', 'g'), '\s+', ' ', 'g'))), 1, 8) AS key
FROM (SELECT repo AS source, subject FROM commits)""")
def ack_keys(t):
    return t.commits.select(F.col("repo").alias("source"), "subject", estate.ack_key(F.col("repo"), F.col("subject")).alias("key")).distinct()


@query(GRAPH + """, m AS (SELECT id, repo FROM n WHERE repo IS NOT NULL) SELECT e.kind, count(DISTINCT e.dst) AS targets, max(e.confidence) AS confidence, (min(e.evidence) FILTER (WHERE e.evidence <> '')) AS first_evidence FROM e WHERE e.kind LIKE 'uses-%' GROUP BY e.kind""")
def usage_summary(t):
    return t.e.where("kind LIKE 'uses-%'").groupBy("kind").agg(F.countDistinct("dst").alias("targets"), F.max("confidence").alias("confidence"), F.min(F.when(F.col("evidence") != "", F.col("evidence"))).alias("first_evidence"))
