"""Every question a person or a program may put to a graph: one registry behind the command line, the tool server and the HTTP API."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions import code
from terrane.model import vocab
from terrane.operators import estate, graph, history, resolve, views
from terrane.plans.estate_queries import Tables


@dataclass
class Tool:
    run: Callable[..., DataFrame]
    about: str
    params: dict[str, object] = field(default_factory=dict)


TOOLS: dict[str, Tool] = {}


def tool(about: str, **params):
    def add(f):
        TOOLS[f.__name__.rstrip("_").replace("_", "-")] = Tool(f, about, params)
        return f

    return add


def _ids(t: Tables, name: str) -> DataFrame:
    """(id) of the nodes a person means: by id, by name, or by file."""
    return t.n.where((F.col("id") == name) | (F.lower("name") == name.lower()) | (F.col("file") == name)).select("id")


def _ranks(t: Tables, terms: str = "") -> DataFrame:
    """Ranks of the whole graph, seeded by the words of ``terms``; kept with the tables they were made of."""
    words = tuple(sorted({w.lower() for w in terms.split() if len(w) > 2}))
    kept = t.__dict__.setdefault("ranks", {})
    if words not in kept:
        kept[words] = graph.pagerank(graph.adjacency(t.e), graph.seeds_from_terms(t.n, list(words)) if words else None)
    return kept[words]


def _bus(t: Tables) -> DataFrame:
    per = t.own.groupBy("repo", "path").agg(F.sum("commits").alias("r"), (F.max("commits") / F.sum("commits").cast("double")).alias("author_share"))
    return per.where("author_share >= 0.8D AND r >= 3").select("repo", "path", "author_share")


@tool("Nodes by name or file, exact names first", name="")
def find(t, name):
    return estate.find(t.n, name)


@tool("All edges of a node", name="")
def node(t, name):
    first = _ids(t, name).orderBy("id").first()
    return views.node_detail(t.e, t.n, first["id"] if first else None)


@tool("What a change to a node reaches, in steps against the direction of use", name="", depth=2)
def blast_radius(t, name, depth):
    return graph.reach(t.e, _ids(t, name), vocab.SYMBOL_KINDS, int(depth)).orderBy("distance", "id")


@tool("Services touched by a change to a node: where it lives, what depends on it, who calls those", name="", depth=2)
def impact(t, name, depth):
    return estate.affected_services(t.e, t.n, t.members, _ids(t, name), int(depth))


@tool("A shortest path from one node to another", source="", target="", hops=6)
def path(t, source, target, hops):
    return graph.shortest_path(t.e, _ids(t, source), _ids(t, target), int(hops)).orderBy("step")


@tool("Classes and functions most depends on", terms="", k=20)
def central(t, terms, k):
    return views.central_code(t.e, t.n, _ranks(t, terms), int(k))


@tool("The files most worth reading for a task, within a budget of tokens", task="", tokens=4000)
def map_(t, task, tokens):
    best = views.repo_map(t.n, _ranks(t, task)).withColumn("path", F.concat_ws("/", "repo", "file"))
    sized = best.select("path", "score", "names", code.token_estimate(F.concat_ws(" ", "path", "names")).alias("tokens"))
    return code.budget(sized, int(tokens))


@tool("Links between services with their first citations")
def topology(t):
    return views.topology(t.e, t.n)


@tool("One arrow per pair of services")
def architecture(t):
    return estate.architecture_pairs(t.e, t.n)


@tool("Queues and stores that several services meet in")
def waypoints(t):
    return estate.waypoints(t.e, t.n)


@tool("The estate view: everything rolled up to services and other actors", least_confidence=0.0)
def estate_view(t, least_confidence):
    return graph.rollup(t.e, t.members, float(least_confidence))


@tool("The edges behind an arrow of the estate view", source="", target="")
def expand(t, source, target):
    return graph.expand(t.e, t.members, source, target)


@tool("The packages of a service and what they touch", service="", depth=3)
def service(t, service, depth):
    return views.service_view(t.e, t.n, service, int(depth))


@tool("The best ranked packages of a service", service="", depth=3)
def packages(t, service, depth):
    return views.package_nodes(t.n, _ranks(t), service, int(depth))


@tool("A file and its neighbours", repo="", file="")
def file(t, repo, file):
    return views.file_view(t.e, t.n, repo, file)


@tool("Who reads, writes and declares each table")
def schema(t):
    return estate.data_matrix(t.e, t.n).orderBy(F.col("touched").desc(), "name")


@tool("Routes exposed and topics produced by a service, or by all", service="")
def contracts(t, service):
    s = t.n.where("kind = 'service'")
    return estate.contracts_of(t.e, t.n, (s.where(F.col("name") == service) if service else s).select("id"))


@tool("From the entry routes of an entity to tables, topics and consumers", entity="")
def flow(t, entity):
    return estate.flow(t.e, t.n, t.members, entity)


@tool("Files whose churn and complexity are both high", repo="")
def hotspots(t, repo):
    return history.hotspots(t.file_metrics, repo or None, 0.0).orderBy(F.col("hotspot").desc(), "repo", "path")


@tool("Files that change together")
def coupling(t):
    return history.cochange(t.ch).orderBy(F.col("degree").desc(), "a", "b")


@tool("Who knows a repo, or a path in it", repo="", path="")
def owners(t, repo, path):
    own = t.own
    if repo:
        own = own.where(F.col("repo") == repo)
    if path:
        own = own.where(F.col("path").contains(path))
    return history.top_owners(own)


@tool("Commits, authors and lines by month and service")
def timeline(t):
    return history.timeline(t.commits, t.repos).orderBy("month", "service")


@tool("What is missing or doubtful in the graph")
def gaps(t):
    return views.with_keys(views.gaps(t.e, t.n)).orderBy("category", "detail")


@tool("What to ask the owners")
def questions(t):
    return views.questions(t.e, t.n, _bus(t), history.cochange(t.ch)).orderBy("rule", "place")


@tool("Services and libraries with their build artifacts")
def modules(t):
    return views.modules(t.n)


@tool("Services with their files and links")
def services(t):
    return estate.service_table(t.e, t.n)


@tool("How the graph came about: provenance, runtime and build-time edges")
def stats(t):
    return estate.coverage(t.e, t.n)


@tool("The surface of the estate as one comparable list")
def surface(t):
    return estate.surface(t.e, t.n)


@tool("What a change of files touches; files as repo:path, by commas", files="")
def pr_check(t, files):
    rows = [x.strip().partition(":")[::2] for x in files.split(",") if ":" in x]
    return estate.pr_context(t.e, t.n, t.spark.createDataFrame(rows, "repo string, rel string"))


@tool("Ranks of all nodes, best first", terms="")
def rank(t, terms):
    return _ranks(t, terms).orderBy(F.col("rank").desc(), "id")


@tool("The service a name in any spelling means", token="")
def resolve_(t, token):
    s = t.n.where("kind = 'service'").select("name", F.col("id").alias("ord"))
    return resolve.resolve_tokens(t.spark.createDataFrame([(token,)], "token string"), s)


@tool("Whether the tables hold what the questions need")
def doctor(t):
    need = {"nodes": ("id", "kind", "name", "loaded_at"), "edges": ("src", "dst", "kind", "loaded_at"), "commits": ("repo", "sha", "files"), "repos": ("repo", "estate")}
    rows = []
    for name, columns in need.items():
        try:
            df = getattr(t, name)
            lost = [c for c in columns if c not in df.columns]
            rows.append((name, "ok" if not lost and not df.isEmpty() else "empty" if not lost else "no " + ", ".join(lost)))
        except Exception as e:  # noqa: BLE001 - the report is the point
            rows.append((name, type(e).__name__))
    return t.spark.createDataFrame(rows, "table_name string, state string")


def call(t: Tables, name: str, args: dict | None = None) -> DataFrame:
    """The rows a tool gives; arguments it doesn't have are refused, missing ones take their defaults."""
    if name not in TOOLS:
        raise ValueError(f"no tool {name!r}")
    x, args = TOOLS[name], dict(args or {})
    if extra := set(args) - set(x.params):
        raise ValueError(f"{name} takes no {', '.join(sorted(extra))}")
    return x.run(t, **{**x.params, **args})
