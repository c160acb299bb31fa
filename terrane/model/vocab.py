"""Fixed values of the graph model: kinds, weights, layers, name lists. Lookups become literal maps inside the plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much importance flows along an edge, by kind.
KIND_WEIGHT = {
    "calls": 3.0, "imports": 1.0, "extends": 2.0, "defines": 0.5, "http": 4.0, "event": 3.5, "depends-on": 2.0, "produces": 2.0,
    "consumed-by": 2.0, "exposes": 1.5, "uses-datastore": 1.5, "uses-library": 0.2, "couples-with": 2.5, "writes-table": 3.0,
    "reads-table": 1.5, "defines-table": 1.0, "routes-to": 0.5, "links-to": 0.5, "uses-cache": 0.5,
}
#: Style class and display weight of an edge, by kind.
EDGE_STYLE = {
    "http": "sync", "event": "async", "produces": "async", "consumed-by": "async", "depends-on": "build", "calls": "code", "imports": "code",
    "extends": "code", "implemented-by": "code", "defines": "structure", "reads-table": "data", "writes-table": "data", "defines-table": "data",
    "uses-datastore": "data", "uses-cache": "data", "uses-library": "build", "exposes": "contract", "calls-route": "contract",
    "handled-by": "contract", "routes-to": "deploy", "links-to": "legacy",
}
#: Display layer of a node, by kind.
LAYER = {
    "host": 0, "legacy-page": 0, "service": 1, "topic": 2, "infra": 2, "datastore": 3, "table": 3, "library": 4, "package": 1, "file": 1,
    "class": 1, "function": 1, "route": 1,
}
TOP_KINDS = ("service", "topic", "datastore", "host", "infra", "legacy-page", "library")
RUNTIME_KINDS = ("http", "event", "produces", "consumed-by", "reads-table", "writes-table", "uses-datastore", "uses-cache", "calls-route")
BUILD_KINDS = ("imports", "extends", "calls", "implemented-by", "depends-on", "uses-library")
WAYPOINT_KINDS = ("topic", "datastore", "table")
WRITING_KINDS = ("writes-table", "produces", "uses-datastore", "uses-cache")
SYMBOL_KINDS = ("calls", "imports", "extends")
SERVICE_KINDS = ("http", "event", "depends-on")
#: Directory names without meaning in a package path.
SCAFFOLD = ("src", "main", "java", "kotlin", "scala", "resources", "com", "org", "net", "io", "app", "lib")
#: Directories that hold no source of their own.
SKIP_DIRS = (
    "node_modules", ".git", ".hg", ".svn", "target", "build", "out", "dist", "vendor", ".venv", "venv", "env", "__pycache__", ".gradle", ".idea",
    ".vscode", "coverage", ".mvn", ".next", ".nuxt", ".terraform", "bower_components", "site-packages", ".tox", ".pytest_cache",
    ".mypy_cache", "bin", "obj", "Pods", "DerivedData", ".serverless", "cdk.out",
)
#: Suffixes of service names, and of environments glued on to them.
SERVICE_SUFFIXES = ("service", "svc", "server", "api", "app", "srv", "ms", "ui", "web", "frontend", "client", "backend", "gateway")
ENV_SUFFIXES = ("dev", "sqe", "uat", "prd", "prod", "qa", "stg", "stage", "test", "local", "int", "perf")
#: Words after which a SQL identifier is no table.
NOT_TABLES = (
    "select where and or on as set values dual join inner left right outer full cross group order by having limit offset union all distinct "
    "case when then else end"
).split()
#: Words a task text is not about.
TASK_STOP = (
    "the a an and or of to in for on with how what where when does do is are be i we you it this that these those from by at as if then than "
    "so but not can could should would please show me tell about work works working code add fix change update implement why which who whom"
).split()
ENGINE_ALIASES = {"postgresql": "postgres", "mariadb": "mysql", "sqlserver": "mssql", "mongodb+srv": "mongodb"}


def lookup(values: Mapping, key: Column | str, default=None) -> Column:
    """A literal map lookup, folded into the plan; no join, no broadcast."""
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    got = F.try_element_at(m, F.col(key) if isinstance(key, str) else key)
    return got if default is None else F.coalesce(got, F.lit(default))
