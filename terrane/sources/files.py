"""File sources: repositories, source and config files, commit logs, manifests, compose files, specs, POMs, front ends."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.model import vocab
from terrane.operators.history import BORING, TICKET, renamed

LANGUAGES = {
    "java": "java", "kt": "kotlin", "scala": "scala", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript",
    "jsx": "javascript", "mjs": "javascript", "go": "go", "rb": "ruby", "cs": "csharp", "rs": "rust", "php": "php", "swift": "swift", "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "sh": "shell", "bash": "shell", "sql": "sql", "proto": "proto",
}
CONFIG = ("yml", "yaml", "properties", "json", "env", "toml", "xml", "conf", "ini")
FILE = "unit string, path string, lang string, bytes bigint, text string"


def repositories(spark: SparkSession, roots: Sequence[str], depth: int = 4) -> DataFrame:
    """(unit, root, kind): git checkouts up to ``depth`` levels below the roots, else their direct directories. Driver-side listing."""
    found: dict[str, tuple[str, str]] = {}

    def walk(at: str, left: int) -> bool:
        if os.path.isdir(os.path.join(at, ".git")):
            found.setdefault(os.path.realpath(at), (os.path.basename(at), "git"))
            return True
        if left == 0 or not os.path.isdir(at):
            return False
        subs = [os.path.join(at, d) for d in sorted(os.listdir(at)) if d not in vocab.SKIP_DIRS and not d.startswith(".")]
        return any([walk(s, left - 1) for s in subs if os.path.isdir(s) and not os.path.islink(s)])

    for r in roots:
        if not walk(r, depth) and os.path.isdir(r):
            for d in sorted(os.listdir(r)):
                p = os.path.join(r, d)
                if os.path.isdir(p) and d not in vocab.SKIP_DIRS and not d.startswith("."):
                    found.setdefault(os.path.realpath(p), (d, "directory"))
    return spark.createDataFrame([(u, p, k) for p, (u, k) in sorted(found.items())], "unit string, root string, kind string")


def scan(spark: SparkSession, root: str, unit: str, extensions: Sequence[str] | None = None, most_bytes: int = 2_000_000) -> DataFrame:
    """FILE rows of the text files under ``root``: read in parallel by Spark, pruned of directories without source, decoded with replacement. Empty files give no row."""
    ext = tuple(extensions or LANGUAGES)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(ext) + "}").load(root)
    base = "file:" + os.path.abspath(root).rstrip("/") + "/" if "://" not in root else root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + base.replace(".", r"\."), "")
    pruned = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in vocab.SKIP_DIRS) + ")/"
    rows = raw.where(F.col("length") <= most_bytes).withColumn("rel", path).where(~F.col("rel").rlike(pruned))
    lang = vocab.lookup(LANGUAGES, F.lower(F.regexp_extract("rel", r"\.([A-Za-z]+)$", 1)), "other")
    return rows.select(F.lit(unit).alias("unit"), F.col("rel").alias("path"), lang.alias("lang"), F.col("length").alias("bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def commit_log(lines: DataFrame) -> DataFrame:
    """Commits from (repo, value) lines of ``git log --numstat --format=%x01%H%x02%an%x02%aI%x02%s``, one file per repo.

    (repo, sha, author, date, subject, tickets, files). Lines carry their commit by position, so each file is read whole by one task
    per repo; a binary file's dashes are 0.
    """

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for repo, text in zip(pdf["repo"], pdf["text"]):
                for block in (text or "").split("\x01")[1:]:
                    head, _, body = block.partition("\n")
                    f = head.split("\x02")
                    files = [x.split("\t", 2) for x in body.split("\n") if x.count("\t") >= 2]
                    n = lambda v: int(v) if v.isdigit() else 0
                    out.append((repo, *(f + [None] * 4)[:4], [{"path": p, "added": n(a), "deleted": n(d)} for a, d, p in files]))
            yield pd.DataFrame(out, columns=["repo", "sha", "author", "date", "subject", "files"])

    rows = lines.mapInPandas(parse, "repo string, sha string, author string, date string, subject string, files array<struct<path:string,added:bigint,deleted:bigint>>")
    keep = F.filter(F.transform("files", lambda x: F.struct(renamed(x["path"]).alias("path"), x["added"].alias("added"), x["deleted"].alias("deleted"))), lambda x: ~x["path"].rlike(BORING))
    return rows.select("repo", "sha", "author", "date", "subject", F.array_distinct(F.regexp_extract_all("subject", F.lit(TICKET), 1)).alias("tickets"), keep.alias("files"))


def manifests(files: DataFrame) -> DataFrame:
    """(unit, path, name, ecosystem): what build manifests depend on, without repeats."""
    base = F.element_at(F.split("path", "/"), -1)
    pick = lambda cond, eco, names: files.where(cond).select("unit", "path", F.explode(names).alias("name"), F.lit(eco).alias("ecosystem"))
    found = lambda p: F.regexp_extract_all("text", F.lit(p), 1)
    npm = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    none = F.create_map().cast("map<string,string>")
    parts = [
        pick(base == "package.json", "npm", F.concat(F.map_keys(F.coalesce(npm["dependencies"], none)), F.map_keys(F.coalesce(npm["devDependencies"], none)))),
        pick(base.rlike(r"^requirements.*\.txt$"), "pip", found(r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)")),
        pick(base == "go.mod", "go", found(r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v")),
        pick(base.rlike(r"\.gradle(\.kts)?$"), "maven", found(r"""(?:implementation|api|compile|runtimeOnly|compileOnly|testImplementation)\s*\(?\s*["']([^:"']+:[^:"']+)""")),
        pick(base == "pom.xml", "maven", found(r"(?s)<dependency>.*?<artifactId>\s*([^<\s]+)")),
        pick(base == "Cargo.toml", "cargo", found(r"(?m)^([A-Za-z0-9_-]+)\s*=\s*(?:\"[0-9^~*]|\{)")),
        pick(base == "Gemfile", "gem", found(r"""(?m)^\s*gem\s+["']([^"']+)""")),
        pick(base.endswith(".csproj"), "nuget", found(r"<PackageReference\s+Include=\"([^\"]+)")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def poms(files: DataFrame) -> DataFrame:
    """(unit, path, group_id, artifact_id, parent, packaging, modules, dependencies) of Maven files; namespaces ignored."""
    xml = F.regexp_replace(F.regexp_replace("text", r"\sxmlns(:\w+)?=\"[^\"]*\"|\sxsi:\w+=\"[^\"]*\"", ""), r"<\?xml[^>]*\?>", "")
    own = F.regexp_replace(xml, r"(?s)<(parent|dependencies|dependencyManagement|build|profiles|modules)>.*?</\1>", "")
    tag = lambda src, t: F.nullif(F.trim(F.regexp_extract(src, rf"(?s)<{t}>\s*([^<]*)</{t}>", 1)), F.lit(""))
    parent = F.regexp_extract(xml, r"(?s)<parent>(.*?)</parent>", 1)
    return files.where("path LIKE '%pom.xml'").select(
        "unit", "path", F.coalesce(tag(own, "groupId"), tag(parent, "groupId")).alias("group_id"), tag(own, "artifactId").alias("artifact_id"), tag(parent, "artifactId").alias("parent"),
        F.coalesce(tag(own, "packaging"), F.lit("jar")).alias("packaging"), F.regexp_extract_all(xml, F.lit(r"<module>\s*([^<\s]+)"), 1).alias("modules"),
        F.array_distinct(F.regexp_extract_all(xml, F.lit(r"(?s)<dependency>.*?<artifactId>\s*([^<\s]+)"), 1)).alias("dependencies"),
    )


def _parsed(files: DataFrame, schema: str, parse) -> DataFrame:
    """Rows that ``parse(text)`` gives per file, in Arrow batches; a file that can't be read gives none."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for unit, path, text in zip(pdf["unit"], pdf["path"], pdf["text"]):
                try:
                    out += [(unit, path, *r) for r in parse(text or "")]
                except Exception:  # noqa: BLE001 - a broken file is a gap, not a failure
                    continue
            yield pd.DataFrame(out, columns=["unit", "path", *names])

    return files.select("unit", "path", "text").mapInPandas(run, "unit string, path string, " + schema)


def _document(text: str):
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def unreadable(files: DataFrame) -> DataFrame:
    """(category, detail): gap rows of JSON and YAML files that no reader understands, so that none vanishes without a word."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for unit, path, text in zip(pdf["unit"], pdf["path"], pdf["text"]):
                try:
                    _document(text or "")
                except Exception as e:  # noqa: BLE001 - whatever it is, it is reported
                    out.append(("unreadable-file", f"{unit}/{path}: {type(e).__name__}"))
            yield pd.DataFrame(out, columns=["category", "detail"])

    rows = files.where(F.col("path").rlike(r"\.(?:json|ya?ml)$")).select("unit", "path", "text")
    return rows.mapInPandas(run, "category string, detail string")


def compose(files: DataFrame) -> DataFrame:
    """(unit, path, service, image, depends_on, dsn): one row per service and data source of docker-compose files."""

    def parse(text: str):
        import re

        for name, s in ((_document(text) or {}).get("services") or {}).items():
            env = s.get("environment") or {}
            env = {k: str(v) for k, v in env.items()} if isinstance(env, dict) else dict(str(x).partition("=")[::2] for x in env)
            deps = s.get("depends_on") or []
            dsn = [m.group(0) for v in env.values() for m in re.finditer(r"(?:jdbc:)?[a-z0-9+]+://[^\s\"']+/\w+", v)] or [None]
            for d in dsn:
                yield name, s.get("image"), sorted(deps), d

    rows = files.where(F.col("path").rlike(r"(^|/)(docker-)?compose[^/]*\.ya?ml$"))
    return _parsed(rows, "service string, image string, depends_on array<string>, dsn string", parse)


def specs(files: DataFrame) -> DataFrame:
    """(unit, path, kind, owner, method, name): OpenAPI routes, AsyncAPI channels (publish is consumed, subscribe is produced), proto calls."""
    methods = ("get", "put", "post", "delete", "patch", "head", "options", "trace")

    def api(text: str):
        d = _document(text)
        title = ((d or {}).get("info") or {}).get("title")
        if "openapi" in d or "swagger" in d:
            for p, ops in (d.get("paths") or {}).items():
                for m in ops or {}:
                    if m.lower() in methods:
                        yield "route", title, m.upper(), p
        elif "asyncapi" in d:
            for c, ops in (d.get("channels") or {}).items():
                for verb, kind in (("publish", "consumed-by"), ("subscribe", "produces")):
                    if verb in (ops or {}):
                        yield kind, title, verb, c

    schema = "kind string, owner string, method string, name string"
    docs = _parsed(files.where(F.col("path").rlike(r"\.(ya?ml|json)$") & F.col("text").rlike("openapi|swagger|asyncapi")), schema, api)
    proto = files.where("path LIKE '%.proto'").select("unit", "path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(service\s+\w+\s*\{.*?\n\})"), 1)).alias("s"))
    rpc = proto.select("unit", "path", F.lit("rpc").alias("kind"), F.regexp_extract("s", r"service\s+(\w+)", 1).alias("owner"), F.lit("RPC").alias("method"), F.explode(F.regexp_extract_all("s", F.lit(r"\brpc\s+(\w+)"), 1)).alias("name"))
    return docs.unionByName(rpc)


def frontends(files: DataFrame) -> DataFrame:
    """(unit, path, framework): what a package.json builds on, the first of the known frameworks."""
    pkg = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    none = F.create_map().cast("map<string,string>")
    keys = F.concat(F.map_keys(F.coalesce(pkg["dependencies"], none)), F.map_keys(F.coalesce(pkg["devDependencies"], none)))
    name = F.lit(None).cast("string")
    for key, framework in reversed((("@angular/core", "angular"), ("react-native", "react-native"), ("react", "react"), ("vue", "vue"), ("svelte", "svelte"))):
        name = F.when(F.array_contains(keys, key), framework).otherwise(name)
    return files.where("path LIKE '%package.json'").select("unit", "path", name.alias("framework")).where("framework IS NOT NULL")


def definitions(files: DataFrame) -> DataFrame:
    """(unit, path, lang, kind, name, line): classes and functions by the shapes of each language, first on a line wins."""
    shapes = {
        "java": (r"\b(?:class|interface|enum|record)\s+([A-Z]\w*)", r"^\s+(?:public|protected|private|static|final|\s)+[\w<>\[\], ?]+\s+(\w+)\s*\([^;]*$"),
        "python": (r"^\s*class\s+(\w+)", r"^\s*(?:async\s+)?def\s+(\w+)"), "go": (r"^type\s+(\w+)\s+(?:struct|interface)", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"),
        "typescript": (r"\bclass\s+(\w+)", r"\bfunction\s+(\w+)"), "javascript": (r"\bclass\s+(\w+)", r"\bfunction\s+(\w+)"),
        "csharp": (r"\b(?:class|interface|struct|record)\s+(\w+)", r"^\s+(?:public|protected|private|internal)\s[\w<>\[\], ?]+\s+(\w+)\s*\([^;]*$"),
    }
    lines = files.where(F.col("lang").isin(*shapes)).select("unit", "path", "lang", F.posexplode(F.split("text", "\n")).alias("p", "l")).where(F.length("l") <= 2000)
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, (cls, fn) in shapes.items():
        for k, p in (("function", fn), ("class", cls)):
            hit = (F.col("lang") == lang) & F.col("l").rlike(p)
            kind, name = F.when(hit, k).otherwise(kind), F.when(hit, F.regexp_extract("l", p, 1)).otherwise(name)
    words = "if else for while switch return new throw catch do try await function class def".split()
    return lines.select("unit", "path", "lang", kind.alias("kind"), name.alias("name"), (F.col("p") + 1).cast("bigint").alias("line")).where(F.col("name").isNotNull() & ~F.col("name").isin(*words))


def acknowledged(spark: SparkSession, path: str) -> DataFrame:
    """(key, reason) of an acknowledgement file, lines ``<8 hex>: reason``; comments and malformed lines give nothing."""
    shape = r"^\s*\"?([0-9a-f]{8})\"?\s*:\s*(.*)$"
    return spark.read.text(path).where(F.col("value").rlike(shape)).select(F.regexp_extract("value", shape, 1).alias("key"), F.trim(F.regexp_extract("value", shape, 2)).alias("reason"))
