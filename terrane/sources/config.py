"""The estate's configuration: found upward from a directory, read as JSON or YAML, written anew from what lies on disk."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.sources import files as readers

VARIABLE = "TERRANE_CONFIG"
NAMES = ("terrane.yaml", "terrane.yml", "terrane.json", ".terrane.yaml")


def locate(start: str) -> Path | None:
    """The file the variable names, else the first of NAMES in ``start`` or the nearest directory above it."""
    if os.environ.get(VARIABLE):
        return Path(os.environ[VARIABLE])
    at = Path(start).resolve()
    return next((d / n for d in (at, *at.parents) for n in NAMES if (d / n).is_file()), None)


def load(start: str) -> dict:
    """The configuration, empty without a file. A file that is no mapping is refused, as it would silently mean nothing."""
    path = locate(start)
    if path is None:
        return {}
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        got = json.loads(text)
    else:
        import yaml

        got = yaml.safe_load(text)
    if got is None:
        return {}
    if not isinstance(got, dict):
        raise ValueError(f"{path} holds no mapping")
    return got


def services(spark: SparkSession, config: dict) -> DataFrame:
    """(name, ord, token, repo) of the configured services, one row per alias, in the order they are listed."""
    rows = []
    for k, s in enumerate(config.get("services") or []):
        s = {"name": s} if isinstance(s, str) else s
        if s.get("name"):
            rows += [(s["name"], f"{k:06d}", t, s.get("repo")) for t in dict.fromkeys([s["name"], *(s.get("aliases") or [])])]
    return spark.createDataFrame(rows, "name string, ord string, token string, repo string")


def generate(spark: SparkSession, root: str) -> str:
    """A configuration as YAML for the repositories below ``root``: a service per repository or runnable Maven module, its directory as repo."""
    from terrane.sources import topology

    units = readers.repositories(spark, [root]).orderBy("unit").collect()
    out = ["services:"]
    for u in units:
        files = readers.scan(spark, u["root"], u["unit"], ["java", "xml", "yml", "yaml", "properties"])
        mods, _ = topology.reactor(readers.poms(files), files)
        live = [r["name"] for r in mods.where("kind = 'service'").select("name").distinct().orderBy("name").collect()]  # bounded by the modules of one checkout
        for name in live or [u["unit"]]:
            out += [f"  - name: {json.dumps(name)}", f"    repo: {json.dumps(u['unit'])}"] + ([f"    aliases: [{json.dumps(u['unit'])}]"] if name != u["unit"] and len(live) == 1 else [])
    return "\n".join(out) + "\n"


def outside(files: DataFrame, units: DataFrame) -> DataFrame:
    """Files (path) that lie in none of the units (root): content of the root that belongs to no repository."""
    p = F.split("path", "/")
    prefixes = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).alias("root"))
    return files.join(prefixes.join(units.select("root"), "root", "left_semi").select("path").distinct(), "path", "left_anti")
