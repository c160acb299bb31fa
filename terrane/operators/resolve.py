"""Resolution of names to nodes: as-of, longest prefix, priority matches, calls, supertypes, routes, service aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.model import vocab


def enclosing(points: DataFrame, defs: DataFrame) -> DataFrame:
    """points (repo, file, line, …) with the id of the last definition at or before the line; null where there is none.

    One union and one sort per file instead of a range join; definitions of a line come before the points on it.
    """
    keep = [c for c in points.columns if c not in ("repo", "file", "line")]
    p = points.withColumns({"id": F.lit(None).cast("string"), "is_point": F.lit(1)})
    d = defs.select("repo", "file", "line", *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in keep], "id", F.lit(0).alias("is_point"))
    w = Window.partitionBy("repo", "file").orderBy("line", "is_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return p.unionByName(d).withColumn("id", F.last("id", ignorenulls=True).over(w)).where("is_point = 1").drop("is_point")


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, unit): the unit whose root is the longest directory prefix of the path; an equi join on exploded prefixes."""
    p = F.split("path", "/")
    pre = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).alias("root"))
    got = pre.join(roots.select("root", "unit"), "root")
    return got.groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), (F.col("unit")).alias("unit")))["unit"].alias("unit"))


def by_name(uses: DataFrame, defs: DataFrame, one: float, local: float) -> DataFrame:
    """(use columns, id, confidence, state): a name with one definition anywhere gets ``one``, with one in the same repo ``local``.

    uses (name, repo, …), defs (name, repo, id). Counts come from the definitions alone, one aggregate on the name.
    """
    g = defs.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    r = defs.groupBy("name", "repo").agg(F.count("*").alias("here"), F.min("id").alias("own"))
    x = uses.join(g, "name", "left").join(r, ["name", "repo"], "left")
    hit = F.when(F.col("n") == 1, F.col("only")).when(F.col("here") == 1, F.col("own"))
    conf = F.when(F.col("n") == 1, one).when(F.col("here") == 1, local)
    state = F.when(hit.isNotNull(), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("external")
    return x.withColumns({"id": hit, "confidence": conf, "state": state}).drop("n", "only", "here", "own")


def canonical_path(path: Column) -> Column:
    """A URL path as a shape: no query, every parameter and number {}, no doubled or trailing slash."""
    p = F.regexp_replace(path, r"[?#].*$", "")
    p = F.regexp_replace(F.regexp_replace(p, r"\$\{[^}]*\}", "{}"), r"\{[^}]*\}", "{}")
    for _ in range(2):  # neighbours overlap in their slash
        p = F.regexp_replace(p, r"/[0-9]+(/|$)", "/{}$1")
    p = F.regexp_replace(F.regexp_replace(p, "/{2,}", "/"), "(.)/+$", "$1")
    return F.when(p == "", "/").otherwise(p)


def match_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_id, id, priority): a call's route by service, method and path; ANY after exact, the path plus one parameter last."""
    at = lambda m, p, k: F.struct(m.alias("method"), p.alias("path"), F.lit(k).alias("priority"))
    m, p = F.col("method"), F.col("path")
    tries = calls.select("call_id", "service", F.inline(F.array(at(m, p, 1), at(F.lit("ANY"), p, 2), at(m, F.concat(p, F.lit("/{}")), 3), at(F.lit("ANY"), F.concat(p, F.lit("/{}")), 4))))
    hit = tries.join(routes.groupBy("service", "method", "path").agg(F.min("id").alias("id")), ["service", "method", "path"])
    return hit.groupBy("call_id").agg(F.min(F.struct("priority", "id")).alias("m")).select("call_id", F.col("m.id").alias("id"), F.col("m.priority").alias("priority"))


def token_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def token_variants(c: Column) -> Column:
    """Array of the spellings under which a service may be met: image tail, joined words, singular or plural, no suffix, no environment."""
    t = F.trim(c)
    image = F.element_at(F.split(F.element_at(F.split(F.element_at(F.split(t, "@"), 1), "/"), -1), ":"), 1)
    spaced = F.regexp_replace(image, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.transform(F.split(spaced, r"[\s._\-/:]+"), F.lower), lambda w: w != "")
    bare = F.when((F.size(words) > 1) & F.element_at(words, -1).isin(*vocab.SERVICE_SUFFIXES), F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)

    def last_forms(ws: Column) -> Column:
        w = F.element_at(ws, -1)
        other = F.when(w.endswith("ies"), F.concat(F.regexp_replace(w, "ies$", ""), F.lit("y"))).when(w.endswith("ses"), F.regexp_replace(w, "es$", "")).when(w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(F.concat(w, F.lit("s")))
        head = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0)))
        return F.array(F.array_join(ws, ""), F.array_join(F.concat(head, F.array(other)), ""))

    low = token_key(image)
    env = F.array(*[F.when(low.endswith(e) & (F.length(low) > len(e) + 1), F.substring(low, F.lit(1), F.length(low) - len(e))) for e in vocab.ENV_SUFFIXES])
    plain = F.array(token_key(t), low)
    return F.array_sort(F.array_distinct(F.filter(F.concat(plain, F.when(F.size(words) > 0, F.concat(last_forms(words), last_forms(bare))).otherwise(F.array()), env), lambda x: x.isNotNull() & (x != ""))))


def resolve_tokens(tokens: DataFrame, services: DataFrame) -> DataFrame:
    """(token, service): by equal key of any variant; the earliest listed service wins. services (name, ord)."""
    s = services.select("name", "ord", F.explode(token_variants(F.col("name"))).alias("key"))
    first = s.groupBy("key").agg(F.min(F.struct("ord", "name"))["name"].alias("service"))
    t = tokens.select("token", F.posexplode(F.array_distinct(F.concat(F.array(token_key(F.col("token"))), token_variants(F.col("token"))))).alias("place", "key"))
    return t.join(first, "key").groupBy("token").agg(F.min(F.struct("place", "service"))["service"].alias("service"))


def constants(rows: DataFrame) -> DataFrame:
    """(name, value) of constants with one value everywhere; a name with several values is of no use."""
    return rows.groupBy("name").agg(F.min("value").alias("value"), F.max("value").alias("other")).where("value = other").drop("other")


def module_of(path: Column, anchors: tuple[str, ...], fallback: Column) -> Column:
    """The path part after the first anchor that has a directory below it, else ``fallback``."""
    parts = F.split(path, "/")
    out = fallback
    for a in reversed(anchors):
        i = F.array_position(parts, a).cast("int")
        out = F.when((i > 0) & (i + 1 < F.size(parts)), F.try_element_at(parts, i + 1)).otherwise(out)
    return out


def datastore_identity(engine: Column, host: Column, schema: Column) -> Column:
    """engine://host/schema: aliases of engines folded, port dropped, host in lower case, ? for what is missing."""
    e = F.lower(F.coalesce(engine, F.lit("db")))
    named = F.coalesce(vocab.lookup(vocab.ENGINE_ALIASES, e), e)
    h = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(host, F.lit("?")), ":.*$", ""), "^/+|/+$", ""))
    return F.concat(named, F.lit("://"), h, F.lit("/"), F.regexp_replace(F.coalesce(schema, F.lit("?")), "^/+|/+$", ""))
