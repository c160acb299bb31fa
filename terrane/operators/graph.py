"""Graph operators: adjacency, PageRank, bounded traversals, roll-ups by membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.model import ids, vocab
from terrane.session import cut

DAMPING, TOLERANCE, MOST_ITERATIONS = 0.85, 1e-8, 100


def adjacency(edges: DataFrame, exclude: Sequence[str] = ("uses-library",)) -> DataFrame:
    """(src, dst, w): kind weight times confidence (0.1 at least) times weight (4 at most); null or 0 count as 0.5 and 1."""
    conf = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.5).otherwise(F.col("confidence"))
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    w = vocab.lookup(vocab.KIND_WEIGHT, "kind", 1.0) * F.greatest(F.lit(0.1), conf) * F.least(F.lit(4.0), weight)
    return edges.where(~F.col("kind").isin(*exclude)).select("src", "dst", w.alias("w"))


def pagerank(adj: DataFrame, seeds: DataFrame | None = None, iterations: int = MOST_ITERATIONS, tolerance: float | None = TOLERANCE) -> DataFrame:
    """(id, rank), ranks adding up to 1. Personalised by ``seeds`` (id, weight), each node keeping a floor of 0.15 / n.

    Mass of nodes without out-edges goes to the personal vector. Parallel edges are added first. Links are laid out by src
    once; each step is a join on that layout and one map-side combined sum, cut at its end, and one row of sums (the mass to hand
    out again and the change) that the next step takes as numbers.
    """
    tasks = int(adj.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = adj.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = links.groupBy("src").agg(F.sum("w").alias("out"))
    links = cut(links.join(out, "src").select("src", "dst", F.when(F.col("out") > 0, F.col("w") / F.col("out")).alias("share")).repartition(tasks, "src"))
    nodes = links.select(F.col("src").alias("id"), (F.col("share") > 0).alias("gives")).unionByName(links.select(F.col("dst").alias("id"), F.lit(False).alias("gives")))
    nodes = nodes.groupBy("id").agg((~F.coalesce(F.bool_or("gives"), F.lit(False))).alias("leaf"))
    if seeds is not None:
        nodes = nodes.join(seeds.groupBy("id").agg(F.greatest(F.sum("weight"), F.lit(0.0)).alias("v")), "id", "left").fillna(0.0, ["v"])
    base = cut(nodes.repartition(tasks, "id"))
    n, t = base.agg(F.count("*"), F.sum("v") if seeds is not None else F.lit(0.0)).first()
    if not n:
        return base.select("id", F.lit(0.0).alias("rank"))
    p = F.lit(1.0 / n) if seeds is None else ((F.col("v") / t if t else F.lit(1.0 / n)) + F.lit(0.15 / n)) / F.lit(1.15)
    ranks = base.select("id", "leaf", p.alias("p"), p.alias("rank"))
    lost = ranks.agg(F.sum(F.when(F.col("leaf"), F.col("rank")))).first()[0] or 0.0
    links = links.where("share > 0")
    for _ in range(iterations):
        given = links.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = cut(ranks.join(given, ranks["id"] == given["dst"], "left").select(
            "id", "leaf", "p", F.col("rank").alias("was"),
            (F.lit(1 - DAMPING) * F.col("p") + F.lit(DAMPING) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * F.col("p"))).alias("rank"),
        ))
        lost, moved = new.agg(F.sum(F.when(F.col("leaf"), F.col("rank"))), F.sum(F.abs(F.col("rank") - F.col("was")))).first()
        lost, ranks = lost or 0.0, new.drop("was")
        if tolerance is not None and moved < tolerance:
            break
    return ranks.select("id", "rank")


def seeds_from_terms(nodes: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, weight): 30 for each term that is a node's name, 10 for each that its name, file or container contains; no case."""
    weight = sum(
        (
            F.when(F.lower("name") == t.lower(), 30.0).otherwise(0.0)
            + F.when(F.col("name").ilike(f"%{t}%") | F.coalesce(F.col("file").ilike(f"%{t}%"), F.lit(False)) | F.coalesce(F.col("container").ilike(f"%{t}%"), F.lit(False)), 10.0).otherwise(0.0)
            for t in terms
        ),
        F.lit(0.0),
    )
    return nodes.select("id", weight.alias("weight")).where("weight > 0")


#: So many ids of a frontier, some 200 bytes each, may be broadcast; a larger one meets the edges by a shuffle.
MOST_SENT = 100_000


def _sent(frontier: DataFrame) -> DataFrame:
    return F.broadcast(frontier) if frontier.count() <= MOST_SENT else frontier


def reach(edges: DataFrame, starts: DataFrame, kinds: Sequence[str], depth: int, inbound: bool = True) -> DataFrame:
    """(id, distance, via, evidence, provenance, confidence): breadth-first from ``starts`` (id), one join a level.

    The edge recorded is the first in (kind, evidence, other end) order that reaches a node at its least distance. The edges are cut
    once; a frontier of checked size is sent to them, so an end with a large share of the edges stays spread. Nodes seen leave by
    anti-join, so cycles end.
    """
    near, far = ("dst", "src") if inbound else ("src", "dst")
    e = cut(edges.where(F.col("kind").isin(*kinds)).select(F.col(near).alias("near"), F.col(far).alias("id"), "kind", "evidence", "provenance", "confidence"))
    seen = cut(starts.select("id").distinct())
    frontier, out = seen, None
    for d in range(1, depth + 1):
        hit = e.join(_sent(frontier.select(F.col("id").alias("near"))), "near").join(seen, "id", "left_anti")
        level = cut(
            hit.groupBy("id").agg(F.min(F.struct("kind", "evidence", "near", "provenance", "confidence")).alias("e"))
            .select("id", F.lit(d).alias("distance"), F.col("e.kind").alias("via"), F.col("e.evidence").alias("evidence"), F.col("e.provenance").alias("provenance"), F.col("e.confidence").alias("confidence"))
        )
        out = level if out is None else out.unionByName(level)
        frontier = level.select("id")
        seen = seen.unionByName(frontier)
        if d < depth and frontier.isEmpty():
            break
    return out


def shortest_path(edges: DataFrame, starts: DataFrame, goals: DataFrame, hops: int = 6) -> DataFrame:
    """(step, id, via, evidence) of a directed shortest path from any start to any goal, least ids first; empty if none."""
    e = cut(edges.select("src", "dst", "kind", "evidence"))
    level = starts.select("id", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("evidence")).dropDuplicates(["id"])
    levels, seen = [cut(level)], level.select("id")
    goal = cut(goals.select("id").distinct())
    found = levels[0].join(goal, "id", "left_semi").orderBy("id").limit(1)
    k = 0
    while found.isEmpty() and k < hops:
        k += 1
        nxt = e.join(_sent(levels[-1].select(F.col("id").alias("src"))), "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        nxt = cut(nxt.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("src", "kind", "evidence")).alias("e")).select("id", F.col("e.src").alias("parent"), F.col("e.kind").alias("via"), F.col("e.evidence").alias("evidence")))
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = seen.unionByName(nxt.select("id"))
        found = nxt.join(goal, "id", "left_semi").orderBy("id").limit(1)
    path = found.select(F.lit(k).alias("step"), "id", "parent", "via", "evidence")
    out = path
    for j in range(k - 1, -1, -1):  # one row a step
        path = levels[j].join(path.select(F.col("parent").alias("id")), "id").select(F.lit(j).alias("step"), "id", "parent", "via", "evidence")
        out = out.unionByName(path)
    return out.select("step", "id", "via", "evidence")


def package_key(file: Column, depth: Column | int) -> Column:
    """The directory of a file without scaffold names, its first ``depth`` parts; null without a file, ``(root)`` at the top."""
    dirs = F.filter(F.slice(F.split(file, "/"), 1, F.greatest(F.size(F.split(file, "/")) - 1, F.lit(0))), lambda p: p != "")
    own = F.filter(dirs, lambda p: ~p.isin(*vocab.SCAFFOLD))
    parts = F.when(F.size(own) > 0, own).otherwise(dirs)
    n = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(F.coalesce(file, F.lit("")) == "", None).otherwise(F.when(F.size(parts) == 0, "(root)").otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))


def pick_depth(nodes: DataFrame, low: int = 4, high: int = 45) -> DataFrame:
    """(service, depth): per service the first of 2, 3, 4, 5 that gives low to high packages, else the one that gives most up to high."""
    own = nodes.withColumn("service", F.coalesce("service", "repo")).where("service IS NOT NULL AND file <> ''")
    counts = own.groupBy("service").agg(*[F.countDistinct(package_key(F.col("file"), d)).alias(f"k{d}") for d in (2, 3, 4, 5)])
    first, best = F.lit(None).cast("int"), F.lit(2)
    for d in (5, 4, 3, 2):
        first = F.when(F.col(f"k{d}").between(low, high), d).otherwise(first)
    most = F.lit(0)
    for d in (2, 3, 4, 5):
        better = (F.col(f"k{d}") > most) & (F.col(f"k{d}") <= high)
        best, most = F.when(better, d).otherwise(best), F.when(better, F.col(f"k{d}")).otherwise(most)
    return counts.select("service", F.coalesce(first, best).alias("depth"))


def rollup(edges: DataFrame, members: DataFrame, min_confidence: float = 0.0, kinds: Sequence[str] | None = None) -> DataFrame:
    """(source, target, kind, style, count, confidence, provenance, runtime, calls, evidence) between groups of ``members`` (id, grp).

    Ends without a group and edges inside one drop out. EXTRACTED wins; one citation is kept, the least, not a list.
    """
    e = edges.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence).select("src", "dst", "kind", "confidence", "provenance", "extra", "evidence")
    if kinds:
        e = e.where(F.col("kind").isin(*kinds))
    m = members.where("grp IS NOT NULL").select("id", "grp")
    g = (
        e.join(m.select(F.col("id").alias("src"), F.col("grp").alias("source")), "src")
        .join(m.select(F.col("id").alias("dst"), F.col("grp").alias("target")), "dst").where("source <> target")
    )
    flag = F.coalesce(F.get_json_object("extra", "$.runtime") == "true", F.lit(False))
    calls = F.coalesce(F.get_json_object("extra", "$.calls").try_cast("double"), F.lit(0.0))
    return g.groupBy("source", "target", "kind").agg(
        F.count("*").alias("count"), F.max("confidence").alias("confidence"),
        F.when(F.bool_or(F.col("provenance") == "EXTRACTED"), "EXTRACTED").otherwise("INFERRED").alias("provenance"),
        F.bool_or(flag).alias("runtime"), F.max(calls).alias("calls"), F.min(F.when(F.col("evidence") != "", F.col("evidence"))).alias("evidence"),
    ).withColumn("style", vocab.lookup(vocab.EDGE_STYLE, "kind", "other"))


def services_of(nodes: DataFrame) -> DataFrame:
    """(id, name, estate) of the service nodes; the estate stands before the name in the id, if one does."""
    tail = ids.tail(F.col("id"))
    inside = tail.endswith(F.concat(F.lit("."), F.col("name")))
    return nodes.where("kind = 'service'").select("id", "name", F.when(inside, F.substring(tail, F.lit(1), F.length(tail) - F.length("name") - 1)).alias("estate"))


def estate_members(nodes: DataFrame, repos: DataFrame) -> DataFrame:
    """(id, grp): actors stand for themselves, all else belongs to the node of its service, if there is one.

    The service is told by name, a repo without one by its own name, within the estate of the repo; where the estate holds none of that
    name, by a name that only one service has. Names repeat across estates, so a name alone is not enough.
    """
    top = F.col("kind").isin(*vocab.TOP_KINDS)
    svc = services_of(nodes)
    home = repos.groupBy("repo").agg(F.min("estate").alias("estate"))
    via = F.when(F.col("kind") == "table", F.col("service")).otherwise(F.coalesce("service", "repo"))
    inner = nodes.where(~top).select("id", "repo", via.alias("name")).join(home, "repo", "left")
    own = svc.where("estate IS NOT NULL").groupBy("name", "estate").agg(F.min("id").alias("own"))
    only = svc.groupBy("name").agg(F.min("id").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")
    made = inner.join(own, ["name", "estate"], "left").join(only, "name", "left").select("id", F.coalesce("own", "only").alias("grp")).where("grp IS NOT NULL")
    return nodes.where(top).select("id", F.col("id").alias("grp")).unionByName(made)


def contents(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(grp, kind, n): what each group holds besides itself."""
    return nodes.select("id", "kind").join(members, "id").where("id <> grp").groupBy("grp", "kind").agg(F.count("*").alias("n"))


def expand(edges: DataFrame, members: DataFrame, source: str, target: str, limit: int = 300) -> DataFrame:
    """The edges behind one rolled-up arrow, cited ones first: the same membership that drew it."""
    m = members.where("grp IS NOT NULL")
    got = edges.join(m.where(F.col("grp") == source).select(F.col("id").alias("src")), "src", "left_semi").join(m.where(F.col("grp") == target).select(F.col("id").alias("dst")), "dst", "left_semi")
    order = [(F.col("provenance") != "EXTRACTED").cast("int"), F.col("confidence").desc(), "src", "dst", "kind", "evidence"]
    return got.orderBy(*order).limit(limit).select("src", "dst", "kind", "evidence", "provenance", "confidence")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def prune_dead_ends(edges: DataFrame, least: int = 2) -> DataFrame:
    """Edges whose ends both have at least ``least`` edges, counted once before pruning."""
    keep = degrees(edges).where(F.col("degree") >= least).select("id")
    return induced(edges, keep)


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    return edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi")


def layering(pairs: DataFrame) -> DataFrame:
    """(id, layer): longest path from a source over ``pairs`` (src, dst), back edges cut by the order of first reach.

    A pair whose dst is reached no later than its src (breadth-first from the nodes without predecessors) is a back edge. Both loops go
    on until nothing moves.
    """
    p = cut(pairs.where("src <> dst").select("src", "dst").distinct())
    nodes = p.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    roots = nodes.join(p.select(F.col("dst").alias("id")), "id", "left_anti")
    at = cut(nodes.join(roots.withColumn("d", F.lit(0)), "id", "left"))
    k = 0
    while True:
        k += 1
        new = p.join(at.where(F.col("d") == k - 1).select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct().withColumn("n", F.lit(k))
        at = cut(at.join(new, "id", "left").select("id", F.coalesce("d", "n").alias("d"), (F.col("d").isNull() & F.col("n").isNotNull()).alias("moved")))
        if at.where("moved").isEmpty():
            break
        at = at.select("id", "d")
    order = at.select("id", F.coalesce("d", F.lit(0)).alias("d"))
    dag = cut(
        p.join(order.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(order.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
        .where("ds < dd OR (ds = dd AND src < dst)").select("src", "dst")
    )
    layer = nodes.withColumn("layer", F.lit(0))
    while True:
        up = dag.join(layer.select(F.col("id").alias("src"), "layer"), "src").groupBy("dst").agg((F.max("layer") + 1).alias("up"))
        new = cut(layer.join(up, layer["id"] == up["dst"], "left").select("id", F.greatest("layer", F.coalesce("up", "layer")).alias("layer"), (F.col("up") > F.col("layer")).alias("moved")))
        layer = new.select("id", "layer")
        if new.where("moved").isEmpty():
            break
    return layer


def curvature(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, idx, n): the place of an edge among those between the same two ends, for drawing them apart."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    w = Window.partitionBy(a, b)
    return edges.select("src", "dst", "kind", F.row_number().over(w.orderBy("src", "dst", "kind", "evidence")).cast("bigint").alias("idx"), F.count("*").over(w).alias("n"))
