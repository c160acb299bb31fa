"""Mixing sources to target weights: subset-sum budget fitting over counts of documents by exact token length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import tokenizer
from terrane.session import cut


def lengths(documents: DataFrame, tokenizer_path: str = tokenizer.DEFAULT) -> DataFrame:
    """(doc_id, source, n_tokens). Null texts have no tokens; a null source is no target's source and is left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer.load(tokenizer_path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    rows = documents.where("source IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "source", "text")
    return rows.mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


@dataclass
class Plan:
    """How a source fills its budget: whole passes over all documents, then ``take[length]`` documents once more."""

    source: str
    weight: float
    budget: int
    available: int
    passes: int
    take: dict[int, int]

    @property
    def tokens(self) -> int:
        return self.passes * self.available + sum(k * n for k, n in self.take.items())


#: The remaining budget, in tokens, that dynamic programming fills.
REMAINDER = 8_000


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length come nearest to ``budget`` tokens from below.

    The remaining budget is the last REMAINDER tokens; it is filled by a bounded-knapsack programme over reachable sums, whose work is
    lengths x remaining budget, whatever the corpus size. What is above it is laid down before, in proportion to what there is of
    each length, so the selection keeps the source's mix of lengths; both take the lengths in a scattered order, so that neither short
    nor long documents are preferred. A budget within the remainder is met as nearly as any selection can; beyond it the gap is that
    of the last programme, and is reported.
    """
    left = {k: n for k, n in counts.items() if k > 0 and n > 0}
    total = sum(k * n for k, n in left.items())
    take: dict[int, int] = {}
    if budget >= total:
        return left
    rest = budget
    exact_below = REMAINDER
    order = sorted(left, key=lambda k: k * 0x9E3779B97F4A7C15 % 2**64)
    if rest > exact_below:
        share = (rest - exact_below // 2) / total
        # fractions are carried from length to length, so that lengths of few documents get their share too
        due = 0.0
        for k in order:
            due += left[k] * share
            take[k] = max(0, min(int(due), left[k], rest // k))
            due -= take[k]
            rest -= k * take[k]
        left = {k: n - take[k] for k, n in left.items()}
        for k in order:  # what the carried rest left above the programme's range
            more = min(left[k], max(0, (rest - exact_below) // k))
            take[k] += more
            left[k] -= more
            rest -= more * k
    rest = int(rest)
    ks = [k for k in order if left[k] > 0 and k <= rest]
    # used[j][s]: fewest documents of length ks[j] with which sum s is first reached, -1 if s is not reached by then
    reached = np.zeros(rest + 1, dtype=bool)
    reached[0] = True
    steps = []
    for k in ks:
        used = np.where(reached, 0, -1).astype(np.int32)
        limit = min(left[k], rest // k)
        # per residue class, the distance to the last sum that was reached before
        width = -(-(rest + 1) // k)
        pad = np.full(width * k, -1, dtype=np.int32)
        pad[: rest + 1] = used
        grid = pad.reshape(width, k)
        at = np.where(grid == 0, np.arange(width)[:, None], -(10**9))
        gap = np.arange(width)[:, None] - np.maximum.accumulate(at, axis=0)
        grid = np.where(gap <= limit, gap, -1).astype(np.int32)
        used = grid.reshape(-1)[: rest + 1]
        now = used >= 0
        if (now & ~reached).any():  # a length that reaches no new sum is never needed
            steps.append((k, used.astype(np.int16)))
        reached = now
        if reached[rest]:
            break
    s = int(np.flatnonzero(reached).max())
    for k, used in reversed(steps):
        n = int(used[s])
        if n:
            take[k] = take.get(k, 0) + n
            s -= n * k
    return {k: n for k, n in take.items() if n}


def plan(counts: dict[str, dict[int, int]], targets: list[tuple[str, float, int]], total: int | None = None) -> list[Plan]:
    """Budgets and selections. A source without documents or weight gives nothing; its weight is spread over the others.

    Without ``total``, the largest mix is made in which every source still meets its share, capped repeats included.
    With a ``total`` that some source cannot fill, that source gives all it may and the shortfall goes to the others.
    """
    size = {s: sum(k * n for k, n in counts.get(s, {}).items()) for s, _, _ in targets}
    live = {s: w for s, w, r in targets if w and w > 0 and r and r > 0 and size[s] > 0}
    cap = {s: size[s] * r for s, w, r in targets if s in live}
    if not live:
        return [Plan(s, w or 0.0, 0, size[s], 0, {}) for s, w, _ in targets]
    if total is None:
        total = int(min(cap[s] * sum(live.values()) / w for s, w in live.items()))
    budget: dict[str, int] = {}
    open_, rest = dict(live), total
    while open_:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if rest * w / weight >= cap[s]]
        if not full:
            budget |= {s: int(rest * w / weight) for s, w in open_.items()}
            break
        spent = 0
        for s in full:
            budget[s] = cap[s]
            spent += cap[s]
            del open_[s]
        rest = max(0, rest - spent)
    out = []
    for s, w, r in targets:
        b = budget.get(s, 0)
        passes = b // size[s] if size[s] else 0
        take = fit(counts[s], b - passes * size[s]) if b and passes < (r or 0) else {}
        out.append(Plan(s, w or 0.0, b, size[s], int(passes), take))
    return out


def selection(sized: DataFrame, plans: list[Plan], seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, uses): within a source and length, documents in the order of a seeded hash.

    Ranks are taken per (source, length, shard): the count per length is split over hash shards in proportion, so
    that no (source, length) group has to be sorted in one task.
    """
    spark = sized.sparkSession
    rows = [(p.source, k, int(n)) for p in plans for k, n in p.take.items()]
    take = spark.createDataFrame(rows, "source string, n_tokens bigint, take bigint")  # at most lengths x sources
    passes = spark.createDataFrame([(p.source, p.passes) for p in plans], "source string, passes int")
    key = F.xxhash64(F.lit(seed), "doc_id", "source")
    # quantile by hash: a first cut of each group by count per hash bucket, exact inside the one bucket that is split
    keyed = sized.withColumn("h", key).withColumn("bucket", F.shiftrightunsigned("h", 52))
    per = keyed.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("n")).join(take, ["source", "n_tokens"])
    w = Window.partitionBy("source", "n_tokens").orderBy("bucket")  # at most 4096 rows a group
    per = per.withColumn("before", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))
    per = per.select("source", "n_tokens", "bucket", F.greatest(F.least(F.col("take") - F.col("before"), F.col("n")), F.lit(0)).alias("want"), "n")
    full = keyed.join(per, ["source", "n_tokens", "bucket"], "left")
    split = F.coalesce(F.col("want") > 0, F.lit(False)) & (F.col("want") < F.col("n"))
    inside = Window.partitionBy("source", "n_tokens", "bucket").orderBy("h", "doc_id")
    edge = full.where(split).withColumn("rank", F.row_number().over(inside)).withColumn("extra", (F.col("rank") <= F.col("want")).cast("int"))
    sure = full.where(~split).withColumn("extra", (F.coalesce("want", F.lit(0)) > 0).cast("int"))
    cols = ["doc_id", "source", "n_tokens", "extra"]
    return (
        sure.select(*cols).unionByName(edge.select(*cols)).join(passes, "source")
        .withColumn("uses", F.col("passes") + F.col("extra")).where("uses > 0 AND n_tokens > 0")
        .select("doc_id", "source", "n_tokens", F.col("uses").cast("int").alias("uses"))
    )


def mix(documents: DataFrame, mix_targets: DataFrame, total: int | None = None, seed: int = 0, tokenizer_path: str = tokenizer.DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(selection, report). The report has every target: tokens available and used, the gap to its budget, documents, target and reached share.

    Repeated documents (by doc_id) count once. Target rows with a null source are left out; of several rows
    for one source the least weight and repeats hold. Documents without tokens are never used.
    """
    spark = documents.sparkSession
    targets = [
        (r["source"], float(r["weight"] or 0), int(r["max_repeats"] or 0))
        for r in mix_targets.where("source IS NOT NULL").groupBy("source").agg(F.min("weight").alias("weight"), F.min("max_repeats").alias("max_repeats")).orderBy("source").collect()
    ]
    wanted = mix_targets.select("source").distinct()
    sized = cut(lengths(documents.join(wanted, "source", "left_semi"), tokenizer_path).groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens")))
    # distinct lengths per source are bounded by the longest document, not by the corpus
    counts: dict[str, dict[int, int]] = {}
    for r in sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).toLocalIterator():
        counts.setdefault(r["source"], {})[r["n_tokens"]] = r["n"]
    plans = plan(counts, targets, total)
    chosen = selection(sized, plans, seed)
    goal = spark.createDataFrame([(p.source, p.weight, p.budget, p.available) for p in plans], "source string, weight double, budget bigint, available_tokens bigint")
    live = sum(p.weight for p in plans if p.budget)
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    all_ = sum(p.tokens for p in plans)
    report = goal.join(got, "source", "left").select(
        "source", "weight", F.when(F.col("budget") > 0, F.col("weight") / F.lit(live or 1.0)).otherwise(0.0).alias("target_share"), "budget", "available_tokens",
        F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("budget") - F.coalesce("tokens", F.lit(0))).alias("gap"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        (F.coalesce("tokens", F.lit(0)) / F.lit(float(all_ or 1))).alias("actual_share"),
    )
    return chosen, report
