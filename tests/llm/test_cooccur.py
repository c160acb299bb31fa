import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

from conftest import rows

from terrane.llm import cooccur
from terrane.session import scratch

C = "repo string, sha string, subject string, files array<struct<path:string,added:bigint,deleted:bigint>>, loaded_at timestamp_ntz"
B = "grp string, basket string, items array<string>"


def brute(baskets):
    pairs, items, groups = Counter(), Counter(), Counter()
    for (g, _), its in baskets.items():
        groups[g] += 1
        items.update((g, x) for x in its)
        if 2 <= len(its) <= 40:
            pairs.update((g, a, b) for a, b in combinations(sorted(its), 2))
    return {(g, a, b, n, items[g, a], items[g, b], groups[g]) for (g, a, b), n in pairs.items() if n >= 3}


def test_increments_equal_a_count_from_scratch(spark):
    rnd, state, now = random.Random(1), cooccur.PairTable(spark, scratch(spark, "t"), buckets=4), {}
    for _ in range(3):
        batch = {}
        for _ in range(60):
            key = (rnd.choice("pq"), f"b{rnd.randint(0, 50)}")
            batch[key] = None if rnd.random() < 0.15 else sorted(rnd.sample("abcdefgh", rnd.randint(0, 5)))
        state.apply(spark.createDataFrame([(*k, v) for k, v in batch.items()], B))
        for k, v in batch.items():
            now.pop(k, None) if v is None else now.__setitem__(k, v)
        got = {tuple(r) for r in state.scores().select("grp", "a", "b", "shared", "a_revs", "b_revs", "n").collect()}
        assert got == brute(now)
    again = cooccur.PairTable(spark, state.root)  # the state outlives the job
    assert {tuple(r)[:4] for r in again.scores().collect()} == {x[:4] for x in brute(now)}


def test_a_late_older_delivery_changes_nothing_and_a_revert_withdraws(spark):
    t = lambda d: datetime(2025, 1, d)
    f = lambda *p: [(x, 1, 1) for x in p]
    state = cooccur.PairTable(spark, scratch(spark, "t"))
    step = lambda *rows: state.apply(cooccur.commit_baskets(spark.createDataFrame(list(rows), C)))
    moved = step(*[("r", str(k), "x", f("a", "b"), t(5)) for k in range(4)], ("q", "0", "x", f("a"), t(5)))
    assert rows(moved) == [("q",), ("r",)]
    assert [tuple(r)[:7] for r in state.scores().collect()] == [("r", "a", "b", 4, 4, 4, 4)]
    step(("r", "0", "x", f("a", "c"), t(1)))  # older than what is there
    assert [tuple(r)[:7] for r in state.scores().collect()] == [("r", "a", "b", 4, 4, 4, 4)]
    assert rows(step(("r", "0", "Revert it", f("a", "b"), t(9)))) == [("r",)]
    assert [tuple(r)[:7] for r in state.scores().collect()] == [("r", "a", "b", 3, 3, 3, 3)]
    assert step(("r", "1", "x", f("a", "b"), t(6))).count() == 0  # delivered again as it is
    assert cooccur.PairTable(spark, state.root).scores().count() == 1


def test_commit_rules(spark, clash):
    t = datetime(2025, 1, 1)
    f = lambda *p: [(x, 1, None) for x in p]
    data = [("r", str(k), "x", f("a", "lib/{old => new}/b"), t + timedelta(days=k)) for k in range(4)]
    data += [("r", "0", "x", f("a", "lib/{old => new}/b"), t + timedelta(days=9))]  # delivered again
    data += [("r", "m", "Merge it", f("a", "lib/new/b"), t), ("r", "v", "revert x", f("a"), t), ("r", "n", None, f("c", "old => c", None, ""), None), ("r", None, "x", f("a"), t), (None, "1", "x", f("a"), t), ("r", "e", "y", None, t)]
    data += [("r", f"z{k}", "x", f("other"), t) for k in range(8)]
    df = clash(spark.createDataFrame(data, C))
    got = cooccur.coupled(df)
    assert [tuple(r)[:7] for r in got.collect()] == [("r", "a", "lib/new/b", 4, 4, 4, 14)]
    assert rows(cooccur.found(df)) == [("r/a", "r/lib/new/b")]


def test_large_baskets_count_for_items_only(spark):
    t = datetime(2025, 1, 1)
    many = [(f"f{k:02d}", 1, 1) for k in range(41)]
    df = spark.createDataFrame([("r", str(k), "x", many, t) for k in range(3)] + [("r", f"s{k}", "x", many[:2], t) for k in range(3)], C)
    assert [tuple(r)[:7] for r in cooccur.coupled(df).collect()] == [("r", "f00", "f01", 3, 6, 6, 6)]


def test_empty(spark):
    assert cooccur.found(spark.createDataFrame([], C)).count() == 0
