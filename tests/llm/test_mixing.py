from itertools import product

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import mixing, tokenizer

D = "doc_id bigint, source string, text string"
T = "source string, weight double, max_repeats int"


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 60))
def test_fit_is_the_best_subset_sum(counts, budget):
    take = mixing.fit(counts, budget)
    got = sum(k * n for k, n in take.items())
    assert all(0 < n <= counts[k] for k, n in take.items())
    want = max(s for c in product(*[range(n + 1) for n in counts.values()]) if (s := sum(k * n for k, n in zip(counts, c))) <= budget)
    assert got == want


def test_fit_of_large_budgets_keeps_the_mix_and_hits_the_sum():
    counts = {k: 1000 for k in range(50, 150)}
    take = mixing.fit(counts, 5_000_001)
    assert sum(k * n for k, n in take.items()) == 5_000_001 and min(take.values()) > 300


def test_fit_at_the_rim_of_the_remainder_is_seamless():
    counts = {97: 400, 131: 300, 9000: 5}
    for budget in (19_990, 20_000, 20_010, 35_990, 36_000, 36_010, 60_001):
        take = mixing.fit(counts, budget)
        assert all(n <= counts[k] for k, n in take.items()) and 0 <= budget - sum(k * n for k, n in take.items()) <= 1


def test_plan_spreads_what_a_source_cannot_give():
    plans = {p.source: p for p in mixing.plan({"a": {1: 10}, "b": {1: 1000}}, [("a", 1.0, 2), ("b", 1.0, 1), ("c", 5.0, 9), ("d", 0.0, 1)], total=100)}
    assert (plans["a"].tokens, plans["b"].tokens, plans["c"].tokens, plans["d"].tokens) == (20, 80, 0, 0)
    free = {p.source: p for p in mixing.plan({"a": {1: 10}, "b": {1: 1000}}, [("a", 1.0, 2), ("b", 3.0, 1)])}
    assert (free["a"].tokens, free["b"].tokens) == (20, 60)


def test_mix(spark, clash):
    docs = [(k, "a", "word " * (k % 5 + 1)) for k in range(10)] + [(100 + k, "b", "some more words here") for k in range(300)]
    docs += [(1, "a", "word word "), (900, None, "x"), (901, "a", None), (902, "b", ""), (903, "z", "not a target"), (None, "a", "x")]
    docs += [(904, "b", "long " * 30000)]
    targets = [("a", 1.0, 3), ("b", 2.0, 1), ("none", 1.0, 4), (None, 1.0, 1)]
    chosen, report = mixing.mix(clash(spark.createDataFrame(docs, D)), spark.createDataFrame(targets, T), seed=7)
    size = {k: len(tokenizer.load().encode_ordinary(t)) for k, s, t in docs if t and k is not None and s}
    got = chosen.collect()
    used = {s: sum(r.n_tokens * r.uses for r in got if r.source == s) for s in ("a", "b")}
    assert all(r.n_tokens == size[r.doc_id] for r in got if r.doc_id != 1) and max(r.uses for r in got) <= 3 and len({r.doc_id for r in got}) == len(got)
    rep = {r["source"]: r for r in report.collect()}
    assert rep["a"]["tokens"] == used["a"] and rep["b"]["tokens"] == used["b"] and rep["none"]["tokens"] == 0
    assert rep["a"]["actual_share"] == pytest.approx(1 / 3, abs=0.02) and rep["b"]["actual_share"] == pytest.approx(2 / 3, abs=0.02)
    assert rows(mixing.mix(spark.createDataFrame(docs, D), spark.createDataFrame(targets, T), seed=7)[0]) == rows(chosen)


def test_empty(spark):
    for d, t in (([], [("a", 1.0, 1)]), ([(1, "a", "x")], [])):
        chosen, report = mixing.mix(spark.createDataFrame(d, D), spark.createDataFrame(t, T))
        assert chosen.count() == 0 and report.count() == len(t)
