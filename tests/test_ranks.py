from types import SimpleNamespace

import pytest

from terrane.plans import catalog, estate_queries


@pytest.mark.parametrize("name", ["pagerank", "pagerank_seeded", "central_code_converged"])
def test_registered_ranks_are_converged(spark, name, monkeypatch):
    """Against power iteration in plain Python, run to 1e-12, on links that five steps do not settle."""
    ids_ = [f"n{k}" for k in range(6)]
    pairs = [(ids_[k], ids_[k + 1]) for k in range(5)] + [(ids_[k], "n0") for k in range(1, 5)]
    t = SimpleNamespace(
        e=spark.createDataFrame([(a, b, "calls", 1.0, 1.0) for a, b in pairs], "src string, dst string, kind string, confidence double, weight double"),
        n=spark.createDataFrame([(x, "ledger" if x == "n5" else x, "class", None, None) for x in ids_], "id string, name string, kind string, file string, container string"),
    )
    out = {x: [b for a, b in pairs if a == x] for x in ids_}
    p = {x: ((float(x == "n5") if name == "pagerank_seeded" else 1 / 6) + (0.15 / 6 if name == "pagerank_seeded" else 0)) / (1.15 if name == "pagerank_seeded" else 1) for x in ids_}
    rank, moved = dict(p), 1.0
    while moved > 1e-12:
        lost = sum(rank[x] for x in ids_ if not out[x])
        new = {x: 0.15 * p[x] + 0.85 * (sum(rank[a] / len(out[a]) for a, b in pairs if b == x) + lost * p[x]) for x in ids_}
        moved, rank = sum(abs(new[x] - rank[x]) for x in ids_), new
    monkeypatch.setattr(estate_queries, "Tables", lambda *_: t)
    got = catalog.QUERIES[name](spark, "").collect()
    if name == "central_code_converged":
        assert [r["id"] for r in got] == sorted({b for _, b in pairs}, key=lambda x: (-round(rank[x], 7), x))
    else:
        assert {r["id"]: round(r["rank"], 7) for r in got} == {x: round(r, 7) for x, r in rank.items()}
