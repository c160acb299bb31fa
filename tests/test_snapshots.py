from datetime import datetime as T

from conftest import rows
from pyspark.sql import functions as F

from terrane.operators import snapshots

S = "snapshot_id bigint, estate string, taken_at string, services array<string>, routes array<string>, loaded_at timestamp_ntz"
E = "estate string, tz string, date_order string"


def run(spark, snaps, clash=lambda d: d):
    es = spark.createDataFrame([("e", "Europe/Berlin", "DMY")], E)
    got = snapshots.snapshot_changes(clash(spark.createDataFrame(snaps, S)), clash(es))
    return rows(got)


def snap(k, at, services, routes, estate="e"):
    return (k, estate, at, services, routes, T(2025, 1, 1))


def test_changes(spark, clash):
    got = run(spark, [
        snap(9, "2025-01-01T00:00:00Z", [" a ", "b", "b"], ["a GET /v1/{id}/", "a post /v1/<key>", "b GET /x"]),
        snap(3, "02.01.2025 00:00:00", None, ["a POST /v1/:id", "a GET /v1/{x}", "b PUT /x", None, ""]),
        snap(3, "02.01.2025 00:00:00", None, ["a POST /v1/:id", "a GET /v1/{x}", "b PUT /x", None, ""]),
        snap(5, "2025-01-03T00:00:00Z", ["a", "c", None, " "], ["a GET /v1/{id}", "a POST /v1/{id}"]),
    ], clash)
    assert got == [
        ("e", 3, "route", "b /x", "changed"), ("e", 5, "route", "b /x", "removed"), ("e", 5, "service", "b", "removed"), ("e", 5, "service", "c", "added"),
    ]


def test_empty_array_means_none_and_null_not_delivered(spark):
    got = run(spark, [snap(1, "2025-01-01", ["a"], None), snap(2, "2025-01-02", [], None), snap(3, "2025-01-03", None, None), snap(4, "2025-01-04", ["a"], [])])
    assert got == [("e", 2, "service", "a", "removed"), ("e", 4, "service", "a", "added")]


def test_rows_without_place_and_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [snap(1, "unknown", ["a"], None), snap(2, None, ["b"], None), snap(3, "2025-01-01", ["a"], None, None)]) == []


def test_chunks_cut_alike_after_an_insertion(spark):
    keys = [f"k{i:04d}" for i in range(400)]
    one = [(1, [(k, "") for k in keys]), (2, [(k, "") for k in sorted([*keys, "k0200x"])])]
    got = snapshots.chunked(spark.createDataFrame(one, "rank int, entries array<struct<key:string,val:string>>")).select("rank", F.inline("chunks"))
    digests = {r[0]: set(r[1]) for r in got.groupBy("rank").agg(F.collect_set("digest")).collect()}
    assert len(digests[1]) > 8 and len(digests[2] - digests[1]) <= 2
    back = got.select("rank", F.inline("items")).groupBy("rank").count()
    assert rows(back) == [(1, 400), (2, 401)]


def test_the_last_delivery_with_the_array_holds(spark):
    early, late = T(2025, 1, 1), T(2025, 2, 1)
    got = run(spark, [
        (1, "e", "2025-01-01", ["a"], ["a GET /x"], early),
        (2, "e", "2025-01-02", ["a", "b"], ["a GET /y"], early), (2, "e", "2025-01-02", ["a", "c"], None, late), (2, "e", "2025-01-02", ["a", "c"], None, late),
    ])
    assert got == [("e", 2, "route", "a /x", "removed"), ("e", 2, "route", "a /y", "added"), ("e", 2, "service", "c", "added")]


def test_a_hot_estate_is_ranked_by_many_tasks(spark):
    data = [("hot" if k % 3 else f"e{k}", k, 7 * k % 101) for k in range(101)]
    got = snapshots.ranked(spark.createDataFrame(data, "estate string, snapshot_id int, at int").repartition(5), ["estate"], ["at", "snapshot_id"])
    want = {}
    for e, k, at in sorted(data, key=lambda x: (x[0], x[2], x[1])):
        want.setdefault(e, []).append(k)
    assert sorted((r["estate"], r["snapshot_id"], r["rank"]) for r in got.collect()) == sorted((e, k, i + 1) for e, ks in want.items() for i, k in enumerate(ks))
