from datetime import datetime as T

from conftest import rows

from terrane.operators import orphans

NODE = "id string, kind string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
EDGE = "id bigint, src string, dst string, kind string, loaded_at timestamp_ntz"
D = lambda d: T(2025, 1, d)


def frames(spark, nodes, edges):
    return spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE)


def test_interval_rules(spark, clash):
    nodes = [("a", "x", D(5), None), ("b", "x", D(1), D(10)), ("b", "x", D(20), None), ("b", "x", D(20), None), (None, None, None, None)]
    edges = [
        (1, "a", "b", "calls", D(6)),  # both valid
        (2, "a", "b", "calls", D(4)),  # a comes later
        (3, " a\n", "b\t", "calls", D(10)),  # trimmed; b is removed at that very time
        (4, "", None, "calls", D(6)),  # no references
        (5, "zz", "b", "calls", D(25)),
        (5, "zz", "b", "calls", D(25)),  # redelivery
        (6, "a", "A", "calls", None),  # no time: a was there once, A never
    ]
    e, n = frames(spark, nodes, edges)
    got = orphans.orphan_cascade(clash(e), clash(n))
    assert rows(got.where("origin = 'direct'").select("edge_id", "end_name")) == [(2, "src"), (3, "dst"), (5, "src"), (6, "dst")]


def test_cascade_reaches_children_and_ends_on_cycles(spark):
    nodes = [(x, "x", D(1), None) for x in "fcmuv"]
    edges = [(1, "gone", "f", "defines", D(2)), (2, "f", "c", "defines", D(2)), (3, "c", "m", "defines", D(2)), (4, "m", "f", "defines", D(2)), (5, "u", "v", "defines", D(2)), (6, "m", "v", "calls", D(2))]
    e, n = frames(spark, nodes, edges)
    got = rows(orphans.orphan_cascade(e, n).select("edge_id", "end_name", "origin", "depth"))
    assert got == [(1, "src", "direct", 0), (2, "src", "inherited", 1), (3, "src", "inherited", 2), (4, "src", "inherited", 3)]


def test_hot_id_is_salted_and_right(spark):
    nodes = [("hot", "x", D(1), D(3)), ("b", "x", D(1), None)]
    edges = [(k, "b", "hot", "calls", D(2 + k % 2)) for k in range(2000)]
    e, n = frames(spark, nodes, edges)
    assert orphans.orphan_cascade(e, n).count() == 1000


def test_empty(spark):
    e, n = frames(spark, [], [])
    assert orphans.orphan_cascade(e, n).count() == 0
    e, n = frames(spark, [], [(1, "a", "b", "calls", D(1))])
    report = orphans.orphan_report(orphans.orphan_cascade(e, n))
    assert rows(report.select("end_name", "month", "origin", "n")) == [("dst", "2025-01", "direct", 1), ("src", "2025-01", "direct", 1)]


def test_cascade_through_mixed_kinds(spark):
    nodes = [(x, "x", D(1), None) for x in "frmuvs"]
    edges = [
        (1, "gone", "f", "exposes", D(2)), (2, "f", "m", "defines", D(2)), (3, "m", "r", "defines-table", D(2)),
        (4, "m", "v", "calls", D(2)), (5, "u", "r", "reads-table", D(2)), (6, "v", "u", "calls", D(2)), (7, "m", "lost", "imports", D(2)), (8, "r", "r", None, D(2)),
    ]
    e, n = frames(spark, nodes, edges)
    got = rows(orphans.orphan_cascade(e, n, orphans.CONTAINS, references=True).select("edge_id", "end_name", "origin", "depth"))
    assert got == sorted([
        (1, "src", "direct", 0), (7, "dst", "direct", 0), (2, "src", "inherited", 1), (3, "src", "inherited", 2), (4, "src", "inherited", 2),
        (7, "src", "inherited", 2), (5, "dst", "inherited", 3), (8, "src", "inherited", 3), (8, "dst", "inherited", 3),
    ], key=repr)


def test_cascade_has_no_depth_limit(spark):
    nodes = [(f"n{k}", "x", D(1), None) for k in range(36)]
    edges = [(0, "gone", "n0", "defines", D(2))] + [(k, f"n{k - 1}", f"n{k}", "defines", D(2)) for k in range(1, 36)]
    e, n = frames(spark, nodes, edges)
    assert sorted(r["depth"] for r in orphans.orphan_cascade(e, n).select("depth").collect()) == list(range(36))
