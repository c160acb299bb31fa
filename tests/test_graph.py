from datetime import datetime as T

from conftest import rows
from pyspark.sql import functions as F

from terrane.functions import code
from terrane.operators import estate, graph, merge, resolve
from terrane.sources import traces

EDGE = "src string, dst string, kind string, evidence string, provenance string, confidence double, weight double, extra string"


def edges(spark, rows_):
    return spark.createDataFrame([(s, d, k, e, p, 0.9, 1.0, None) for s, d, k, e, p in rows_], EDGE)


def arch(spark):
    """Seven nodes, twelve edges: two parallel calls, a topic between services, tables with one and two writers, build-time noise."""
    ids = ["a", "b", "c"]
    nodes = [(f"cart . service {x}", "service", x, None, x) for x in ids] + [("T1", "table", "T1", None, "a"), ("T2", "table", "T2", None, "a"), ("T3", "table", "T3", None, "c"), ("q", "topic", "q", None, None)]
    s = lambda x: f"cart . service {x}"
    e = [
        (s("a"), s("b"), "http", "f:1", "EXTRACTED"), (s("a"), s("b"), "http", "f:2", "INFERRED"), (s("a"), "q", "produces", "f:3", "EXTRACTED"), ("q", s("c"), "consumed-by", "f:4", "EXTRACTED"),
        (s("a"), "T1", "writes-table", "f:5", "EXTRACTED"), (s("b"), "T1", "writes-table", "f:6", "EXTRACTED"), (s("a"), "T2", "writes-table", "f:7", "EXTRACTED"), (s("c"), "T2", "reads-table", "f:8", "EXTRACTED"),
        (s("c"), "T3", "writes-table", "f:9", "EXTRACTED"), (s("a"), s("c"), "imports", "f:10", "EXTRACTED"), (s("b"), s("c"), "depends-on", "f:11", "EXTRACTED"), (s("b"), s("c"), "extends", "f:12", "EXTRACTED"),
    ]
    return spark.createDataFrame(nodes, "id string, kind string, name string, repo string, service string"), edges(spark, e)


def test_architecture(spark):
    n, e = arch(spark)
    assert rows(estate.architecture_pairs(e, n).select("source", "target", "count", "kinds", "provenance")) == [("cart . service a", "cart . service b", 2, "http=2", "INFERRED")]
    w = {r["id"]: (r["writers"], r["services"], r["significant"]) for r in estate.waypoints(e, n).collect()}
    assert w == {"T1": (2, 2, True), "T2": (1, 2, False), "q": (1, 2, False)}


def test_edge_merge_is_idempotent(spark):
    at = T(2025, 1, 1)
    row = (1, "a", "b", "calls", None, None, 0.5, None, "s", None, at)
    other = (2, "a", "b", "calls", "", "EXTRACTED", 0.9, 2.0, "t", None, at)
    schema = "id bigint, src string, dst string, kind string, evidence string, provenance string, confidence double, weight double, source string, extra string, loaded_at timestamp_ntz"
    df = spark.createDataFrame([row, row, other, (3, "x", "x", "calls", None, None, None, None, None, None, at), (4, "", "b", "calls", None, None, None, None, None, None, at)], schema)
    assert rows(merge.merge_edges(df).select("src", "dst", "evidence", "weight", "confidence", "provenance", "source")) == [("a", "b", "", 3.0, 0.9, "EXTRACTED", "s")]


def test_pagerank_adds_up_and_dangling_mass_returns(spark):
    e = edges(spark, [("a", "b", "calls", "", "x"), ("b", "c", "calls", "", "x"), ("c", "a", "calls", "", "x"), ("a", "z", "calls", "", "x")])
    got = dict(rows(graph.pagerank(graph.adjacency(e), iterations=30)))
    assert abs(sum(got.values()) - 1) < 1e-9 and got["a"] > got["z"]
    nodes, rank = ["a", "b", "c", "z"], {x: 0.25 for x in "abcz"}
    out = {"a": ["b", "z"], "b": ["c"], "c": ["a"], "z": []}
    for _ in range(30):
        new = {x: 0.15 / 4 for x in nodes}
        for x in nodes:
            for y in out[x] or nodes:
                new[y] += 0.85 * rank[x] / len(out[x] or nodes)
        rank = new
    assert all(abs(got[x] - rank[x]) < 1e-6 for x in nodes)


def test_reach_and_path(spark):
    e = edges(spark, [("a", "b", "calls", "1", "x"), ("b", "c", "calls", "2", "x"), ("c", "a", "calls", "3", "x"), ("d", "c", "imports", "4", "x"), ("d", "e", "http", "5", "x")])
    one = spark.createDataFrame([("c",)], "id string")
    assert rows(graph.reach(e, one, ("calls", "imports"), 2).select("id", "distance")) == [("a", 2), ("b", 1), ("d", 1)]
    goal = spark.createDataFrame([("c",)], "id string")
    start = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.shortest_path(e, start, goal).select("step", "id")) == [(0, "a"), (1, "b"), (2, "c")]
    assert graph.shortest_path(e, spark.createDataFrame([("e",)], "id string"), goal).count() == 0


def test_layering_cuts_cycles(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "b")], "src string, dst string")
    assert rows(graph.layering(p)) == [("a", 0), ("b", 1), ("c", 2)]


def test_package_and_module(spark):
    f = spark.createDataFrame([("src/main/java/com/acme/order/dao/X.java",), ("X.java",), ("src/X.java",), (None,)], "file string")
    assert [r[0] for r in f.select(graph.package_key(F.col("file"), 2)).collect()] == ["acme/order", "(root)", "src", None]
    m = spark.createDataFrame([("server/billing/src/A.java",), ("services/A.java",)], "p string")
    assert [r[0] for r in m.select(resolve.module_of(F.col("p"), ("server", "services"), F.lit("repo"))).collect()] == ["billing", "repo"]


def test_resolution(spark):
    d = spark.createDataFrame([("one", "r", "1"), ("two", "r", "2"), ("two", "s", "3"), ("dup", "r", "4"), ("dup", "r", "5")], "name string, repo string, id string")
    u = spark.createDataFrame([("one", "q"), ("two", "s"), ("dup", "r"), ("none", "r")], "name string, repo string")
    got = {r["name"]: (r["id"], r["state"]) for r in resolve.by_name(u, d, 0.65, 0.55).collect()}
    assert got == {"one": ("1", "resolved"), "two": ("3", "resolved"), "dup": (None, "ambiguous"), "none": (None, "external")}


def test_aliases(spark):
    s = spark.createDataFrame([("order-svc", 1), ("pricing", 2)], "name string, ord int")
    t = spark.createDataFrame([("ORDER_SVC",), ("registry/x/order-svc:1.2",), ("orders",), ("pricingdev",), ("nothing",)], "token string")
    assert rows(resolve.resolve_tokens(t, s)) == [("ORDER_SVC", "order-svc"), ("orders", "order-svc"), ("pricingdev", "pricing"), ("registry/x/order-svc:1.2", "order-svc")]


def test_trace_formats_add_up_after_aliases(spark, tmp_path):
    (tmp_path / "p.txt").write_text('# x\ntraces_service_graph_request_total{client="order",server="pricing-svc"} 100000\ntraces_service_graph_request_failed_total{client="order-svc",server="pricing-svc"} 250\nother{client="a",server="b"} 3\n')
    (tmp_path / "j.json").write_text('{"data": [{"parent": "order-svc", "child": "pricing-svc", "callCount": 5000}]}')
    (tmp_path / "c.csv").write_text("source,target,calls,errors\na,b,300,4\nb,b,1,0\n")
    p = traces.read(spark, str(tmp_path / "p.txt"), "prom").unionByName(traces.read(spark, str(tmp_path / "j.json"))).unionByName(traces.read(spark, str(tmp_path / "c.csv")))
    alias = spark.createDataFrame([("order", "order-svc")], "token string, service string")
    assert rows(traces.merge(p, alias)) == [("a", "b", 300.0, 4.0, 0.0133), ("order-svc", "pricing-svc", 105000.0, 250.0, 0.0024)]


def test_code_machine():
    src = 'int a = 1; // "x"\nString s = "b(c) // d";\n/* e\nf */ g("h" +\n "i");'
    out = code.blank_noise(src)
    assert len(out) == len(src) and out.count("\n") == src.count("\n") and "b(c)" not in out and "g(" in out and "// " not in out
    assert code.concatenated(src)[-1] == (4, "hi") and src[code.balanced(src, src.index("(", src.index("g("))) - 1] == ")"
    assert "#" not in code.blank_noise("a = 1  # b\n'''c\n#d'''", "python")


def test_task_terms(spark):
    r = spark.createDataFrame([("Please fix the OrderService and orderservice parser",)], "t string").select(code.task_terms(F.col("t"))).first()[0]
    assert r == ["OrderService", "Order", "Service", "parser"]


def test_members_belong_to_the_service_of_their_estate(spark):
    node = "id string, kind string, name string, repo string, service string, file string, extra string"
    n = spark.createDataFrame([
        ("cart . service north.pay", "service", "pay", None, "pay", None, None), ("cart . service south.pay", "service", "pay", None, "pay", None, None), ("cart . service south.ship", "service", "ship", None, "ship", None, None),
        ("f1", "file", "A", "r1", "pay", "a", None), ("f2", "file", "B", "r2", "pay", "b", None), ("f3", "class", "C", "r1", "ship", "c", None), ("f4", "file", "D", "r9", "pay", "d", None), ("f5", "file", "E", "r3", None, "e", None),
        ("t1", "table", "T", "r2", None, None, None), ("t2", "table", "U", "r2", "pay", None, None), ("q", "topic", "Q", "r1", "pay", None, None),
    ], node)
    repos = spark.createDataFrame([("r1", "north"), ("r2", "south"), ("r3", "south")], "repo string, estate string")
    got = dict(rows(graph.estate_members(n, repos).where("id <> grp")))
    # the north has no ship, but only one service is called so; of two called pay, an unknown estate says neither
    assert got == {"f1": "cart . service north.pay", "f2": "cart . service south.pay", "f3": "cart . service south.ship", "t2": "cart . service south.pay"}
    assert dict(rows(graph.estate_members(n, repos).where("id = grp"))) == {x: x for x in ("cart . service north.pay", "cart . service south.pay", "cart . service south.ship", "q")}


def test_architecture_of_a_hand_made_graph(spark):
    svc, tab = lambda x: f"cart . service {x}", lambda x: f"cart . table {x}"
    n = spark.createDataFrame([(svc(x), "service", x, x, x) for x in "abc"] + [(tab(x), "table", x, None, None) for x in ("SHARED", "OWNED", "LONELY")] + [("cart . topic t", "topic", "t", None, None)], "id string, kind string, name string, repo string, service string")
    e = spark.createDataFrame([
        (svc("a"), svc("b"), "http", "x:1", "EXTRACTED"), (svc("a"), svc("b"), "http", "x:2", "INFERRED"), (svc("a"), "cart . topic t", "produces", "x:3", "EXTRACTED"), ("cart . topic t", svc("b"), "consumed-by", "x:4", "EXTRACTED"),
        (svc("a"), tab("SHARED"), "writes-table", "x:5", "EXTRACTED"), (svc("b"), tab("SHARED"), "writes-table", "x:6", "EXTRACTED"), (svc("c"), tab("OWNED"), "writes-table", "x:7", "EXTRACTED"), (svc("a"), tab("OWNED"), "reads-table", "x:8", "EXTRACTED"),
        (svc("c"), tab("LONELY"), "writes-table", "x:9", "EXTRACTED"), (svc("a"), svc("c"), "imports", "x:10", "EXTRACTED"), (svc("b"), svc("c"), "depends-on", "x:11", "EXTRACTED"), (svc("a"), svc("c"), "extends", "x:12", "EXTRACTED"),
    ], "src string, dst string, kind string, evidence string, provenance string")
    got = rows(estate.architecture_pairs(e, n).select("source", "target", "count", "provenance"))
    assert got == [(svc("a"), svc("b"), 2, "INFERRED")]
    w = {r["id"]: (r["writers"], r["significant"]) for r in estate.waypoints(e, n).collect()}
    assert w[tab("SHARED")] == (2, True) and w[tab("OWNED")] == (1, False) and tab("LONELY") not in w


def test_layers_of_a_long_chain(spark):
    p = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(12)], "src string, dst string")
    assert rows(graph.layering(p)) == [(f"n{k:03d}", k) for k in range(13)]
