"""A small estate written here: what each extractor must find in it, and what it must not."""

from conftest import rows
from pyspark.sql import functions as F

from terrane.operators import merge, views
from terrane.sources import config, files, topology

FILE = files.FILE

ORDER = """package io.shop.order;

import io.shop.base.BaseService;
import static io.shop.util.Dates.today;
import java.util.List;

@FeignClient(name = "pricing-svc", url = "${pricing}")
public class OrderService<T extends Number> extends BaseService<List<T>>
        implements Auditable, java.io.Closeable {
    // http://stock-svc:80 is only spoken of
    @Cacheable("orders")
    public void place(Order o) {
        kafkaTemplate.send("shop.order.submitted", o);
        String s = "http://ghost:8080/x";
        log("shop.order.cancelled");
        bus.publish(Topics.T_STOCK, o);
    }
}
"""
PRICING = """package io.shop.pricing;
public class PricingListener {
    @KafkaListener(
        topics = Topics.T_STOCK,
        groupId = name(1, (2)))
    public void hear(String m) { subscribe("shop.order.submitted"); }
}
"""
TOPICS = 'class Topics {\n  public static final String T_STOCK = "shop.stock.moved";\n  public static final String LIMIT = "12";\n}\n'
PROPS = "db.url=jdbc:postgresql://DB1:5432/shop\nstock.service.url=http://stock-svc.internal:8080/api\n# db=mysql://no/no\ncache=redis://${HOST}/0\n"
PROXY = '{"/api/order/*": {"target": "http://gate:80", "pathRewrite": {"^/api": ""}}, "/stock": {"target": "http://x:1"}, "/zzz": {"target": "https://pricing-svc.prod:1"}}'
WEB = "import { x } from './y';\nreturn this.http.get<Row[]>(`/api/order/v1/orders/${id}?q=1`);\nfetch('/stock/items', {method: 'post'});\nfetch('/logo.svg');\n"


def estate(spark):
    data = [
        ("order-svc", "src/OrderService.java", "java", ORDER), ("pricing-svc", "src/PricingListener.java", "java", PRICING), ("shared", "src/Topics.java", "java", TOPICS),
        ("order-svc", "application.properties", "other", PROPS), ("pricing-svc", "application.properties", "other", "url: postgres://db1/shop\n"),
        ("web", "proxy.conf.json", "other", PROXY), ("web", "src/app.ts", "typescript", WEB), ("web", "src/app.spec.ts", "typescript", WEB),
        ("order-svc", "docker-compose.yml", "other", "dsn: mysql://in/compose\n"), ("order-svc", "null.java", "java", None), ("order-svc", "empty.java", "java", ""),
        ("shared", "src/io/shop/base/BaseService.java", "java", "package io.shop.base;\npublic class BaseService {}\n"), ("shared", "src/io/shop/util/Dates.java", "java", "class Dates {}"),
    ]
    return spark.createDataFrame([(u, p, lang, len(t or ""), t) for u, p, lang, t in data], "unit string, path string, lang string, bytes bigint, text string").select("unit", "path", "lang", "bytes", "text")


def services(spark):
    return spark.createDataFrame([(s, s) for s in ("order-svc", "pricing-svc", "stock-svc")], "name string, ord string")


def sid(x):
    return f"cart . service {x}"


def test_sync_edges_and_unknown_hosts(spark, clash):
    e, lost = topology.sync(clash(estate(spark)), services(spark), F.col("unit"))
    got = {(r["src"], r["dst"], r["confidence"]) for r in e.where("src = 'cart . service order-svc'").collect()}
    assert got == {(sid("order-svc"), sid("pricing-svc"), 0.95), (sid("order-svc"), sid("stock-svc"), 0.9)}
    assert ("unknown-host", "ghost") in {tuple(r) for r in lost.collect()}


def test_messages_constants_and_events(spark):
    f = estate(spark)
    m = {(r["unit"], r["topic"], r["way"]) for r in topology.messages(f).collect()}
    assert m == {("order-svc", "shop.order.submitted", "produce"), ("order-svc", "shop.order.cancelled", "mention"), ("pricing-svc", "shop.order.submitted", "consume")}
    assert rows(topology.topic_constants(f)) == [("T_STOCK", "shop.stock.moved")]
    c = rows(topology.constant_messages(f).select("unit", "line_no", "way", "topic"))
    assert c == [("order-svc", 16, "produce", "shop.stock.moved"), ("pricing-svc", 4, "consume", "shop.stock.moved")]
    topics, e = topology.asynchronous(topology.messages(f), f, F.col("unit"))
    assert {r["name"] for r in topics.collect()} == {"shop.order.submitted", "shop.order.cancelled"}
    assert {(r["src"], r["dst"], r["kind"]) for r in e.collect()} == {
        (sid("order-svc"), "cart . topic shop.order.submitted", "produces"), ("cart . topic shop.order.submitted", sid("pricing-svc"), "consumed-by"), (sid("order-svc"), sid("pricing-svc"), "event")
    }


def test_stores_shared_and_caches(spark):
    f = estate(spark)
    nodes, e = topology.stores(f, F.col("unit"))
    assert {r["name"] for r in nodes.collect()} == {"postgres://db1/shop"}
    assert rows(topology.shared_stores(e)) == [("cart . datastore postgres://db1/shop", 2)]
    assert rows(topology.caches(f, F.col("unit"))) == [("order-svc", "src/OrderService.java:11", 1)]


def test_imports_and_supertypes(spark):
    f = estate(spark)
    got = {(r["name"], r["static"]) for r in topology.imports(f).where("path = 'src/OrderService.java'").collect()}
    assert got == {("io.shop.base.BaseService", False), ("io.shop.util.Dates.today", True), ("java.util.List", False)}
    e = {(r["dst"], r["confidence"]) for r in topology.import_edges(f).where("src LIKE '%OrderService%'").collect()}
    assert e == {("cart shared java src/io/shop/base/BaseService.java`", 0.9), ("cart shared java src/io/shop/util/Dates.java`", 0.9), ("cart . external java.util.List", 1.0)}
    s = rows(topology.supertypes(f).select("name", "parent", "line_no"))
    assert s == [("OrderService", "Auditable", 8), ("OrderService", "BaseService", 8), ("OrderService", "Closeable", 8)]
    types = spark.createDataFrame([("BaseService", "shared", "B"), ("Auditable", "a", "A1"), ("Auditable", "b", "A2")], "name string, repo string, id string")
    stubs, edges = topology.supertype_edges(f, types)
    assert {(r["dst"], r["confidence"]) for r in edges.collect()} == {("B", 0.95), ("cart . library Closeable", 0.9)}
    assert [r["name"] for r in stubs.collect()] == ["Closeable"]


def test_proxies_and_front_end_calls(spark):
    f = estate(spark)
    got = {(r["prefix"], r["service"]) for r in topology.proxy_services(topology.proxies(f), services(spark)).collect()}
    assert got == {("/api/order", None), ("/stock", "stock-svc"), ("/zzz", "pricing-svc")} or ("/api/order", "order-svc") in got
    calls = rows(topology.http_calls(f).select("path", "method", "url"))
    assert calls == [("src/app.ts", "GET", "/api/order/v1/orders/${id}?q=1"), ("src/app.ts", "POST", "/stock/items")]
    rules = spark.createDataFrame([("web", "/api", "order-svc"), ("web", "/api/order", "order-svc"), ("web", "/stock", "stock-svc")], "unit string, prefix string, service string")
    routes = spark.createDataFrame([("R1", "order-svc", "GET", "/v1/orders/{}"), ("R2", "stock-svc", "ANY", "/items")], "id string, service string, method string, path string")
    assert {r["dst"] for r in topology.call_edges(f, rules, routes).collect()} == {"R1", "R2"}


def pom(artifact, packaging="jar", deps=()):
    body = "".join(f"<dependency><groupId>g</groupId><artifactId>{d}</artifactId></dependency>" for d in deps)
    return f"<project><groupId>g</groupId><artifactId>{artifact}</artifactId><packaging>{packaging}</packaging><dependencies>{body}</dependencies></project>"


def test_reactor(spark):
    data = [
        ("big", "pom.xml", pom("parent", "pom")), ("big", "a/pom.xml", pom("a-app", deps=["b-lib", "junit"])), ("big", "a/src/App.java", "@SpringBootApplication class App {}"),
        ("big", "b/pom.xml", pom("b-lib")), ("big", "b/src/B.java", "class B {}"), ("big", "w/pom.xml", pom("w-war", "war", ["a-app"])),
    ]
    f = spark.createDataFrame([(u, p, "java", 1, t) for u, p, t in data], FILE)
    nodes, e = topology.reactor(files.poms(f), f)
    assert {(r["name"], r["kind"]) for r in nodes.collect()} == {("a-app", "service"), ("b-lib", "library"), ("w-war", "service")}
    assert {(r["src"], r["dst"]) for r in e.collect()} == {(sid("a-app"), "cart . library b-lib"), (sid("w-war"), sid("a-app"))}


def test_changed_files_and_files_outside(spark):
    names = spark.createDataFrame([("big", "a/src/A.java"), ("big", "README"), ("big", "b/x"), ("none", "y")], "checkout string, path string")
    units = spark.createDataFrame([("big", "", "root"), ("big", "a", "a-app")], "checkout string, root string, repo string")
    assert rows(topology.changed_files(names, units)) == [("a-app", "src/A.java"), ("root", "README"), ("root", "b/x")]
    f = spark.createDataFrame([("r/a",), ("notes.txt",), ("rr/b",)], "path string")
    assert rows(config.outside(f, spark.createDataFrame([("r",)], "root string"))) == [("notes.txt",), ("rr/b",)]


def test_empty_files_give_nothing(spark):
    none = spark.createDataFrame([], FILE)
    s = services(spark)
    e, lost = topology.sync(none, s, F.col("unit"))
    for df in (e, lost, topology.messages(none), topology.constant_messages(none), topology.stores(none, F.col("unit"))[1], topology.supertypes(none), topology.proxies(none), topology.http_calls(none), topology.import_edges(none)):
        assert df.count() == 0


def test_config_is_found_upward_and_made(spark, tmp_path, monkeypatch):
    monkeypatch.delenv(config.VARIABLE, raising=False)
    deep = tmp_path / "x" / "y"
    deep.mkdir(parents=True)
    assert config.load(str(deep)) == {}
    (tmp_path / "terrane.yaml").write_text("services:\n  - name: order-svc\n    repo: o\n    aliases: [orders, order]\n  - pricing\n")
    got = rows(config.services(spark, config.load(str(deep))).select("name", "token", "repo"))
    assert got == [("order-svc", "order", "o"), ("order-svc", "order-svc", "o"), ("order-svc", "orders", "o"), ("pricing", "pricing", None)]
    repo = tmp_path / "code" / "shop"
    (repo / ".git").mkdir(parents=True)
    (repo / "pom.xml").write_text(pom("shop-app"))
    (repo / "App.java").write_text("@SpringBootApplication class App {}")
    (tmp_path / "code" / "tools" / ".git").mkdir(parents=True)
    made = config.generate(spark, str(tmp_path / "code"))
    assert '"shop-app"' in made and '"tools"' in made
    (tmp_path / "bad.json").write_text("[1]")
    monkeypatch.setenv(config.VARIABLE, str(tmp_path / "bad.json"))
    try:
        config.load(str(deep))
        raise AssertionError("a list is no configuration")
    except ValueError:
        pass


def test_files_no_reader_understands_are_gaps(spark):
    f = spark.createDataFrame([("u", "a.json", "other", 1, "{"), ("u", "b.yaml", "other", 1, "a: [1"), ("u", "c.json", "other", 1, "{}"), ("u", "d.yml", "other", 1, None), ("u", "e.java", "java", 1, "{")], FILE)
    assert sorted(r["detail"].split(":")[0] for r in files.unreadable(f).collect()) == ["u/a.json", "u/b.yaml"]


def test_small_views(spark):
    j = spark.createDataFrame([('{"b": 1, "a": "x"}',), ("no",), (None,)], "t string").select(views.sorted_json(F.col("t")).alias("t"))
    assert [r[0] for r in j.collect()] == ['{"a":"x","b":"1"}', None, None]
    q = spark.createDataFrame([("Who owns X — really?",), ("who owns x",)], "q string").select(views.question_key(F.col("q")))
    assert len({r[0] for r in q.collect()}) == 1
    g = spark.createDataFrame([("c", str(k)) for k in range(9)] * 2 + [("d", "1"), (None, "z")], "category string, detail string")
    assert views.capped(g, {"c": 4}).count() == 6
    old = spark.createDataFrame([("global", "a", 1.0), ("seeded", "a", 2.0), ("seeded", "b", 3.0)], "kind string, id string, rank double")
    new = spark.createDataFrame([("seeded", "a", 9.0)], "kind string, id string, rank double")
    assert rows(merge.upsert_ranks(old, new)) == [("global", "a", 1.0), ("seeded", "a", 9.0)]
