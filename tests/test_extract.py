from conftest import rows
from pyspark.sql import functions as F

from terrane.sources import extract, files


def estate(spark):
    ctrl = '@RestController\n@RequestMapping("/v1/orders")\npublic class OrderController {\n  @GetMapping("/{id}")\n  public Order load(String id) {\n    return fetchOrder(id); // fetchNothing(\n  }\n  @PostMapping\n  public void add() {\n  }\n}\n'
    dao = 'public class OrderDao {\n  public Order fetchOrder(String id) {\n    return q("SELECT a FROM T_ORDER JOIN T_LINE ON 1");\n  }\n  public void put() {\n    q("UPDATE T_ORDER SET a = 1");\n  }\n}\n'
    data = [("order", "OrderController.java", "java", ctrl), ("order", "OrderDao.java", "java", dao), ("order", "V1.sql", "sql", "CREATE TABLE IF NOT EXISTS T_ORDER (id INT);\n-- CREATE TABLE T_NO (id INT);"),
            ("order", "package.json", "other", '{"dependencies": {"pricing": "1", "react": "2"}}'), ("order", "app.env", "other", "x=1\npassword = hunter22secret\n"),
            ("order", "docker-compose.yml", "other", "services:\n  order:\n    depends_on: [pricing]\n    environment: {DB: 'jdbc:postgresql://DB:5432/core'}\n")]
    return spark.createDataFrame([(u, p, g, len(t), t) for u, p, g, t in data], files.FILE)


def test_emission(spark):
    f = estate(spark)
    n, e = extract.symbols(f)
    assert rows(n.where("kind <> 'file'").select("kind", "name", "container")) == [("class", "OrderController", None), ("class", "OrderDao", None), ("function", "add", "OrderController"), ("function", "fetchOrder", "OrderDao"), ("function", "load", "OrderController"), ("function", "put", "OrderDao")]
    assert e.count() == 6
    assert rows(extract.calls(f).select("dst", "evidence", "confidence")) == [("cart order java OrderDao.java`OrderDao#fetchOrder().", "OrderController.java:6", 0.65)]
    tn, te = extract.tables(f, F.col("unit"))
    assert rows(tn.select("name", "service")) == [("T_LINE", None), ("T_ORDER", "order")]
    assert rows(te.select("kind", "dst", "confidence")) == [("defines-table", "cart . table T_ORDER", 1.0), ("reads-table", "cart . table T_LINE", 0.8), ("writes-table", "cart . table T_ORDER", 0.8)]
    rn, re_ = extract.routes(f, F.col("unit"))
    assert rows(rn.select("name")) == [("GET /v1/orders/{id}",), ("POST /v1/orders",)] and re_.count() == 4
    known = spark.createDataFrame([("pricing",)], "name string")
    assert rows(extract.dependencies(f, known).select("kind", "dst")) == [("depends-on", "cart . service pricing"), ("uses-library", "cart . library react")]
    assert rows(extract.containers(f).select("kind", "dst")) == [("http", "cart . service pricing"), ("uses-datastore", "cart . datastore postgres://db/core")]
    got = extract.secrets(f).collect()
    assert [(r["category"], r["detail"]) for r in got] == [("credential-in-source", "order/app.env:2")] and "hunter" not in str(got)


def test_traces_become_one_edge_a_pair(spark):
    c = spark.createDataFrame([("a", "b", 10.0, 1.0, 0.1)], "client string, server string, calls double, errors double, error_rate double")
    r = extract.observed(c).first()
    assert (r["src"], r["dst"], r["kind"], r["confidence"]) == ("cart . service a", "cart . service b", "http", 1.0) and '"runtime":true' in r["extra"]
