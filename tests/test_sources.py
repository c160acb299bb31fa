import json
import os
from pathlib import Path

from conftest import rows


from terrane import cli
from terrane.operators import merge
from terrane.sources import files, sinks
from terrane.streaming import ingest

SF = "/root/testdata/sf0.001"


def put(root: Path, name: str, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text) if isinstance(text, bytes) else p.write_text(text)


def test_scan_prunes_and_survives(spark, tmp_path):
    put(tmp_path, "src/A.java", "public class A extends B {\n  public int run(int x) {\n    return x;\n  }\n}\n")
    put(tmp_path, "node_modules/x/y.js", "function no() {}")
    put(tmp_path, "bad.py", b"\xff\xfedef f(:\n")
    put(tmp_path, "empty.py", "")
    put(tmp_path, "big.py", "x" * 2_000_001)
    os.symlink(tmp_path, tmp_path / "loop")
    got = files.scan(spark, str(tmp_path), "u")
    assert {r["path"] for r in got.collect()} >= {"src/A.java", "bad.py"} and not [r for r in got.collect() if "node_modules" in r["path"] or r["path"] == "big.py"]
    assert rows(files.definitions(got.where("path = 'src/A.java'")).select("kind", "name", "line")) == [("class", "A", 1), ("function", "run", 2)]


def test_repositories(spark, tmp_path):
    (tmp_path / "a/.git").mkdir(parents=True)
    (tmp_path / "group/b/.git").mkdir(parents=True)
    (tmp_path / "plain/x/src").mkdir(parents=True)
    assert [(r["unit"], r["kind"]) for r in files.repositories(spark, [str(tmp_path / "a"), str(tmp_path / "group"), str(tmp_path / "plain")]).orderBy("unit").collect()] == [("a", "git"), ("b", "git"), ("x", "directory")]


def texts(spark, *pairs):
    return spark.createDataFrame([("u", p, "x", len(t), t) for p, t in pairs], files.FILE)


def test_commit_log(spark):
    text = "\x01s1\x02Ann\x022025-01-01T00:00:00+01:00\x02PAY-12 fix\n\n3\t1\tsrc/{a => b}/x.py\n-\t-\timg.png\n9\t9\tyarn.lock\n\x01s2\x02Bob\x022025-01-02T00:00:00Z\x02Merge\n"
    got = files.commit_log(spark.createDataFrame([("r", text)], "repo string, text string")).orderBy("sha").collect()
    assert [tuple(f) for f in got[0]["files"]] == [("src/b/x.py", 3, 1), ("img.png", 0, 0)] and got[0]["tickets"] == ["PAY-12"] and got[1]["files"] == []


def test_manifests_poms_frontends(spark):
    t = texts(
        spark, ("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}'), ("requirements.txt", "flask==1\n# no\nrequests>=2\n"), ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.0\n)\n"),
        ("broken/package.json", "{"), ("pom.xml", '<project xmlns="m"><parent><groupId>g</groupId><artifactId>p</artifactId></parent><artifactId>a</artifactId><dependencies><dependency><groupId>q</groupId><artifactId>d</artifactId></dependency></dependencies></project>'),
    )
    got = {(r["name"], r["ecosystem"]) for r in files.manifests(t).collect()}
    assert got == {("react", "npm"), ("jest", "npm"), ("flask", "pip"), ("requests", "pip"), ("github.com/a/b", "go"), ("d", "maven")}
    p = files.poms(t).first()
    assert (p["group_id"], p["artifact_id"], p["parent"], p["packaging"], p["dependencies"]) == ("g", "a", "p", "jar", ["d"])
    assert rows(files.frontends(t).select("framework")) == [("react",)]


def test_compose_and_specs(spark):
    t = texts(
        spark, ("docker-compose.yml", "services:\n  a:\n    image: x/a:1\n    depends_on: [b]\n    environment:\n      - DB=jdbc:mysql://db:3306/core\n  b:\n    image: redis\n"), ("api.yaml", "openapi: 3\ninfo: {title: order}\npaths:\n  /v1/x:\n    get: {}\n    post: {}\n"),
        ("ev.json", json.dumps({"asyncapi": "2", "info": {"title": "o"}, "channels": {"t.a": {"publish": {}}, "t.b": {"subscribe": {}}}})), ("s.proto", "service Pay {\n  rpc Charge (A) returns (B);\n}\n"), ("bad.yaml", "openapi: [\n"),
    )
    assert rows(files.compose(t).select("service", "dsn")) == [("a", "jdbc:mysql://db:3306/core"), ("b", None)]
    assert rows(files.specs(t).select("kind", "method", "name")) == [("consumed-by", "publish", "t.a"), ("produces", "subscribe", "t.b"), ("route", "GET", "/v1/x"), ("route", "POST", "/v1/x"), ("rpc", "RPC", "Charge")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "s1"), ("b", "s2")], "id string, source string")
    out = str(tmp_path / "n")
    sinks.replace_source(df, out)
    sinks.replace_source(spark.createDataFrame([("c", "s2")], "id string, source string"), out)
    assert rows(spark.read.parquet(out).select("id", "source")) == [("a", "s1"), ("c", "s2")]
    assert not sinks.export_json(df, str(tmp_path / "j"), most=1) and sinks.export_json(df, str(tmp_path / "j"))
    for k in range(4):
        sinks.write_snapshot(df, str(tmp_path / "s"), f"2025-01-0{k + 1}T00:00:00Z", keep=2)
    assert sinks.read_snapshots(spark, str(tmp_path / "s")).select("taken_at").distinct().count() == 2
    pairs = spark.createDataFrame([("x", "y", 3)], "source string, target string, count int")
    assert "-->|3|" in sinks.mermaid(pairs) and "| x | y | 3 |" in sinks.markdown({"t": pairs})
    (tmp_path / "ack").write_text("# c\n0123abcd: known\nnonsense\n")
    acks = files.acknowledged(spark, str(tmp_path / "ack"))
    assert rows(acks) == [("0123abcd", "known")] and sinks.write_acks(acks) == "0123abcd: known\n"


def test_cache_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "key string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "key string, hash string")
    assert rows(merge.cache_changes(old, new).select("key", "action")) == [("a", "keep"), ("b", "parse"), ("c", "prune"), ("d", "parse")]


def test_stream_drops_redeliveries(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = {"repo": "r", "sha": "1", "author": "a", "date": "2025-01-01", "subject": "x", "files": [{"path": "p", "added": 1, "deleted": 0}], "loaded_at": "2025-01-01T00:00:00Z"}
    (src / "1.json").write_text("\n".join(json.dumps(x) for x in (row, row, row | {"sha": "2"})))
    got = []
    q = ingest.run_into(ingest.commit_stream(spark, str(src)), lambda df: got.extend(r["sha"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(got) == ["1", "2"]


def test_cli(spark, capsys):
    assert "| measure | n |" in cli.main(["stats", SF], spark)

