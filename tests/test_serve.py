import io
import json
import urllib.error
import urllib.request
from pathlib import Path

import pytest

from terrane import serve, tools
from terrane.plans.estate_queries import Tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


ARGS = {
    "find": {"name": "ledger"}, "node": {"name": "none"}, "blast-radius": {"name": "none"}, "impact": {"name": "none"}, "path": {"source": "a", "target": "b", "hops": 1},
    "expand": {"source": "a", "target": "b"}, "service": {"service": "x"}, "packages": {"service": "x"}, "file": {"repo": "x", "file": "y"}, "flow": {"entity": "ledger"}, "pr-check": {"files": "x:y, z:w"},
    "resolve": {"token": "X"}, "central": {"terms": "ledger"}, "map": {"task": "ledger", "tokens": 400}, "rank": {"terms": "ledger"},
}


@pytest.mark.parametrize("name", sorted(tools.TOOLS))
def test_every_tool_answers(t, name):
    df = tools.call(t, name, ARGS.get(name))
    assert df.columns and len(df.limit(5).collect()) >= 0


def test_wrong_names_are_refused(t):
    with pytest.raises(ValueError):
        tools.call(t, "drop")
    with pytest.raises(ValueError):
        tools.call(t, "find", {"sql": "x"})


def test_messages_over_lines(t):
    said = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "stats", "arguments": {"rows": 3}}}, {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "nope"}}, {"jsonrpc": "2.0", "id": 5, "method": "zzz"},
    ]
    out = io.StringIO()
    serve.stdio(t, io.StringIO("\n".join([*map(json.dumps, said), "", "no json"]) + "\n"), out)
    got = {m["id"]: m for m in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5, None} and len(got[2]["result"]["tools"]) == len(tools.TOOLS)
    assert len(json.loads(got[3]["result"]["content"][0]["text"])) == 3 and got[4]["result"]["isError"] and got[5]["error"]["code"] == -32601


def test_http(t):
    server = serve.http(t, 0)
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert {x["name"] for x in json.load(urllib.request.urlopen(f"{at}/api"))} == set(tools.TOOLS)
        assert len(json.load(urllib.request.urlopen(f"{at}/api/stats?rows=2"))) == 2
        for path, status in (("/api/nope", 404), ("/x", 404), ("/api/find?sql=1", 400), ("/api/stats?rows=x", 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(at + path)
            assert e.value.code == status
    finally:
        server.shutdown()
