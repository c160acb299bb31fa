"""``python -m terrane.cli <tool or query> <dir>``: prints one report of the graph tables in a directory; ``init``, ``diagram``, ``serve`` and ``agent`` beside it."""

from __future__ import annotations

import argparse
import threading

from terrane import serve, tools
from terrane.operators import estate
from terrane.plans.estate_queries import QUERIES, Tables
from terrane.sources import config, sinks


def main(argv: list[str] | None = None, spark=None) -> str:
    p = argparse.ArgumentParser(prog="terrane")
    p.add_argument("command", choices=sorted({*tools.TOOLS, *QUERIES, "diagram", "init", "serve", "agent"}))
    p.add_argument("directory")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="an argument of the tool")
    p.add_argument("--rows", type=int, default=25)
    p.add_argument("--port", type=int, default=8377)
    a = p.parse_args(argv)
    if spark is None:
        from terrane.session import local_session

        spark = local_session()
    if a.command == "init":
        out = config.generate(spark, a.directory)
        print(out)
        return out
    t = Tables(spark, a.directory)
    if a.command == "agent":
        serve.stdio(t)
        return ""
    if a.command == "serve":
        server = serve.http(t, a.port)
        print(f"http://127.0.0.1:{server.server_port}/api")
        try:
            threading.Event().wait()
        except KeyboardInterrupt:
            server.shutdown()
        return ""
    if a.command == "diagram":
        out = sinks.mermaid(estate.architecture_pairs(t.e, t.n))
    else:
        args = dict(x.partition("=")[::2] for x in a.set)
        df = tools.call(t, a.command, args) if a.command in tools.TOOLS else QUERIES[a.command](spark, a.directory)
        out = sinks.markdown({a.command: df}, a.rows)
    print(out)
    return out


if __name__ == "__main__":
    main()
