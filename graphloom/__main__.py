"""Command line: index, query, impact, path, export, serve."""

from __future__ import annotations

import argparse
import sys

from graphloom.api import errors, render
from graphloom.api.client import Client


class _Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise _Usage(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True, parser_class=_Parser)

    def command(name: str, *positional: str, into=sub, fmt: bool = True) -> argparse.ArgumentParser:
        c = into.add_parser(name)
        for x in positional:
            c.add_argument(x)
        c.add_argument("--repository", "--repo", default=".")
        c.add_argument("--database", default=None, help="folder of the snapshot store")
        if fmt:
            c.add_argument("--format", choices=("text", "json"), default="text")
        return c

    c = sub.add_parser("index")
    c.add_argument("repository", nargs="?", default=".")
    c.add_argument("--database", default=None)
    query = sub.add_parser("query").add_subparsers(dest="what", required=True, parser_class=_Parser)
    for into, names in ((query, ("symbol", "callers", "callees")), (sub, ("callers", "callees", "impact"))):
        for name in names:
            c = command(name, "name", into=into)
            c.add_argument("--signature")
            c.add_argument("--file")
    command("file", "name", into=query)
    c = command("path", "source", "target")
    for side in ("source", "target"):
        c.add_argument(f"--{side}-signature")
        c.add_argument(f"--{side}-file")
    c = command("export", "output", fmt=False)
    c.add_argument("--force", action="store_true")
    c = sub.add_parser("serve")
    c.add_argument("--database", default=None)
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("graphloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None, spark=None, out=None, err=None) -> int:
    argv, out, err = sys.argv[1:] if argv is None else argv, out or sys.stdout, err or sys.stderr
    as_json = any(a == "--format=json" or a == "json" and argv[i - 1] == "--format" for i, a in enumerate(argv))

    def fail(code: str, message: str, candidates: list[dict], status: int) -> int:
        if as_json:
            out.write(render.dumps(render.error_json(code, message, candidates)))
        else:
            err.write(f"error: {message}\n" + "".join(f"  {c['qualified_name']} {c['signature']} {c['file']}\n" for c in candidates))
        return status

    try:
        a = parser().parse_args(argv)
    except _Usage as e:
        return fail("invalid_usage", str(e), [], 2)
    try:
        client = Client(spark or session(), a.database)
        if a.command == "serve":
            from graphloom.api.server import serve

            return serve(client, sys.stdin.buffer, sys.stdout.buffer)
        if a.command == "index":
            r = client.index(a.repository)
            out.write("".join(f"{k}: {v}\n" for k, v in {**r.counts, **r.timings_ms}.items()) + "".join(f"warning: {w}\n" for w in r.warnings))
            return 0
        if a.command == "export":
            client.export(a.repository, a.output, a.force)
            return 0
        what = a.what if a.command == "query" else a.command
        if what == "path":
            body = client.path(a.repository, a.source, a.target, a.source_signature, a.source_file, a.target_signature, a.target_file)
        elif what == "file":
            body = client.file(a.repository, a.name)
        else:
            body = getattr(client, what)(a.repository, a.name, a.signature, a.file)
        out.write(render.dumps(body) if a.format == "json" else render.text(what, body))
        return 0
    except errors.PluginFailure as e:
        return fail("internal_failure", e.message, [], e.exit_code)
    except errors.GraphError as e:
        return fail("invalid_usage" if isinstance(e, errors.InvalidArgument) else e.code, e.message, e.candidates, e.exit_code)
    except Exception as e:
        return fail("internal_failure", str(e).split("\n")[0], [], 10)


if __name__ == "__main__":
    sys.exit(main())
