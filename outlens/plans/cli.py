"""Command line: pipelines, scripts, a prompt and a small HTTP service.

    python -m outlens.plans.cli pipeline conf.yaml
    python -m outlens.plans.cli sql [-f script.sql]
    python -m outlens.plans.cli serve [--port 4567]
"""

from __future__ import annotations

import argparse
import csv
import io
import json
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession

from ..operators.relational import pretty
from ..sources.files import preview, write_csv
from ..sources.loaders import load_uri
from .ast import Query
from .lexer import SqlError, statements
from .parser import parse
from .pipelines import Config, pipeline
from .session import Session


def spark_session() -> SparkSession:
    return SparkSession.builder.appName("outlens").config("spark.sql.caseSensitive", "true").getOrCreate()


def execute(session: Session, text: str, rows: int = 20) -> str:
    """One statement, its export, and its first rows as text."""
    tree = parse(text)
    df = session.plan(tree)
    if isinstance(tree, Query) and tree.export:
        write_csv(df, tree.export.path, tree.export.field_by, tree.export.line_by)
    return pretty(df, rows)


def prompt(session: Session, read=input, write=print) -> None:
    """Reads statements up to a semicolon; quit or exit ends."""
    held = ""
    while True:
        try:
            line = read("... " if held else "outlens> ")
        except EOFError:
            return
        if not held and line.strip().rstrip(";").lower() in ("quit", "exit"):
            return
        held += line + "\n"
        if line.rstrip().endswith(";"):
            for part in statements(held):
                try:
                    write(execute(session, part))
                except (SqlError, ValueError) as e:
                    write(f"error: {e}")
            held = ""


def answer(spark: SparkSession, body: str) -> str:
    """A pipeline's explanation as JSON, for a configuration as JSON."""
    return pipeline(Config.from_json(body)).run(spark).json()


def schema_of(spark: SparkSession, request: dict) -> list[dict]:
    """Names and types of a relation's columns."""
    df = load_uri(spark, request["inputURI"])
    return [{"name": n, "type": t} for n, t in df.dtypes]


def rows_of(spark: SparkSession, request: dict) -> list[dict]:
    """Rows with the given column values; at most ``limit``, 1000 unless said."""
    df = preview(load_uri(spark, request["inputURI"]), request.get("columnValues") or {}, int(request.get("limit", 1000)), int(request.get("offset", 0)))
    return [r.asDict() for r in df.collect()]


def formatted(rows: list[dict], kind: str) -> str:
    """Rows as JSON or CSV text."""
    if kind.upper() == "JSON":
        return json.dumps(rows, default=str)
    if kind.upper() != "CSV":
        raise ValueError(f"unknown format: {kind}")
    out = io.StringIO()
    writer = csv.DictWriter(out, list(rows[0]) if rows else [])
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


def respond(spark: SparkSession, path: str, body: str) -> str:
    """The answer of the service to a request."""
    if path in ("/query", "/analyze"):
        return answer(spark, body)
    request = json.loads(body)
    if path == "/schema":
        return json.dumps(schema_of(spark, request))
    if path == "/rows":
        return json.dumps(rows_of(spark, request), default=str)
    if path == "/rows/multiple":
        return json.dumps([rows_of(spark, request | {"columnValues": v}) for v in request["columnValues"]], default=str)
    if path == "/rows/fmt":
        return json.dumps({"result": formatted(rows_of(spark, request), request.get("returnType", "JSON"))})
    raise FileNotFoundError(path)


def server(spark: SparkSession, port: int = 4567, host: str = "127.0.0.1") -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_PUT(self) -> None:
            self.do_POST()

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode("utf-8")
            try:
                status, text = 200, respond(spark, self.path.rstrip("/"), body)
            except FileNotFoundError as e:
                status, text = 404, json.dumps({"error": f"not found: {e}"})
            except Exception as e:  # the service goes on
                status, text = 400, json.dumps({"error": str(e)})
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_args) -> None:
            pass

    return HTTPServer((host, port), Handler)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="outlens")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("pipeline").add_argument("config")
    s = sub.add_parser("sql")
    s.add_argument("-f", "--file")
    sub.add_parser("serve").add_argument("--port", type=int, default=4567)
    got = p.parse_args(args)
    spark = spark_session()
    if got.what == "pipeline":
        print(pipeline(Config.from_file(got.config)).run(spark).text())
    elif got.what == "serve":
        server(spark, got.port).serve_forever()
    else:
        session = Session(spark)
        if got.file:
            with open(got.file, encoding="utf-8") as f:
                for part in statements(f.read()):
                    print(execute(session, part))
        else:
            prompt(session)
    return 0


if __name__ == "__main__":
    sys.exit(main())
