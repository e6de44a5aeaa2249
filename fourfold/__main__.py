"""Command line: python -m fourfold FOLDER VERB ARGUMENTS, results as JSON lines."""

from __future__ import annotations

import argparse
import base64
import json
import sys

from . import __version__
from .errors import FourfoldError


def _show(value) -> None:
    print(json.dumps(value, ensure_ascii=False, default=lambda b: {"base64": base64.b64encode(bytes(b)).decode()}))


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="fourfold", description=__doc__)
    p.add_argument("folder")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, **options: str) -> None:
        q = verbs.add_parser(name)
        for a in args:
            q.add_argument(a)
        for k, default in options.items():
            q.add_argument(f"--{k}", default=default)

    verb("init"), verb("version"), verb("check"), verb("compact")
    verb("put", "key", "fields"), verb("get", "key"), verb("delete", "key"), verb("drop", "table")
    verb("scan", "prefix", after="", limit="1000"), verb("sql", "text", args="[]")
    verb("link", "src", "type", "dst"), verb("unlink", "src", "type", "dst")
    verb("neighbours", "key", direction="out", type=""), verb("walk", "key", "depth", direction="out", type="")
    verb("nearest", "table", "query", "k", where=""), verb("export", "to"), verb("import", "source")
    verb("adopt", "table", "parquet", "key", vec="")
    a = p.parse_args(argv)
    if a.verb == "version":
        _show({"version": __version__})
        return 0
    from pyspark.sql import SparkSession

    from .sources.database import Database
    from .sources.jsonl import export, import_

    spark = spark or SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    try:
        db = Database(spark, a.folder)
        if a.verb == "put":
            db.put(a.key, json.loads(a.fields))
        elif a.verb == "get":
            _show(db.get(a.key))
        elif a.verb in ("delete", "drop"):
            getattr(db, a.verb)(a.key if a.verb == "delete" else a.table)
        elif a.verb == "scan":
            for r in db.scan(a.prefix, a.after, int(a.limit)):
                _show(r)
        elif a.verb == "sql":
            if a.text.split(None, 1)[0].lower() in ("insert", "update", "delete"):
                _show({"changed": db.execute(a.text, json.loads(a.args))})
            else:
                for r in db.query(a.text, json.loads(a.args)).toLocalIterator():
                    _show(r.asDict())
        elif a.verb in ("link", "unlink"):
            getattr(db, a.verb)(a.src, a.type, a.dst)
        elif a.verb == "neighbours":
            for src, kind, dst in db.neighbours(a.key, a.direction, a.type or None):
                _show({"from": src, "type": kind, "to": dst})
        elif a.verb == "walk":
            for key, depth in db.walk(a.key, int(a.depth), a.type or None, a.direction):
                _show({"key": key, "depth": depth})
        elif a.verb == "nearest":
            query = json.loads(a.query) if a.query.startswith("[") else a.query
            for key, distance in db.nearest(a.table, query, int(a.k), a.where or None):
                _show({"key": key, "distance": distance})
        elif a.verb == "export":
            export(db.snapshot(), a.to)
        elif a.verb == "import":
            _show(import_(db, a.source))
        elif a.verb == "adopt":
            db.adopt(a.table, spark.read.parquet(a.parquet), a.key, vec=a.vec or None)
        elif a.verb == "check":
            report = db.check()
            _show(report)
            return int(bool(report["problems"]))
        elif a.verb == "compact":
            db.compact()
    except (FourfoldError, ValueError) as e:
        print(f"{getattr(e, 'kind', 'error')}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
