"""Command line over a saved catalog.

    cellgrain --db DIR load sales.csv --dims customer,product,date --measure quantity --name sales
    cellgrain --db DIR hierarchy dates.csv --child date --parent month
    cellgrain --db DIR query "SELECT month, SUM(quantity) FROM sales GROUP BY month" --format csv

Exit codes: 0, 2 for queries that can't be read, bound or allowed, 3 for keys, values and sizes.
"""

from __future__ import annotations

import argparse
import csv
import io
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .doctor import report
from .engine import Engine
from .errors import AccessDenied, BindError, QuerySyntaxError
from .operators.tensors import describe_signature
from .result import ResultSet
from .sources import loaders


def session() -> SparkSession:
    return SparkSession.builder.appName("cellgrain").getOrCreate()


def shown(result: ResultSet, form: str, limit: int) -> str:
    if form == "json":
        return json.dumps(result.to_dicts(), default=str, ensure_ascii=False)
    if form == "csv":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(result.columns)
        writer.writerows([["" if v is None else v for v in r] for r in result.rows])
        return out.getvalue().rstrip("\n")
    return result.to_text(limit)


def _open(args) -> Engine:
    spark = session()
    try:
        return Engine.open(spark, args.db)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) and getattr(args, "create", False):
            return Engine(spark)
        raise


def load(args) -> str:
    e = _open(args)
    frame = loaders.read_csv(e.spark, args.file)
    if args.dims:
        e.load_frame(frame, args.dims.split(","), args.measure, args.name, agg=args.agg, ordered_dims=(args.ordered or "").split(","))
    else:
        e.load_dimension(frame, args.key, args.name, attributes=[a for a in (args.attributes or "").split(",") if a], measures=[m for m in (args.measures or "").split(",") if m])
    e.save(args.out or args.db)
    return e.summary()


def hierarchy(args) -> str:
    e = _open(args)
    frame = loaders.read_csv(e.spark, args.file)
    kind = e.catalog.dimension(args.child).data_type
    e.add_hierarchy(args.child, args.parent, frame.select(F.col(args.child).cast(kind) if kind is not None else F.col(args.child), args.parent), args.ordered)
    e.save(args.out or args.db)
    return e.summary()


def query(args) -> str:
    result = _open(args).sql(args.sql, args.role)
    out = shown(result, args.format, args.limit)
    return out + (f"\n{result.stats}" if args.timing else "")


def explain(args) -> str:
    return _open(args).explain(args.sql, args.role, args.physical)


def decompose(args) -> str:
    return json.dumps(_open(args).decompose(args.sql, args.role), indent=1, ensure_ascii=False)


def info(args) -> str:
    e = _open(args)
    return e.summary() + "".join(f"\n{json.dumps(e.stats(c))}" for c in e.cubes)


def shell(args, read=input, write=print) -> str:
    r"""Queries line by line; ``\e`` explains, ``\s`` decomposes, ``\i`` tells what there is, ``\q`` ends."""
    e = _open(args)
    while True:
        try:
            line = read("> ").strip()
        except EOFError:
            return ""
        try:
            if line in (r"\q", "quit", "exit"):
                return ""
            if line == r"\i":
                write(e.summary())
            elif line.startswith(r"\e "):
                write(e.explain(line[3:], args.role))
            elif line.startswith(r"\s "):
                write(json.dumps(e.decompose(line[3:], args.role), ensure_ascii=False))
            elif line:
                write(shown(e.sql(line, args.role), args.format, args.limit))
        except (QuerySyntaxError, BindError, AccessDenied, KeyError, ValueError) as error:
            write(f"{type(error).__name__}: {error}")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cellgrain", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("--db", default="cellgrain.db")
    out.add_argument("--role")
    out.add_argument("--format", choices=("text", "csv", "json"), default="text")
    out.add_argument("--limit", type=int, default=50)
    out.add_argument("--timing", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)
    p = commands.add_parser("load", help="a CSV file as a fact (--dims, --measure) or as a dimension (--key)")
    p.add_argument("file")
    for name in ("--dims", "--measure", "--key", "--name", "--attributes", "--measures", "--ordered", "--out"):
        p.add_argument(name)
    p.add_argument("--agg", default="sum")
    p.set_defaults(run=load, create=True)
    p = commands.add_parser("hierarchy", help="a CSV file of children and parents")
    p.add_argument("file")
    p.add_argument("--child", required=True)
    p.add_argument("--parent", required=True)
    p.add_argument("--ordered", action="store_true")
    p.add_argument("--out")
    p.set_defaults(run=hierarchy)
    for name, run in (("query", query), ("explain", explain), ("decompose", decompose)):
        p = commands.add_parser(name)
        p.add_argument("sql")
        if name == "explain":
            p.add_argument("--physical", action="store_true")
        p.set_defaults(run=run)
    commands.add_parser("signature", help="the algebra's operations and laws").set_defaults(run=lambda args: describe_signature())
    commands.add_parser("doctor", help="the environment").set_defaults(run=lambda args: report(session()))
    commands.add_parser("info").set_defaults(run=info)
    commands.add_parser("shell").set_defaults(run=shell)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if text := args.run(args):
            print(text)
        return 0
    except (QuerySyntaxError, BindError, AccessDenied) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    except (KeyError, ValueError, MemoryError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
