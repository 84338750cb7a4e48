"""Command line: python -m corvane infer | annotate | generate | validate | time."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
import time
from concurrent.futures import ThreadPoolExecutor


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane", description="Schema contracts over DataFrames")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("annotate", help="schema of YAML files and their comments")
    a.add_argument("paths", nargs="+")
    a.add_argument("--dialects", help="comma-separated, first wins")
    a.add_argument("--strict", action="store_true")
    a.add_argument("--defaults", action="store_true")
    i = sub.add_parser("infer", help="schema of a column of JSON text in Parquet files")
    i.add_argument("path")
    i.add_argument("column")
    i.add_argument("--title")
    i.add_argument("--strict", action="store_true")
    i.add_argument("--defaults", action="store_true")
    i.add_argument("--required", action="store_true")
    g = sub.add_parser("generate", help="schema of the columns of Parquet files")
    g.add_argument("path")
    g.add_argument("--title")
    g.add_argument("--draft7", action="store_true")
    v = sub.add_parser("validate", help="numbers of violations by keyword and path; exit code 1 if there are any")
    v.add_argument("schema", help="file with a JSON Schema")
    v.add_argument("path", help="Parquet files")
    v.add_argument("--column", help="a column of JSON text instead of the rows")
    v.add_argument("--formats", action="store_true")
    v.add_argument("--null-as", choices=["absent", "null"], default="absent")
    t = sub.add_parser("time", help="seconds of shell commands as NAME=COMMAND; the longest if parallel, else the sum")
    t.add_argument("stages", nargs="+")
    t.add_argument("--parallel", action="store_true")
    for s in (a, i, g):
        s.add_argument("--indent", type=int, default=2)
    return p


def time_stages(stages: dict[str, str], parallel: bool) -> dict:
    """Runs shell commands; seconds and exit code of each, and the whole time: wall clock, longest and sum."""

    def run(command: str) -> tuple[float, int]:
        started = time.time()
        code = subprocess.run(command, shell=True, stdout=subprocess.DEVNULL).returncode  # noqa: S602  the caller's own commands
        return round(time.time() - started, 3), code

    started = time.time()
    with ThreadPoolExecutor(max_workers=len(stages) if parallel else 1) as pool:
        got = dict(zip(stages, pool.map(run, stages.values()), strict=True))
    seconds = [s for s, _ in got.values()]
    return {"stages": {n: {"seconds": s, "exit": c} for n, (s, c) in got.items()}, "wall": round(time.time() - started, 3), "longest": max(seconds), "sum": round(sum(seconds), 3)}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "time":
        stages = dict(s.split("=", 1) for s in args.stages)
        print(json.dumps(time_stages(stages, args.parallel)))
        return 0
    from pyspark.sql import SparkSession

    from corvane.operators.annotate import annotate_files
    from corvane.operators.contract import Contract
    from corvane.operators.generate import schema_of
    from corvane.operators.infer import infer, schema_text
    from corvane.plans.model import DRAFT7, DRAFT2020

    spark = SparkSession.builder.getOrCreate()
    if args.command == "annotate":
        use = args.dialects.split(",") if args.dialects else None
        out = annotate_files(spark, *args.paths, use=use, strict=args.strict, defaults=args.defaults)
    elif args.command == "infer":
        out = infer(spark.read.parquet(args.path), args.column, title=args.title, strict=args.strict, defaults=args.defaults, required=args.required)
    elif args.command == "generate":
        out = schema_of(spark.read.parquet(args.path), args.title, draft=DRAFT7 if args.draft7 else DRAFT2020)
    else:
        with open(args.schema, encoding="utf-8") as f:
            contract = Contract(f.read(), args.null_as, formats=args.formats)
        rows = contract.report(spark.read.parquet(args.path), args.column, parse=args.column is not None).orderBy("keyword", "instance_path").collect()
        for r in rows:
            print(f"{r.n}\t{r.keyword}\t{r.instance_path}")
        return int(bool(rows))
    sys.stdout.write(schema_text(out, args.indent or None))
    return 0


if __name__ == "__main__":
    sys.exit(main())
