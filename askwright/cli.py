"""Command line: list the queries, run one, explain one, read a table, publish a run.

    python -m askwright.cli list
    python -m askwright.cli run bm25_topk /path/of/tables [--out folder]
    python -m askwright.cli explain bm25_topk /path/of/tables
    python -m askwright.cli import-fiches table.csv --id number --title title --body text [--out folder]
    python -m askwright.cli read-documents folder [--out folder]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession


def _finish(df: DataFrame, out: str | None) -> None:
    if out:
        from askwright.sources.runs import publish

        publish(df, out, df.sparkSession.sparkContext.applicationId)
    else:
        df.show(20, truncate=80)


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="askwright")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    for name in ("run", "explain"):
        sub = commands.add_parser(name)
        sub.add_argument("query")
        sub.add_argument("tables")
        sub.add_argument("--out")
    sub = commands.add_parser("import-fiches")
    sub.add_argument("path")
    sub.add_argument("--id", required=True)
    sub.add_argument("--title", required=True)
    sub.add_argument("--body", required=True, action="append")
    sub.add_argument("--out")
    sub = commands.add_parser("read-documents")
    sub.add_argument("folder")
    sub.add_argument("--out")
    args = parser.parse_args(argv)
    from askwright.plans.catalogue import ORACLE_SQL, QUERIES

    if args.command == "list":
        print("\n".join(f"{name}{'' if name in ORACLE_SQL else ' (no SQL)'}" for name in sorted(QUERIES)))
        return 0
    if args.command in ("run", "explain") and args.query not in QUERIES:
        print(f"no query {args.query!r}; `list` names them", file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "run":
        _finish(QUERIES[args.query](spark, args.tables), args.out)
    elif args.command == "explain":
        QUERIES[args.query](spark, args.tables).explain("formatted")
    elif args.command == "import-fiches":
        from askwright.sources.documents import import_fiches
        from askwright.sources.tables import read_rows, resolve_column

        rows = read_rows(spark, args.path)
        find = lambda c: resolve_column(rows.columns, c)
        _finish(import_fiches(rows, find(args.id), find(args.title), [find(b) for b in args.body]), args.out)
    else:
        from askwright.sources.documents import read_documents

        _finish(read_documents(spark, args.folder), args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
