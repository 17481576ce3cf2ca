"""Command lines: generate documents, compare index and scan, write contacts in parallel."""

from __future__ import annotations

import argparse
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.operators.report import compare, comparison_summary, comparison_table
from lexigrain.operators.rewrite import id_in, like_indexed
from lexigrain.session import get_session
from lexigrain.sources import generate as g
from lexigrain.sources.index import build_index, open_index

PAIRS = [f"%{a} {b}%" for a, b in product(g.CONTROL_WORDS, repeat=2)]


def chosen(df: DataFrame, id_col: str, ids: list[int]) -> DataFrame:
    """The rows with the given numbers; an empty list means all."""
    return id_in(df, id_col, ids) if ids else df


def generate(args: argparse.Namespace) -> None:
    """The same rows with and without an index, and the documents of every control word."""
    spark = get_session()
    rows = g.titles(spark, args.target_records, args.seed)
    path = f"{args.output_dir}/{g.docs_name(args.target_records)}"
    rows.write.parquet(path)
    table = build_index(spark.read.parquet(path), f"{args.output_dir}/{g.docs_name(args.target_records, True)}")
    table.session().histogram(list(g.CONTROL_WORDS)).orderBy("term").show(truncate=False)


def benchmark(args: argparse.Namespace) -> None:
    """All ordered pairs of control words, or those with the given numbers."""
    spark = get_session()
    table = open_index(spark, args.path)
    chosen = [i for i in range(len(PAIRS)) if not args.filter or i in args.filter]
    scan = lambda p: table.docs.where(F.col("title").like(p))
    results = compare(spark, [(i, lambda p=PAIRS[i]: scan(p), lambda p=PAIRS[i]: like_indexed(table, p)) for i in chosen])
    comparison_table(results, table.manifest.doc_count).show(len(PAIRS), truncate=False)
    comparison_summary(results).show()


def contacts(args: argparse.Namespace) -> None:
    config = g.PipelineConfig(args.target_records, args.num_writers, args.record_batch_size, args.output_dir, args.output_filename)
    print(config)
    if not args.dry_run:
        print(g.write_parallel(get_session(), config))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexigrain", description=__doc__)
    commands = parser.add_subparsers(required=True)
    p = commands.add_parser("generate", help=generate.__doc__)
    p.add_argument("-t", "--target-records", type=int, default=1_000_000)
    p.add_argument("-s", "--seed", type=int, default=12345)
    p.add_argument("-o", "--output-dir", default="output")
    p.set_defaults(run=generate)
    p = commands.add_parser("benchmark", help=benchmark.__doc__)
    p.add_argument("-p", "--path", required=True)
    p.add_argument("-f", "--filter", type=int, nargs="*", default=[])
    p.set_defaults(run=benchmark)
    p = commands.add_parser("contacts", help="write contacts in parallel")
    p.add_argument("--target-records", type=int, default=10_000_000)
    p.add_argument("--record-batch-size", type=int, default=4096)
    p.add_argument("--num-writers", type=int, default=4)
    p.add_argument("--output-dir", default="output_parquet")
    p.add_argument("--output-filename", default="contacts")
    p.add_argument("--dry-run", action="store_true")
    p.set_defaults(run=contacts)
    args = parser.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
