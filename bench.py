"""Headline queries at one scale: prints one JSON line with the seconds of each, and their sum.

Each query runs once to warm up and then twice; the faster run counts.  Indexes are built once to warm up and once
more, as their building is a query of its own.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import functions as F

from lexigrain.operators.fulltext import Bool, Phrase, Term, postings_of
from lexigrain.operators.rewrite import like_indexed, phrase_match, where_indexed
from lexigrain.plans.registry import QUERIES
from lexigrain.session import get_session
from lexigrain.sources import generate as g
from lexigrain.sources.index import build_index

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TITLES = CONTACTS = 1_000_000


def main() -> None:
    tmp = tempfile.mkdtemp(prefix="bench-")
    spark = get_session("bench", **{"spark.master": f"local[{CPUS}]", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"{tmp}/checkpoints"})
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    seconds = {}

    def built(name: str, build):
        for attempt in range(2):
            began = time.perf_counter()
            table = build(f"{tmp}/{name}{attempt}")
            seconds[name] = time.perf_counter() - began
        return table

    indexed = built("build_index_documents", lambda path: build_index(docs, path, "doc_id", "text"))
    titles = built("generate_and_index_1m_titles", lambda path: build_index(g.titles(spark, TITLES, partitions=int(CPUS)), path))
    runs = iter(range(1000))

    def contacts():
        path = f"{tmp}/contacts{next(runs)}"
        g.contacts(spark, CONTACTS, partitions=int(CPUS)).write.parquet(path)

    def sink():
        g.write_parallel(spark, g.PipelineConfig(CONTACTS, 4, 4096, f"{tmp}/sink{next(runs)}", total_threads=int(CPUS) + 4))

    count = lambda df: df.agg(F.count("*")).collect()
    timed = {
        "generate_and_write_1m_contacts": contacts,
        "parallel_sink_1m_contacts": sink,
        "like_scan_titles": lambda: count(titles.docs.where(F.col("title").like("%idempotency runtime%"))),
        "like_indexed_titles": lambda: count(like_indexed(titles, "%idempotency runtime%", scan_share=0.01)),
        "like_planned_titles": lambda: count(like_indexed(titles, "%runtime indexing%")),
        "where_indexed_titles": lambda: count(where_indexed(titles, "title LIKE '%idempotency runtime%' AND id % 2 = 0", scan_share=0.01)),
        "phrase_titles": lambda: count(phrase_match(titles, "atomics idempotency")),
        "term_count_titles": lambda: titles.session().count(Term("idempotency")),
        "bool_titles": lambda: titles.session().count(Bool(should=(Term("atomics"), Phrase.of("runtime indexing")), must_not=(Term("normalization"),))),
        "like_scan_documents": lambda: count(indexed.docs.where(F.col("text").like("%of the%"))),
        "tokenise_documents": lambda: count(postings_of(docs, "doc_id", "text")),
    }
    for name in ("text_stats", "hit_lookup_join", "lateral_unnest_outer", "list_size_distribution", "pivot_mean", "quartiles", "median_min_max", "contiguous_ids", "topk_nulls_first"):
        timed[name] = lambda q=QUERIES[name]: q(spark, SF_DIR).collect()
    for name, run in timed.items():
        best = float("inf")
        for _ in range(3):
            began = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - began)
        seconds[name] = best
    print(json.dumps({"metric": "sum of best query times", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": {k: round(v, 4) for k, v in seconds.items()}, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()
    shutil.rmtree(tmp, ignore_errors=True)


if __name__ == "__main__":
    main()
