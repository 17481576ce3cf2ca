"""Reports: index against scan, pivots, medians, geometric means, and parsed benchmark logs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.functions.text import fixed, short_count, signed_seconds
from lexigrain.session import scratch_dir
from lexigrain.sources.files import remove_at_exit

COMPARISON = "query_id long, baseline double, optimized double, rows long"


def geometric_mean(ratio: Column) -> Column:
    """An aggregate; 1.0 over no rows."""
    return F.coalesce(F.exp(F.avg(F.ln(ratio))), F.lit(1.0))


def speedup() -> Column:
    return F.col("baseline") / F.col("optimized")


def comparison_keys() -> list[Column]:
    """Speedups first and the largest of them first: slowdowns are ratios of at most one, and the mildest comes first."""
    return [speedup().desc_nulls_last(), F.col("query_id").asc_nulls_last()]


def comparison_columns(total_rows: int) -> list[Column]:
    """What a row of the comparison shows; equal times count as slow."""
    faster = F.col("baseline") > F.col("optimized")
    times = lambda ratio, suffix: F.concat(fixed(F.round(ratio, 2), 2), F.lit(suffix))
    seconds = lambda name: F.concat(fixed(F.col(name), 4), F.lit("s")).alias(name)
    share = F.col("rows") / F.lit(float(max(total_rows, 1))) * 100
    return [
        F.col("query_id"), seconds("baseline"), seconds("optimized"),
        signed_seconds(F.when(faster, -1).otherwise(1) * F.abs(F.col("optimized") - F.col("baseline"))).alias("diff"),
        F.col("rows"), F.concat(fixed(share, 4), F.lit("%")).alias("selectivity"),
        F.when(faster, times(speedup(), "X")).otherwise(times(1 / speedup(), "X (slowdown)")).alias("change"),
    ]


def comparison_table(results: DataFrame, total_rows: int) -> DataFrame:
    """The comparison in its order."""
    return results.orderBy(*comparison_keys()).select(*comparison_columns(total_rows))


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their places from 0 in ``order``, whatever the number of tasks; rows that tie get theirs in any order.

    The sorted partitions are written once, so their borders are fixed, and a count of each gives its first place.
    ``coalesce(1)`` would put partitions that have a preferred host before others, out of order.
    """
    spark = df.sparkSession
    folder = scratch_dir(spark)
    ordered = df.orderBy(*order).withColumn(name, F.monotonically_increasing_id())
    ordered.write.parquet(folder)
    remove_at_exit(spark, folder)
    rows = spark.read.schema(ordered.schema).parquet(folder)
    part = F.shiftright(name, 33)  # such an identifier is the partition's number, then the row's within it in 33 bits
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(counts.select("_part", before.alias("_before")))
    place = F.col("_before") + F.col(name).bitwiseAND((1 << 33) - 1)
    return rows.join(first, part == F.col("_part")).withColumn(name, place).drop("_part", "_before")


def comparison_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("queries"), F.count_if(F.col("optimized") >= F.col("baseline")).alias("slow_queries"), geometric_mean(speedup()).alias("geomean"))


def compare(spark: SparkSession, queries: list[tuple[int, Callable[[], DataFrame], Callable[[], DataFrame]]]) -> DataFrame:
    """Time both forms of each query; planning counts, and both must have the same number of rows."""
    out = []
    for query_id, baseline, optimized in queries:
        times, counts = [], []
        for query in (baseline, optimized):
            began = time.perf_counter()
            counts.append(query().count())
            times.append(time.perf_counter() - began)
        if counts[0] != counts[1]:
            raise AssertionError(f"query {query_id}: {counts[0]} rows by scan, {counts[1]} by index")
        out.append((query_id, *times, counts[0]))
    return spark.createDataFrame(out, COMPARISON)


def pivot_mean(df: DataFrame, row: str, column: str, values: list, metric: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.avg(metric))


def median_min_max(df: DataFrame, key: str, metric: str) -> DataFrame:
    return df.groupBy(key).agg(F.percentile(metric, F.lit(0.5)).alias("median"), F.min(metric).alias("min"), F.max(metric).alias("max"))


def box_plot(df: DataFrame, key: str, metric: str) -> DataFrame:
    """Quartiles, and whiskers at the furthest values within 1.5 times the interquartile range."""
    q = df.groupBy(key).agg(*(F.percentile(metric, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))
    inside = df.join(q, key).where(F.col(metric).between(F.expr("q1 - 1.5 * (q3 - q1)"), F.expr("q3 + 1.5 * (q3 - q1)")))
    return inside.groupBy(key, "q1", "q2", "q3").agg(F.min(metric).alias("low"), F.max(metric).alias("high"))


# Logs ---------------------------------------------------------------------------------------------------------------

#: Counters of a run, and the patterns of its figures.
COUNTERS = ("cycles", "instructions", "cache-references", "cache-misses", "branch-instructions", "branch-misses")
TIMES = {"time_elapsed": "seconds time elapsed", "user_time": "seconds user", "sys_time": "seconds sys"}
METRICS = {
    "total_time_ms": r"Total generation and write time: ([\d.]+)ms",
    "record_throughput_m_sec": r"Record Throughput: ([\d.]+)M records/sec",
    "mem_throughput_gb_sec": r"In-Memory Throughput: ([\d.]+) GB/s",
}


def _number(text: Column, pattern: str, kind: str) -> Column:
    """The first group as a number; NULL where the pattern is absent or its text is none."""
    found = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(""))
    return F.when(found != "", found).try_cast(kind)


def counter_stats(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row per counter text: run (the start of its folder's name) and its counters and times."""
    text = F.col("value")
    columns = [_number(text, rf"(?m)^\s*([\d,]+)\s+{c}", "bigint").alias(c) for c in COUNTERS]
    columns += [_number(text, rf"(?m)^\s*([\d.]+)\s+{t}", "double").alias(c) for c, t in TIMES.items()]
    columns.append(_number(text, r"#\s*([\d.]+)\s+insn per cycle", "double").alias("insn_per_cycle"))
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    read = spark.read.text(paths, wholetext=True)
    return read.select(F.element_at(F.split(folder, "-"), 1).alias("run"), *columns)


def parse_metrics(text: Column) -> Column:
    """The struct of a run's own figures found in its output."""
    return F.struct(*(_number(text, p, "double").alias(k) for k, p in METRICS.items()))


def benchmark_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files run-W<writers>-R<records>-B<batch>.json: their first result, named by the file."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    read = spark.read.option("multiLine", True).json(path).select(name.alias("file"), F.element_at("results", 1).alias("r"))
    pattern = r"run-W(\d+)-R(\d+)-B(\d+)\.json"
    parts = [F.regexp_extract("file", pattern, i + 1).cast("bigint").alias(n) for i, n in enumerate(("writers", "records", "batch_size"))]
    found = read.where(F.col("file").rlike(pattern)).select(*parts, "r.*")
    return found.withColumn("batch_label", short_count(F.col("batch_size")))


def with_metrics(results: DataFrame, output: Column) -> DataFrame:
    """Results enriched by the figures of their runs' output; a run without any keeps NULL."""
    metrics = parse_metrics(output)
    none = F.coalesce(*(metrics[k] for k in METRICS)).isNull()
    return results.withColumn("custom_metrics", F.when(~none, metrics))


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.json(path)
