"""Queries of the reports: comparisons, parsed logs, result files and what is added to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions import text as X
from lexigrain.operators import report
from lexigrain.plans.catalog import query, read
from lexigrain.session import scratch_dir
from lexigrain.sources import files

_RUNS = "SELECT p_partkey AS query_id, p_size / 8.0 AS baseline, 1 + p_partkey % 5 / 4.0 AS optimized, p_partkey % 100 AS rows FROM part"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up times that floating point holds exactly."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(key.cast("long").alias("query_id"), (F.col("p_size") / 8.0).alias("baseline"), (1 + key % 5 / 4.0).alias("optimized"), (key % 100).cast("long").alias("rows"))


@query(f"""WITH r AS ({_RUNS}), n AS (SELECT count(*) AS n FROM part)
SELECT row_number() OVER (ORDER BY baseline / optimized DESC, query_id) - 1 AS place, CAST(query_id AS BIGINT) AS query_id, printf('%.4fs', baseline::DOUBLE) AS baseline, printf('%.4fs', optimized::DOUBLE) AS optimized,
    CASE WHEN baseline > optimized THEN '-' ELSE '+' END || printf('%.2fs', round(abs(optimized - baseline)::DOUBLE, 2)) AS diff, CAST(rows AS BIGINT) AS rows, printf('%.4f%%', rows / n::DOUBLE * 100) AS selectivity,
    CASE WHEN baseline > optimized THEN printf('%.2fX', round((baseline / optimized)::DOUBLE, 2)) ELSE printf('%.2fX (slowdown)', round((1 / (baseline / optimized))::DOUBLE, 2)) END AS change FROM r, n""")
def comparison_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speedups first, the largest of them first, then slowdowns from the mildest on; with the place of each row."""
    runs = report.placed(_runs(spark, sf_dir), report.comparison_keys())
    return runs.orderBy("place").select("place", *report.comparison_columns(read(spark, sf_dir, "part").count()))


@query(f"WITH r AS ({_RUNS}) SELECT count(*) AS queries, count(*) FILTER (WHERE optimized >= baseline) AS slow_queries, round(exp(avg(ln(baseline / optimized))), 6) AS geomean FROM r")
def comparison_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.comparison_summary(_runs(spark, sf_dir)).withColumn("geomean", F.round("geomean", 6))


@query("SELECT p_partkey, CASE WHEN p_size < 25 THEN '-' ELSE '+' END || printf('%.2fs', abs(p_size - 25) / 4.0) AS saved FROM part")
def signed_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", X.signed_seconds((F.col("p_size") - 25) / 4.0).alias("saved"))


def _named_files(df: DataFrame) -> str:
    """Each row's ``value`` as a file at its ``path`` below a new folder, which is returned."""
    spark = df.sparkSession
    folder = scratch_dir(spark)
    for path, value in df.orderBy("path").collect():  # as many files as a handful of runs have
        files.write_file(spark.createDataFrame([(value,)], "value string"), f"{folder}/{path}", "text")
    files.remove_at_exit(spark, folder)
    return folder


_SIZES = "(1, 1024), (2, 1024), (2, 5120), (4, 5120)"


@query(f"""WITH f(w, b) AS (VALUES {_SIZES}), t AS (SELECT w, b, sum(p_size) / 8.0 AS t FROM f, part WHERE p_partkey % w = 0 GROUP BY ALL)
SELECT CAST(w AS BIGINT) AS writers, CAST(1000000 AS BIGINT) AS records, CAST(b AS BIGINT) AS batch_size, t::DOUBLE AS mean, t::DOUBLE + 1 AS slowest, (t * 1000)::DOUBLE AS total_time_ms, (b // 1000) || 'K' AS batch_label FROM t""")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files, whose names say what they are of, back as a table; a file of another name is left out."""
    sizes = spark.createDataFrame([(1, 1024), (2, 1024), (2, 5120), (4, 5120)], "w int, b int")
    part = read(spark, sf_dir, "part").withColumn("w", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).where("p_partkey % w = 0")
    times = part.groupBy("w").agg((F.sum("p_size") / 8.0).alias("t")).join(sizes, "w")
    body = F.to_json(F.struct(F.array(F.struct(F.col("t").alias("mean"), F.array("t", F.col("t") + 1).alias("times"), F.struct((F.col("t") * 1000).alias("total_time_ms")).alias("custom_metrics"))).alias("results")))
    texts = times.select(F.format_string("run-W%d-R1000000-B%d.json", "w", "b").alias("path"), body.alias("value"))
    other = spark.createDataFrame([("other.json", '{"results": [{"mean": 1.0}]}')], "path string, value string")
    read_back = report.benchmark_results(spark, _named_files(texts.union(other)))
    return read_back.select("writers", "records", "batch_size", "mean", F.element_at("times", 2).alias("slowest"), "custom_metrics.total_time_ms", "batch_label")


@query("""SELECT lpad(CAST(e AS VARCHAR), 2, '0') AS run, sum(p_partkey * 1000)::BIGINT AS cycles, count(*)::BIGINT AS instructions, CAST(NULL AS BIGINT) AS cache_misses, sum(p_size)::DOUBLE / 4 AS time_elapsed, 1.25::DOUBLE AS insn_per_cycle
FROM (SELECT p_partkey % 3 AS e, * FROM part) GROUP BY e""")
def counter_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter texts in a folder per run, parsed, written as JSON and read again."""
    runs = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 3).alias("e")).agg(F.sum(F.col("p_partkey") * 1000).alias("c"), F.count("*").alias("n"), (F.sum("p_size") / 4).alias("t"))
    text = F.format_string("noise\n   %,d      cycles\n %,d instructions  #    1.25  insn per cycle\n\n  %.4f seconds time elapsed\n", "c", "n", "t")
    folder = _named_files(runs.select(F.format_string("%02d-run/stat.txt", "e").alias("path"), text.alias("value")))
    stats = report.counter_stats(spark, [f"{folder}/*/stat.txt"])
    report.write_json(stats, f"{folder}/parsed")
    again = spark.read.schema(stats.schema).json(f"{folder}/parsed")
    return again.select("run", "cycles", "instructions", F.col("cache-misses").alias("cache_misses"), "time_elapsed", "insn_per_cycle")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size / 4.0::DOUBLE END AS total_time_ms, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS record_throughput_m_sec, p_size % 2 = 1 AS without FROM part""")
def enriched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's own figures from its output, beside its result; a run that printed none has none."""
    size = F.col("p_size")
    output = F.when(size % 2 == 0, F.concat(F.format_string("x\nTotal generation and write time: %.2fms.\n", size / 4.0), F.format_string("Record Throughput: %dM records/sec", size))).otherwise("nothing")
    df = report.with_metrics(read(spark, sf_dir, "part").select("p_partkey", output.alias("out")), F.col("out"))
    return df.select("p_partkey", "custom_metrics.total_time_ms", "custom_metrics.record_throughput_m_sec", F.col("custom_metrics").isNull().alias("without"))
