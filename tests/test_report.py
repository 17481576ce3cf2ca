import json

import pytest
from pyspark.sql import functions as F

from lexigrain.functions import text as X
from lexigrain.functions.random import weighted
from lexigrain.operators import report
from lexigrain.session import describe_session

RUNS = [(0, 2.0, 1.0, 10), (1, 1.0, 4.0, 20), (2, 1.0, 1.0, 0), (3, 9.0, 1.0, 5)]


def test_comparison_order_and_summary(spark):
    df = spark.createDataFrame(RUNS, report.COMPARISON)
    out = report.comparison_table(df, 1000).collect()
    assert [r.query_id for r in out] == [3, 0, 2, 1]
    assert [r.change for r in out] == ["9.00X", "2.00X", "1.00X (slowdown)", "4.00X (slowdown)"]
    assert [r["diff"] for r in out] == ["-8.00s", "-1.00s", "+0.00s", "+3.00s"]
    assert out[1].selectivity == "1.0000%"
    s = report.comparison_summary(df).first()
    assert (s.queries, s.slow_queries, round(s.geomean, 9)) == (4, 2, round((2 * 0.25 * 1 * 9) ** 0.25, 9))
    assert report.comparison_summary(df.where("false")).first().geomean == 1.0


def test_numbers_are_rounded_as_printf_does(spark):
    values = [0.00375, 0.00675, 0.00625, 0.03125, 5e-05, 0.00005000001, 1.00005, 2.5, 12.34565, 123456.78905, 1e15 + 0.5, 0.0, 3 / 1.2e6 * 100, 9 / 1.2e6 * 100]
    values += [-v for v in values]
    out = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.fixed(F.col("v"), 4).alias("four"), X.fixed(F.col("v"), 2).alias("two")).collect()
    assert [(r.four, r.two) for r in out] == [("%.4f" % r.v, "%.2f" % r.v) for r in out]
    assert spark.range(1).select(X.fixed(F.lit(None).cast("double"), 4)).first()[0] is None


@pytest.mark.parametrize("times", [16, 80])  # shares with a 5 as the fifth decimal: 0.03125 %, which binary holds, and 0.00625 %, which it does not
def test_comparison_order_of_more_rows_equals_sql(spark, tmp_path, times):
    from helpers import SF, same_as_sql

    from lexigrain.plans.registry import ORACLE_SQL, QUERIES

    part = spark.read.parquet(f"{SF}/part.parquet")
    copies = part.crossJoin(spark.range(times)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * part.count()).drop("id")
    copies.coalesce(1).write.parquet(str(tmp_path / "copies"))
    next((tmp_path / "copies").glob("*.parquet")).rename(tmp_path / "part.parquet")
    same_as_sql(QUERIES["comparison_order"](spark, str(tmp_path)), ORACLE_SQL["comparison_order"], str(tmp_path))


def test_an_unknown_time_shows_nothing(spark):
    out = report.comparison_table(spark.createDataFrame([(0, None, 1.0, 10), (1, 2.0, 1.0, None)], report.COMPARISON), 1000).collect()
    assert [(r.query_id, r.baseline, r["diff"], r.selectivity, r.change) for r in out] == [(1, "2.0000s", "-1.00s", None, "2.00X"), (0, None, None, "1.0000%", None)]


def test_places_over_many_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a task per shuffle partition
    try:
        df = spark.range(1000).select((F.col("id") * 7 % 10).alias("k"), "id")
        out = report.placed(df, [F.col("k").desc(), F.col("id")]).orderBy("place")
        rows = [tuple(r) for r in out.select("k", "id", "place").collect()]
        assert report.placed(df.where("false"), [F.col("id")]).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    want = sorted(((i * 7 % 10, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    assert rows == [(*r, i) for i, r in enumerate(want)]


def test_compare_runs_both(spark):
    out = report.compare(spark, [(7, lambda: spark.range(3), lambda: spark.range(3))]).first()
    assert out.query_id == 7 and out.rows == 3 and out.baseline > 0


def test_counter_texts(spark, tmp_path):
    for run, more in (("01-first", ""), ("02-second", "  noise\n")):
        d = tmp_path / run
        d.mkdir()
        (d / "stat.txt").write_text(more + "   126,373,849,195      cycles\n 150,000 instructions  #    1.20  insn per cycle\n  3.5 seconds time elapsed\n\n  2.25 seconds user\n")
    out = report.counter_stats(spark, [str(tmp_path / "*" / "stat.txt")]).orderBy("run").collect()
    assert [r.run for r in out] == ["01", "02"]
    r = out[0]
    assert (r.cycles, r.instructions, r["cache-misses"], r.time_elapsed, r.user_time, r.sys_time, r.insn_per_cycle) == (126373849195, 150000, None, 3.5, 2.25, None, 1.2)
    report.write_json(report.counter_stats(spark, [str(tmp_path / "*" / "stat.txt")]), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_result_files(spark, tmp_path):
    for w, b, t in ((1, 1024, 5.0), (2, 1024, 3.0), (2, 5120, 4.0)):
        body = {"results": [{"mean": t, "times": [t, t + 1], "custom_metrics": {"total_time_ms": t * 1000}}]}
        (tmp_path / f"run-W{w}-R10000000-B{b}.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "other.json").write_text('{"results": [{"mean": 1.0}]}')
    df = report.benchmark_results(spark, str(tmp_path))
    assert df.count() == 3 and {r.batch_label for r in df.collect()} == {"1K", "5K"}
    out = {r.writers: (r["1024"], r["5120"]) for r in report.pivot_mean(df, "writers", "batch_size", [1024, 5120], "custom_metrics.total_time_ms").collect()}
    assert out == {1: (5000.0, None), 2: (3000.0, 4000.0)}


def test_enriched_results(spark):
    text = "x\nTotal generation and write time: 444.4ms.\nRecord Throughput: 23M records/sec\nIn-Memory Throughput: 1.08 GB/s"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id int, out string")
    a, b = report.with_metrics(df, F.col("out")).orderBy("id").collect()
    assert tuple(a.custom_metrics) == (444.4, 23.0, 1.08) and b.custom_metrics is None


def test_box_plot_leaves_outliers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]], "k string, v double")
    r = report.box_plot(df, "k", "v").first()
    assert (r.q1, r.q2, r.q3, r.low, r.high) == (2.0, 3.0, 4.0, 1.0, 4.0)


def test_small_functions(spark):
    df = spark.range(1).select(
        X.short_count(F.lit(23_400_000)).alias("m"), X.short_count(F.lit(4096)).alias("k"), X.short_count(F.lit(12)).alias("n"),
        X.phone_number(F.lit(7)).alias("p"), X.phone_id(F.lit("+91-0000000007")).alias("i"), X.phone_id(F.lit("7")).alias("none"),
        weighted(F.lit(0.95), {"a": 90, None: 10}).alias("w"), X.word_count(F.lit("a  b")).alias("c"), X.word_count(F.lit("")).alias("e"),
    )
    assert tuple(df.first()) == ("23M", "4K", "12", "+91-0000000007", 7, None, None, 3, 1)
    assert describe_session(spark)["time_zone"] == "UTC"


def test_scratch_without_a_checkpoint_folder(spark):
    from pathlib import Path
    from types import SimpleNamespace

    from lexigrain.session import scratch_dir

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master=master))
    bare = session("local[8]")
    first, second = scratch_dir(bare), scratch_dir(bare)
    assert first != second and Path(first).parent == Path(second).parent and Path(first).parent.is_dir()
    assert scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]", "k8s://b"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch_dir(session(master))
