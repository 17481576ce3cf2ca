import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain import cli
from lexigrain.operators import nested
from lexigrain.sources import generate as g
from lexigrain.sources import literal

rows = lambda df: sorted(map(tuple, df.collect()), key=str)


def test_same_rows_for_any_partitioning(spark):
    assert rows(g.titles(spark, 500, 7, 3)) == rows(g.titles(spark, 500, 7, 7))
    assert rows(g.contacts(spark, 500, 64, 7, 3)) == rows(g.contacts(spark, 500, 64, 7, 2))
    assert rows(g.titles(spark, 500, 7)) != rows(g.titles(spark, 500, 8))


def test_title_words(spark):
    df = g.titles(spark, 100_000, 1)
    shares = df.agg(*(F.avg(F.array_contains(F.split("title", " "), w).cast("double")).alias(w) for w in g.CONTROL_WORDS)).first()
    for word, share in g.CONTROL_WORDS.items():
        extra = 0.08 if word == "concurrency" else 0  # a filler word as well
        assert share * 0.7 <= shares[word] <= share * 1.3 + extra
    sizes = df.agg(F.min(F.size(F.split("title", " "))), F.max(F.size(F.split("title", " ")))).first()
    assert sizes[0] == 3 and sizes[1] <= 14
    twice = [w for w in g.CONTROL_WORDS if df.where(F.col("title").like(f"%{w} {w}%")).count()]
    assert twice == ["concurrency"]
    assert len(g.FILLER_WORDS) == 73


def test_contact_shares(spark):
    df = g.contacts(spark, 100_000).cache()
    ratio = nested.null_ratios(df, "name", "phones").first()
    assert abs(ratio.name - 0.2) < 0.05 and abs(ratio.phones - 0.4) < 0.05
    assert df.where(F.size("phones") == 0).count() == 0
    counts = {r.len: r.rows / 100_000 for r in nested.size_distribution(df, "phones").collect()}
    assert abs(counts[0] - 0.40) < 0.05 and abs(counts[1] - 0.45) < 0.05 and abs(counts[2] - 0.10) < 0.05
    assert set(counts) == set(range(6)) and abs(counts[3] + counts[4] + counts[5] - 0.05) < 0.05
    flat = nested.flatten_inner(df, "phones", "name").cache()
    kinds = {(r.n, r.t): r.share for r in nested.shares(flat.select(F.struct(F.col("number").isNotNull().alias("n"), F.col("phone_type").isNotNull().alias("t")).alias("k")), "k").select("k.*", "share").collect()}
    for key, want in {(True, True): 0.90, (True, False): 0.05, (False, True): 0.04, (False, False): 0.01}.items():
        assert abs(kinds[key] - want) < 0.05
    types = {r.phone_type: r.share for r in nested.shares(flat.where("phone_type IS NOT NULL"), "phone_type").collect()}
    for key, want in g.PHONE_TYPES.items():
        assert abs(types[key] - want / 100) < 0.05


@pytest.mark.parametrize(("n", "batch"), [(0, 16), (1, 16), (1000, 64), (1001, 64)])
def test_numbers_count_up_in_each_batch(spark, n, batch):
    df = g.contacts(spark, n, batch)
    assert df.count() == n
    numbers = sorted(int(r.number[4:]) for r in nested.flatten_inner(df, "phones").where("number IS NOT NULL").collect())
    assert all(r.number.startswith("+91-") and len(r.number) == 14 for r in nested.flatten_inner(df, "phones").where("number IS NOT NULL").take(5))
    by_batch = {}
    for x in numbers:
        by_batch.setdefault(x // (batch * 5), []).append(x)
    assert all(xs == list(range(b * batch * 5, b * batch * 5 + len(xs))) for b, xs in by_batch.items())


def test_running_count_needs_no_shuffle(spark):
    assert "Exchange" not in g.contacts(spark, 5000, 64, partitions=4)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("writers", [1, 2, 4, 8, 12])
def test_parallel_sink(spark, tmp_path, writers):
    config = g.PipelineConfig(10_000, writers, 1024, str(tmp_path), total_threads=16)
    metrics = g.write_parallel(spark, config)
    files = sorted(p.name for p in tmp_path.glob("*.parquet"))
    assert files == sorted(f"contacts_{i}.parquet" for i in range(min(writers, 10))) and metrics["bytes"] == sum((tmp_path / f).stat().st_size for f in files)
    sizes = [min(1024, 10_000 - b * 1024) for b in range(10)]
    for i in range(min(writers, 10)):
        assert spark.read.parquet(str(tmp_path / f"contacts_{i}.parquet")).count() == sum(sizes[i::writers])
    read = spark.read.parquet(str(tmp_path / "*.parquet"))
    assert read.schema.simpleString() == config.schema.simpleString() and read.count() == 10_000 == metrics["records"]
    assert rows(read) == rows(g.contacts(spark, 10_000, 1024))


def test_single_file_and_its_footer(spark, tmp_path):
    from lexigrain.sources.files import read_footer

    path = g.write_single(literal.contacts(spark), str(tmp_path))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["contacts.parquet"]
    assert rows(spark.read.parquet(path)) == rows(literal.contacts(spark))
    footer = read_footer(spark, path)
    assert footer.rows == 5 and footer.columns == ("name", "phones") and len(footer.groups) == 1
    assert footer.groups[0][1]["name"] == ("Alice", "Diana") and any("spark" in k for k in footer.metadata)


def test_numbers_of_a_batch(spark):
    flat = nested.flatten_inner(g.contacts_in_batches(spark, 1000, 64, 3), "phones", "batch").where("number IS NOT NULL")
    out = g.batch_bounds(flat.withColumn("n", F.substring("number", 5, 10).cast("long")), "batch", "n").collect()
    assert len(out) == 16
    for r in out:
        assert r["first"] == r.batch * 64 * 5 and r["last"] == r["first"] + r["numbers"] - 1


@pytest.mark.parametrize(("change", "message"), [
    ({"num_writers": 0}, "^Number of writers must be greater than zero.$"),
    ({"num_writers": 4, "total_threads": 4}, r"^No. of producer threads must be greater than zero. Total threads: 4. Writer threads: 4.$"),
    ({"schema": T.StructType([])}, "^The pipeline config is missing an Arrow schema definition.$"),
    ({"target_records": 2_000_000_001}, r"target_records \(2000000001\) is too high. Based on the system's capacity of 10000000000 unique phone numbers and a maximum of 5 phones per record, the limit for target_records is 2000000000\."),
])
def test_config_errors(change, message):
    with pytest.raises(g.PipelineConfigError, match=message):
        g.PipelineConfig(**({"total_threads": 16} | change))


def test_wrong_generator_schema(spark, tmp_path):
    with pytest.raises(g.PipelineConfigError, match="schema"):
        g.write_parallel(spark, g.PipelineConfig(10, 1, 4, str(tmp_path), total_threads=4), lambda s, n, b: s.range(n).withColumnRenamed("id", "batch"))


def test_flatten_golden(spark):
    c = literal.contacts(spark)
    inner = [("Alice", "555-1234", "Home"), ("Alice", "555-5678", "Work"), ("Diana", "555-9999", "Work"), (None, None, "Home")]
    assert rows(nested.flatten_inner(c, "phones", "name")) == sorted(inner, key=str)
    assert rows(nested.flatten_outer(c, "phones", "name")) == sorted([*inner, ("Bob", None, None), ("Charlie", None, None)], key=str)
    last = nested.flatten_outer(c, "phones", "name").orderBy(F.col("name").asc_nulls_last()).collect()[-1]
    assert last.name is None
    assert [r[0] for r in c.orderBy("name").select(nested.list_size("phones")).collect()] == [1, 2, 0, 0, 1]


def test_nested_columns_are_pruned(spark, tmp_path):
    path = str(tmp_path / "c")
    literal.contacts(spark).coalesce(1).write.parquet(path)
    plan = spark.read.parquet(path).select(F.explode("phones").alias("p")).select("p.number")._jdf.queryExecution().executedPlan().toString()
    assert "array<struct<number:string>>" in plan


def test_command_lines(spark, tmp_path, capsys):
    cli.main(["generate", "-t", "500", "-o", str(tmp_path)])
    cli.main(["benchmark", "-p", str(tmp_path / "docs_with_fts_index_500.parquet"), "-f", "0", "35"])
    cli.main(["contacts", "--num-writers", "1", "--dry-run"])
    out = capsys.readouterr().out
    assert "concurrency" in out and "geomean" in out and "PipelineConfig" in out
    assert len(cli.PAIRS) == 36 and cli.PAIRS[1] == "%concurrency runtime%"
