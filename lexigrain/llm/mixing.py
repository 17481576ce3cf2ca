"""Mixing sources to target weights (DataFrame functions only).

Rows get hash-random keys; within each source they are sorted by ranges of the key, and two-level prefix sums of
the token counts (totals of groups of ranges and of ranges, then rows within a range) say where the source's exact budget cuts.  A budget
above the source's size takes whole epochs first and cuts in the last one.

A source is cut into ranges of about RANGE_ROWS rows, so a source with a third of all rows is spread over as many
tasks as its share asks for.  Targets follow the weights, but stop at MAX_EPOCHS times the source's size; what
that frees is shared again by weight until no target is above.

Defined cases: a null text has size 0; the null source comes last; equal keys are ordered by identifier, then by
the row's place in the input; sources without words get target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, key60, numbered, ranked, small, table

MAX_EPOCHS = 3
#: Rows in a range of a source, about, and bits of a range's number within its group: with 4096 ranges a group, the
#: longest run of sums that one task sees is a 4,000,000th of a source's rows.
RANGE_ROWS, GROUP_BITS = 1024, 12
WEIGHTS = (1, 2, 3)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """A row per source: source, source_size, rows, target; and their number.  ``rows`` has source and size."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    per = ranked(sums, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = table(per.withColumn("weight", weight.cast("long")).drop("rank"))
    total = per.agg(F.sum("source_size").alias("all"), F.count("*").alias("n")).first()
    if not total["n"]:
        return per.withColumn("target", F.lit(0.0)), 0
    share = 0.0
    while True:  # the full sources only become more, and few rounds add any
        full = F.col("source_size") * max_epochs < F.col("weight") * F.lit(share)
        now = per.agg(F.sum(F.when(full, F.col("source_size") * max_epochs).otherwise(0)).alias("full"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not now["open"]:
            break
        grown = (total["all"] - now["full"]) / now["open"]
        if grown <= share:
            break
        share = grown
    target = F.least((F.col("source_size") * max_epochs).cast("double"), F.col("weight") * F.lit(share))
    return per.withColumn("target", target), total["n"]


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size=None, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, key_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, and row, its place in the scan."""
    size = word_count(F.col("text")) if size is None else size
    key = key60(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key_col or id_col).cast("string"), F.lit("null"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = table(rows)  # the sizes are counted once
    per, n = source_targets(rows, weights)
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / RANGE_ROWS))).cast("int")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("div(_budget, source_size)")).otherwise(0)
    per = per.withColumns({"_bits": bits, "_budget": budget}).withColumn("_epochs", epochs)
    per = table(per.withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size")).drop("weight", "rows"))
    rows = rows.withColumnRenamed("source", "_source").join(small(per, n), F.col("_source").eqNullSafe(F.col("source")))
    rows = rows.drop("_source").withColumn("_range", F.expr("shiftright(key, 60 - _bits)"))
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    # Sums before each range: before its group of ranges, and within that.
    ranges = table(ranges.withColumn("_group", F.expr(f"shiftright(_range, {GROUP_BITS})")))
    groups = ranges.groupBy("source", "_group").agg(F.sum("_sum").alias("_sum"))
    groups = groups.select(F.col("source").alias("_source"), F.col("_group").alias("_in"), F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ranges = ranges.join(groups, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_group") == F.col("_in"))).drop("_source")
    before = F.col("_base") + F.coalesce(F.sum("_sum").over(Window.partitionBy("source", "_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(F.col("source").alias("_source"), F.col("_range").alias("_of"), before.alias("_before"))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_of")))
    order = Window.partitionBy("source", "_range").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - prior))
    taken = F.col("_epochs") * F.col("size") + more
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "row")


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it; the row at the cut is taken whole if at least half of it is.

    Texts without words carry no budget and stay once.
    """
    rows, row = numbered(docs)
    times_col = fresh(rows, "_times")
    named = rows.select(F.struct(F.col(id_col).alias("id"), F.col(row).alias("row")).alias("doc_id"), F.col(id_col).alias("key"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    taken = mix(named, seed=seed, key_col="key")
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    times = taken.select(F.col("doc_id.row").alias(row), times.alias(times_col)).where(F.col(times_col) > 0)
    rows = rows.join(times, row)
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times_col))).alias(fresh(rows, "_time"))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
w AS (SELECT *, (pos - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, source_size * 3.0 / weight AS ratio,
             (total - coalesce(sum(3 * source_size) OVER b, 0)) / CAST(sum(weight) OVER a AS DOUBLE) AS share
      FROM w WINDOW b AS (ORDER BY source_size / CAST(weight AS DOUBLE), pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    a AS (ORDER BY source_size / CAST(weight AS DOUBLE), pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT max(share) AS share FROM o),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * f.share) AS target FROM o, f),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
      FROM d k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - prior)) END AS BIGINT) AS taken
FROM p
"""
