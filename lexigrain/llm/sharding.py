"""Sharding by extendible hashing (DataFrame functions only).

A directory is indexed by the leading bits of a record's hash.  A bucket above the byte limit splits on the next
bit, and only such buckets do.  Sizes are summed once at a depth a few bits below the one that an even hash would
need, coarser levels are sums of finer ones, and the bucket of a record is the first level on its path that fits.

A bucket that still doesn't fit at that depth is split again further down; one in which all records have the same
hash (one key with a third of all rows, say) goes on with a second hash, of the record's place.  So every shard
fits, except that a single record longer than the limit has a shard of its own.

Defined cases: a null key hashes as the text 'null'; a null text has no bytes; an empty table has no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, key60, numbered, small, table

#: Bytes of text in a shard at most, as the registered query uses it.
SHARD_BYTES = 64 << 20
#: Bits below the depth of an even split at which sizes are summed.
EXTRA_BITS = 4
HASH_BITS = 60


def _split(rows: DataFrame, roots: DataFrame, n_roots: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """One pass below ``roots`` (root, path, fine).  rows: root, hash, bytes, ...

    Returns the directory (root, at, path, depth, shard_bytes, shard_rows, same), where ``at`` is the hash prefix of
    ``fine`` bits and ``same`` says that one hash value fills the bucket; and rows with root, hash, at.
    """
    keyed = rows.join(small(roots, n_roots), "root").withColumn("at", F.expr(f"shiftright(hash, {HASH_BITS} - fine)"))
    fine = keyed.groupBy("root", "path", "fine", "at").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    fine = table(fine)
    levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("fine")))).withColumn("prefix", F.expr("shiftright(at, fine - depth)"))
    sums = levels.groupBy("root", "depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == F.col("fine"))
    leaf = levels.select("root", "path", "fine", "at", "depth", "prefix").join(sums, ["root", "depth", "prefix"]).where(fits)
    leaf = leaf.groupBy("root", "at", "path").agg(F.min_by(F.struct("depth", "prefix", "shard_bytes", "shard_rows", "low", "high"), "depth").alias("leaf"))
    bits = F.when(F.col("leaf.depth") == 0, "").otherwise(F.expr("lpad(conv(leaf.prefix, 10, 2), leaf.depth, '0')"))
    directory = leaf.select("root", "at", F.concat("path", bits).alias("path"), "leaf.*").drop("prefix").withColumn("same", F.expr("low = high")).drop("low", "high")
    return directory, keyed.drop("path", "fine")


def shard(docs: DataFrame, limit: int = SHARD_BYTES, key: Column | None = None, size: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, bytes, shard (its hash bits), depth, shard_bytes, shard_rows.

    After the bits of the first hash, '/' starts those of the second.
    """
    spark = docs.sparkSession
    key = F.col(id_col) if key is None else key
    size = F.coalesce(F.octet_length("text"), F.lit(0)) if size is None else size
    rows = docs.select(F.col(id_col).alias("doc_id"), size.cast("long").alias("bytes"), key60(key).alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = table(rows.withColumn("root", F.lit(0).cast("long")))
    total = rows.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    depth = lambda n: min(HASH_BITS, max(0, math.ceil(math.log2(max(1, n) / limit))) + EXTRA_BITS)
    roots = spark.createDataFrame([(0, "", depth(total))], "root long, path string, fine int")
    done, n_roots = None, 1
    while n_roots:
        directory, keyed = _split(rows, roots, n_roots, limit)
        directory = table(directory)
        n = directory.count()
        over = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
        fits = keyed.join(small(directory.where(~over), n), ["root", "at"])
        fits = fits.select("doc_id", "bytes", F.col("path").alias("shard"), F.length(F.translate("path", "/", "")).alias("depth"), "shard_bytes", "shard_rows")
        done = fits if done is None else done.unionByName(fits)
        # What is too large at the finest level becomes the root of another pass.
        deep = directory.where(over).withColumn("next", F.monotonically_increasing_id())
        deep = table(deep.withColumn("fine", F.least(F.lit(HASH_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("shard_bytes") / limit))) + EXTRA_BITS).cast("int")))
        n_roots = deep.count()
        if n_roots:
            second = key60(F.concat(F.lit("row:"), F.col("row")))
            shifted = F.expr(f"shiftleft(hash - shiftleft(at, {HASH_BITS} - depth), depth)")
            rows = keyed.join(small(deep.select("root", "at", "next", "same", "depth"), n_roots), ["root", "at"])
            rows = table(rows.select("doc_id", "bytes", F.when(F.col("same"), second).otherwise(shifted).alias("hash"), "row", F.col("next").alias("root")))
            roots = deep.select(F.col("next").alias("root"), F.concat("path", F.when(F.col("same"), "/").otherwise("")).alias("path"), "fine")
    return done


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` with one folder per shard below ``path`` and return the shard of each row."""
    rows, row = numbered(docs)
    placed = shard(rows.select(F.struct(F.col(row).alias("row"), F.col(id_col).alias("id")).alias("doc_id"), F.col(text_col).alias("text")), limit, key=F.col("doc_id.id"))
    placed = table(placed.select(F.col("doc_id.row").alias(row), F.col("doc_id.id").alias("doc_id"), "shard"))
    name = fresh(rows, "shard")
    folder = F.concat(F.lit("s"), F.translate("shard", "/", "-")).alias(name)
    out = rows.join(placed.select(row, folder), row).drop(row)
    out.repartition(name).write.partitionBy(name).parquet(path)
    return placed.select("doc_id", "shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: A limit at which small tables split often.
SMALL_SHARD_BYTES = 64 << 10


def sharding_small_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same directory with a small limit, so that it is deep on a small table as well."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), SMALL_SHARD_BYTES)


def sharding_sql(limit: int) -> str:
    """The shard of each document over all bits of the hash; identifiers that differ need no second one."""
    return f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS hash FROM documents),
l AS (SELECT d.*, CAST(r.range AS INT) AS depth, hash >> CAST({HASH_BITS} - r.range AS INT) AS prefix FROM d, range(0, {HASH_BITS + 1}) r),
s AS (SELECT depth, prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_rows FROM l GROUP BY ALL),
f AS (SELECT doc_id, bytes, l.depth, prefix, shard_bytes, shard_rows,
             row_number() OVER (PARTITION BY doc_id ORDER BY l.depth) AS n
      FROM l JOIN s USING (depth, prefix) WHERE shard_bytes <= {limit} OR shard_rows = 1)
SELECT doc_id, bytes, CASE depth WHEN 0 THEN '' ELSE right(bin(prefix + (1::BIGINT << 61)), depth) END AS shard,
       depth, shard_bytes, shard_rows
FROM f WHERE n = 1
"""


OP1_SQL, SMALL_LIMIT_SQL = sharding_sql(SHARD_BYTES), sharding_sql(SMALL_SHARD_BYTES)
