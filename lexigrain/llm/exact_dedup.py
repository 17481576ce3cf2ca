"""Exact duplicates by a log-structured merge index of digests (DataFrame functions only).

* Memtable and flush: each scan task sorts its digests and flushes them as Parquet runs of MEMTABLE rows at most;
  the run's row groups carry minimum, maximum and a Bloom filter of the digest, which point lookups consult.
* Levels: FANOUT runs of a level are merged into one of the next, so that an index that grows batch by batch
  rewrites a row once per level.
* Compaction: all runs are merged by digest, keeping the smallest identifier and the number of rows.  Counts are
  summed before the shuffle, so a text that fills a third of the corpus is one row per task there.
* Byte verification: rows whose digest is shared are compared, byte by byte, with the row that stays.  A bitmap
  of the shared digests, of bounded size, keeps the texts of all other rows out of that shuffle.

Defined cases: a null text equals the empty one; null identifiers come after all others; of repeated rows with
one identifier exactly one stays; an empty table gives an empty result.  Digests that collide are regrouped by
the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, drop, numbered, scratch, table

#: Rows in a run at most, as a memtable holds them, and runs of a level that are merged into one of the next.
MEMTABLE, FANOUT = 1 << 22, 10
#: Bits of the shared-digest bitmap at most (16 MB, broadcast): beyond it only more texts are compared.
FILTER_BITS = 1 << 27
PAGE_BITS = 1 << 15

Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class LsmIndex:
    """Sorted digest runs below one folder, by level; flush any number of batches, then compact.

    A run's rows are (digest, doc_id, seq, n): a digest, the smallest identifier with it, that row's sequence number,
    and the rows it stands for, which is one in a flushed run.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, digest: Digest = sha256) -> None:
        self.spark, self.path, self.digest, self.flushed = spark, path or scratch(spark), digest, 0
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        filters = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": "262144"}
        return table(rows.sortWithinPartitions("digest"), f"{self.path}/{name}", **filters, maxRecordsPerFile=str(MEMTABLE))

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _add(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == FANOUT:
            merged = f"level={level + 1}/after={self.flushed}"
            self._write(_merged(self._rows(self.levels[level])), merged)
            self.levels[level] = []
            self._add(level + 1, merged)

    def _rows(self, names: list[str]) -> DataFrame:
        return reduce(DataFrame.union, (self._run(n) for n in names))

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Flush sorted runs, one or more per scan task; rows get sequence numbers that no other row of the index has."""
        seq = F.monotonically_increasing_id() + F.lit(self.flushed << 53)
        rows = docs.select(self.digest(normalised(F.col(text_col))).alias("digest"), F.col(id_col).alias("doc_id"), seq.alias("seq"), F.lit(1).cast("long").alias("n"))
        self.flushed += 1
        name = f"level=0/run={self.flushed}"
        rows = self._write(rows, name)
        self._add(0, name)
        return rows

    def runs(self) -> DataFrame:
        """The rows of all runs that no merge has taken in."""
        return self._rows([n for level in self.levels for n in level])

    def compact(self) -> DataFrame:
        """Merge all runs into one of distinct digests, sorted in every file: digest, keep_id, keep_seq, group_size."""
        merged = _merged(self.runs()).select("digest", F.col("doc_id").alias("keep_id"), F.col("seq").alias("keep_seq"), F.col("n").alias("group_size"))
        return self._write(merged, f"compacted={self.flushed}")

    def lookup(self, digest_hex: str) -> DataFrame:
        """Rows of one digest, found through run minima, maxima and filters."""
        return self.runs().where(F.col("digest") == F.unhex(F.lit(digest_hex)))


def _merged(rows: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_n"), "doc_id", "seq"))
    merged = rows.groupBy("digest").agg(first.alias("first"), F.sum("n").alias("n"))
    return merged.select("digest", F.col("first.doc_id").alias("doc_id"), F.col("first.seq").alias("seq"), "n")


def _bitmap(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Pages (page, bits) of a bitmap over ``keys.digest``: about 16 bits a key, FILTER_BITS at most."""
    bits = max(PAGE_BITS, min(FILTER_BITS, 1 << (16 * max(n, 1) - 1).bit_length()))
    at = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
    pages = keys.select(F.bitmap_bucket_number(at).alias("page"), F.bitmap_bit_position(at).alias("bit"))
    return pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")), bits


def _maybe_shared(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    pages, bits = _bitmap(keys, n)
    at = F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("long")
    probed = docs.withColumns({"page": F.bitmap_bucket_number(at), "_bit": bit}).join(F.broadcast(pages), "page")
    return probed.where(F.bit_get(byte, (F.col("_bit") % 8).cast("int")) == 1).drop("page", "_bit", "bits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest (binary)."""
    spark = docs.sparkSession
    index = LsmIndex(spark, digest=digest)
    runs = index.flush(docs, id_col, text_col)
    compacted = index.compact()
    shared = compacted.where("group_size > 1")
    n = shared.count()
    whole = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    whole = whole.withColumn("digest", digest(F.col("norm")))
    collided = None
    if n:
        hits = table(_maybe_shared(whole, shared, n).join(shared.select("digest", "keep_id"), "digest"), f"{index.path}/hits", compression="zstd")
        # Written, so that the join below is of two plain shuffles, whose large groups Spark can split.
        stays = table(hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("norm").alias("stays")), f"{index.path}/stays", compression="zstd")
        differ = hits.join(stays, "digest").where(F.col("norm") != F.col("stays"))
        collided = table(differ.select("digest"), f"{index.path}/collided")  # none as a rule; a distinct() would bind the join to one task per digest
        for spent in ("hits", "stays"):
            drop(spark, f"{index.path}/{spent}")
    found = runs.join(compacted, "digest")
    columns = ["doc_id", "keep_id", "group_size", (F.col("seq") == F.col("keep_seq")).alias("kept"), "digest"]
    if collided is None or collided.isEmpty():
        return found.select(*columns)
    # Different texts share a digest: their rows are grouped by the text, in runs of their own.
    again = whole.join(collided, "digest", "left_semi").withColumn("seq", F.monotonically_increasing_id())
    again = table(again, f"{index.path}/regrouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_n"), "doc_id", "seq"))
    groups = again.groupBy("digest", "norm").agg(first.alias("first"), F.count("*").alias("group_size"))
    exact = again.join(groups.select("digest", "norm", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.seq").alias("keep_seq")), ["digest", "norm"])
    return found.join(collided, "digest", "left_anti").select(*columns).unionByName(exact.select(*columns))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, row = numbered(docs)
    kept = exact_dedup(rows.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("doc_id"), F.col(text_col).alias("text")))
    kept = kept.where("kept").select(F.col("doc_id.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)
