"""Token ids in files: frequency-ranked ids in byte-aligned variable-length coding, control bytes kept apart.

Every id is replaced by its rank in the corpus' frequency order, so common ids take one byte; tasks count the ids
that they make, over all documents.  A control byte holds the byte counts of four ranks; decoding looks the 256
control bytes up in a table, gathers the bytes of all ranks of a block at once with numpy, and looks the ids up by
rank.

Format: a table of blocks in ascending document order (a folder of Parquet files, so any store that Spark reaches
can hold it) beside a table of ranks.  A block is
    magic "LGV1", documents n (u32), then n lengths in ids (u32), the control bytes, and the data bytes,
all little-endian.  Each document starts a new control byte.

Defined cases: a null text is empty; an empty text is the end id alone; null identifiers come last; rows that
share an identifier stay in scan order; an empty table gives no blocks and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, scratch, small, table
from .tokens import encoder, slices, texts_of, tokenizer_path

MAGIC = b"LGV1"
BLOCK_IDS = 1 << 18
#: Words that a worker remembers here; more than elsewhere, as spaces make words differ.
CACHE_WORDS = 800_000
#: Bytes of text that a worker handles at once; more than elsewhere, as each different word in them is looked up once.
SLICE_BYTES = 1 << 23
#: Ids in a range of documents, which one task sorts and writes block by block, and ranges at most; from then on they
#: grow.  Borders are places in the order of documents, as a sample of SAMPLE documents a range has them.
RANGE_IDS, MAX_RANGES, SAMPLE = 8_000_000, 1 << 14, 64
#: Places in that order: null identifiers last, and rows of one identifier in scan order.
_PLACE = np.dtype([("none", "i1"), ("doc_id", "<i8"), ("row", "<i8")])
#: Bytes of the four ranks that a control byte describes.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def _padding(sizes: np.ndarray) -> np.ndarray:
    """Which of the fours of codes only fill a document's last control byte."""
    ends = np.cumsum(-(-sizes // 4)) * 4
    pad = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    for k in (1, 2, 3):
        pad[ends[sizes % 4 == 4 - k] - np.arange(1, k + 1)[:, None]] = True
    return pad


def encode_ranks(ranks: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The control bytes and the data bytes of each document; sizes are its numbers of ranks, at least one each."""
    width = 2 if not len(ranks) or int(ranks.max()) < 1 << 16 else 4
    ranks = ranks.astype(f"<u{width}")
    extra = (ranks > 0xFF).astype(np.uint8)
    if width > 2:
        extra += (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF)
    lens = extra + np.uint8(1)
    bytes_of = -(-sizes // 4)
    first = np.cumsum(bytes_of) - bytes_of
    codes = np.zeros(int(bytes_of.sum()) * 4, np.uint8)
    codes[~_padding(sizes)] = extra
    control = (codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6).tobytes()
    data = ranks.view(np.uint8).reshape(-1, width)[np.arange(width) < lens[:, None]].tobytes()
    ends = np.cumsum(lens, dtype=np.int64)[np.cumsum(sizes) - 1]
    controls = [control[a : a + n] for a, n in zip(first.tolist(), bytes_of.tolist(), strict=True)]
    return controls, [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def pack_block(sizes: list[int], controls: list[bytes], datas: list[bytes]) -> bytes:
    return b"".join([MAGIC, np.uint32(len(sizes)).astype("<u4").tobytes(), np.array(sizes, "<u4").tobytes(), *controls, *datas])


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The documents' sizes and all their ranks."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n = int(np.frombuffer(block, "<u4", 1, 4)[0])
    sizes = np.frombuffer(block, "<u4", n, 8).astype(np.int64)
    bytes_of = -(-sizes // 4)
    begin = 8 + 4 * n
    control = np.frombuffer(block, np.uint8, int(bytes_of.sum()), begin)
    data = np.frombuffer(block, np.uint8, offset=begin + len(control))
    lens = LENGTHS[control].ravel()[~_padding(sizes)]
    start = np.cumsum(lens, dtype=np.int64) - lens
    if int(lens.sum()) != len(data):
        raise ValueError("a block of token ids is cut short")
    ranks = data[start].astype(np.uint32)
    data = np.append(data, np.zeros(3, np.uint8))
    for k in range(1, int(lens.max(initial=1))):
        ranks |= np.where(lens > k, data[start + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return sizes, ranks


_RAW = ["doc_id", "row", "n_tokens", "ids", "counts"]


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive values, so many a row, as a binary column."""
    ends = np.append(0, np.cumsum(sizes) * values.itemsize)
    if ends[-1] >= 1 << 31:
        raise ValueError("a text has too many ids for a binary value")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def _tokenise(path: str, drops_space: bool, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = encoder(path, drops_space, CACHE_WORDS).encode_flat, np.zeros(0, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, n = encode(texts_of(batch), [end_id])
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), _binaries(ids, n), pa.nulls(len(n), pa.binary())], names=_RAW)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=_RAW)

    return run


def _wide(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tasks to rows of an id and its count."""
    for batch in batches:
        for counts in batch.column(0).to_pylist():
            total = np.frombuffer(counts, "<i8")
            have = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(have, pa.int64()), pa.array(total[have])], names=["id", "n"])


def _places(doc_id: pa.Array, row: pa.Array) -> np.ndarray:
    out = np.zeros(len(doc_id), _PLACE)
    out["none"], out["doc_id"], out["row"] = pc.is_null(doc_id), pc.fill_null(doc_id, 0), row
    return out


def _borders(rows: DataFrame, ranges: int) -> np.ndarray:
    """Where ranges of about as many documents begin; any borders give the same files' order.

    The driver sees SAMPLE places for each of MAX_RANGES ranges at most.
    """
    n = rows.count()
    if ranges < 2 or not n:
        return np.zeros(0, _PLACE)
    share = min(1.0, SAMPLE * ranges / n)
    sample = rows.where(F.pmod(F.xxhash64("row", "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "row").toArrow()
    places = np.sort(_places(sample.column(0).combine_chunks(), sample.column(1).combine_chunks())) if sample.num_rows else np.zeros(0, _PLACE)
    return np.unique(places[np.arange(1, ranges) * len(places) // ranges]) if len(places) else places


def _encode(rank_of: np.ndarray, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids"):
                n = batch.column(2).to_pylist()
                ids = [_wide(b, k) for b, k in zip(batch.column(3).to_pylist(), n, strict=True)]
                controls, datas = encode_ranks(rank_of[np.concatenate(ids)], np.array(n, np.int64))
                part = np.searchsorted(bounds, _places(batch.column(0), batch.column(1)), "right")
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0), *batch.columns[1:3], pa.array(controls, pa.binary()), pa.array(datas, pa.binary())], names=["part", "doc_id", "row", "n_tokens", "control", "data"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents to blocks; a block ends at BLOCK_IDS or where the range does."""
    docs: list[tuple] = []
    number, held = 0, 0

    def block() -> pa.RecordBatch:
        part, ids, _, n, controls, datas = map(list, zip(*docs, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([part[0]], pa.int32()), pa.array([number], pa.int64()), pa.array([sum(n)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack_block(n, controls, datas)], pa.binary())], names=["part", "block", "n_ids", "doc_ids", "content"])

    for batch in batches:
        for doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if docs and (doc[0] != docs[0][0] or held >= BLOCK_IDS):
                yield block()
                number, docs, held = number + 1, [], 0
            docs.append(doc)
            held += doc[3]
    if docs:
        yield block()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, drops_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``path``/ranks (rank, id) and ``path``/blocks (part, block, n_ids, doc_ids, content)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    raw_path = scratch(spark)
    raw = table(rows.mapInArrow(_tokenise(tokenizer, drops_space, end_id), "doc_id long, row long, n_tokens long, ids binary, counts binary"), raw_path, compression="zstd")
    counted = raw.where("counts IS NOT NULL").select("counts").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted = counted.toPandas()  # as many rows as the vocabulary has at most
    counted = counted.sort_values(["n", "id"], ascending=[False, True])
    id_of = counted["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    spark.createDataFrame(list(enumerate(id_of.tolist())), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    raw = raw.where("counts IS NULL").drop("counts")
    bounds = _borders(raw, min(MAX_RANGES, -(-int(counted["n"].sum()) // RANGE_IDS)))
    coded = raw.mapInArrow(_encode(rank_of, bounds), "part int, doc_id long, row long, n_tokens long, control binary, data binary")
    ordered = coded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "row")
    blocks = ordered.mapInArrow(_blocks, "part int, block long, n_ids long, doc_ids array<long>, content binary")
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    drop(spark, raw_path)


def _decode(id_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, ranks = unpack_block(content)
                ids = id_of[ranks].tobytes()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + first), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    ranks = spark.read.parquet(f"{path}/ranks").toPandas()  # the vocabulary
    id_of = ranks.sort_values("rank")["id"].to_numpy("<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("blocks"))
    sums = ranked_sums(sums)
    n = sums.agg(F.sum("blocks")).first()[0] or 0
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("within"))
    first = first.join(F.broadcast(sums.select("part", "before")), "part")  # a row per range
    first = first.select("part", "block", (F.col("before") + F.col("within")).alias("first"))
    placed = blocks.select("part", "block", "doc_ids", "content").join(small(first, n), ["part", "block"])
    return placed.select("first", "doc_ids", "content").mapInArrow(_decode(id_of), "doc_id long, start long, n_tokens long, ids_crc32 long")


def ranked_sums(sums: DataFrame) -> DataFrame:
    """Ids before each range; there are as many rows as files' ranges, MAX_RANGES + 1 at most, so they go in one task."""
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.withColumn("before", F.coalesce(before, F.lit(0)))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, path)
