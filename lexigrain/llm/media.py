"""Texts as lossless WebP images in a binary column, and pixel arrays and features read back from it.

A payload is the text's UTF-8 bytes, filled with spaces to whole rows of ROW samples.  It is cut into tiles of at
most TILE_ROWS rows, each a WebP file with the byte values as its palette; a media value is its tiles, one after
the other (every file names its own length).  Tiles keep images of all texts at about one size, so many decode in
step and a very long text takes no more memory than many short ones.

Defined cases: a null text is empty; an empty text is one row of spaces; equal texts have equal media; repeated
rows stay; an empty table gives no rows; bytes that aren't lossless WebP raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import slices, texts_of, tidy
from .webp import decode_many, encode_many

ROW, TILE_ROWS = 192, 64
#: Tiles that are written, or read, together at most.
TILES = 4096
#: Bytes of text, and of media, that a worker handles at once.
TEXT_BYTES, MEDIA_BYTES = 3 << 20, 3 << 20


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b" ")


def to_media(texts: list[str]) -> list[bytes]:
    tiles, counts = [], []
    for text in texts:
        samples = np.frombuffer(payload_of(text), np.uint8)
        cuts = range(0, len(samples), ROW * TILE_ROWS)
        tiles += [samples[a : a + ROW * TILE_ROWS] for a in cuts]
        counts.append(len(cuts))
    files = [f for at in range(0, len(tiles), TILES) for f in encode_many(tiles[at : at + TILES], ROW)]
    ends = np.cumsum(counts).tolist()
    return [b"".join(files[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def files_of(media: bytes) -> list[bytes]:
    """The WebP files of a media value."""
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] != b"RIFF" or at + n > len(media):
            raise ValueError("not a row of WebP files")
        out.append(media[at : at + n])
        at += n
    return out


def from_media(media: list[bytes]) -> list[bytes]:
    """The payloads of media values: the green samples of their pixel arrays."""
    files = [files_of(m) for m in media]
    every = [f for own in files for f in own]
    samples = ((p >> 8 & 255).astype(np.uint8).tobytes() for at in range(0, len(every), TILES) for p in decode_many(every[at : at + TILES]))
    return [b"".join(next(samples) for _ in own) for own in files]


def feature(payload: bytes) -> str:
    """Size, mean, deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = len(payload), np.arange(256)
    mean = float(counts @ values) / n
    spread = max(0.0, float(counts @ values**2) / n - mean**2) ** 0.5
    share = counts[counts > 0] / n
    return f"{ROW}x{n // ROW} mean={mean:.4f} deviation={spread:.4f} entropy={abs(-float(share @ np.log2(share))):.4f}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", TEXT_BYTES):
            texts = texts_of(batch)
            n = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(to_media(texts), pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "media", MEDIA_BYTES):
            media = batch.column(2).to_pylist()
            rows = []
            for m, p in zip(media, from_media(media), strict=True):
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media of every row, written to a table."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return table(rows.mapInArrow(tidy(_store), f"doc_id {kind}, n_bytes long, media binary"))


def media_features(media: DataFrame) -> DataFrame:
    """Payload, media and features of every media value, from its stored bytes."""
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(_read), schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(media_column(spark.read.parquet(f"{sf_dir}/documents.parquet")))
