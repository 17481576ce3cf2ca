"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are shares of character classes, lengths and repetition, of the line
itself and of its two neighbours.  The model is fitted by maximum conditional likelihood on TRAIN_DOCS labelled
documents and TRAIN_BYTES of text at most, whose lines carry their document's label.  A document's score is the average of its lines'
forward-backward marginals of "good", weighted by line length.

Only rows whose crc32(identifier as text) mod 3 is not 1 are learnt from; labels, language, source and identifier
are no inputs of a score.

Defined cases: of several texts with one identifier the one with the smallest hash is learnt from; a document with
contradicting labels counts as bad; a null or blank text scores the share of good documents in the sample, 0.5 without a sample;
repeated rows score alike; documents of any number of lines are scored whole; an empty table gives no scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load
from .tokens import forget, slices, tidy
from .wordhash import U64, Words, mix

#: Labelled documents that are learnt from, and bytes of their texts that the driver reads, at most.
TRAIN_DOCS, TRAIN_BYTES = 4000, 64 << 20
STEPS, RATE, PENALTY = 150, 0.1, 1e-4

_LETTER, _UPPER, _DIGIT, _SPACE, _SOFT, _SYMBOL, _WIDE = range(7)
_CLASS = np.full(256, _SYMBOL, np.uint8)
for _kind, _chars in ((_LETTER, range(0x61, 0x7B)), (_UPPER, range(0x41, 0x5B)), (_DIGIT, range(0x30, 0x3A)), (_SPACE, (0x20, *range(0x09, 0x0E))), (_SOFT, b".,;:'\"-?()"), (_WIDE, range(0x80, 0x100))):
    _CLASS[list(_chars)] = _kind
OWN = 11


@dataclass
class Lines:
    """Lines of a batch in order: features with neighbours, bytes, and the first line of each document."""

    features: np.ndarray
    size: np.ndarray
    first: np.ndarray


def line_features(column: pa.Array) -> Lines:
    words = Words(column)
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 0x0A) + 1
    begin = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks[~np.isin(breaks, offsets)])
    end = np.append(begin[1:], len(data)) if len(begin) else begin
    first = np.searchsorted(begin, offsets)
    size = (end - begin).astype(float)
    own = np.zeros((len(begin), OWN))
    own[:, 0] = 1
    kinds = _CLASS[data]
    for j, kind in enumerate((_UPPER, _DIGIT, _SPACE, _SOFT, _SYMBOL, _WIDE), 1):
        sums = np.concatenate([[0], np.cumsum(kinds == kind, dtype=np.int64)])
        own[:, j] = (sums[end] - sums[begin]) / np.maximum(size, 1)
    at = np.searchsorted(words.start, np.append(begin, len(data)))
    n = np.diff(at)
    again = np.zeros(len(words.hash) + 1, np.int64)
    if len(words.hash) > 1:
        same = words.hash[1:] == words.hash[:-1]
        borders = words.first[(words.first > 0) & (words.first < len(words.hash))]
        same[borders - 1] = False
        again[2:] = np.cumsum(same)
    own[:, 7] = (again[at[1:]] - again[at[:-1]]) / np.maximum(n, 1)
    own[:, 8] = np.log1p(size) / 8
    own[:, 9] = np.minimum(size / np.maximum(n, 1) / 10, 5)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(words.hash, dtype=U64)])
    line = mix(sums[at[1:]] - sums[at[:-1]])
    inner = np.zeros(len(begin), bool)
    inner[1:] = True
    inner[first[:-1][first[:-1] < len(begin)]] = False
    own[1:, 10] = (line[1:] == line[:-1]) & inner[1:] & (n[1:] > 0)
    features = np.zeros((len(begin), 3 * OWN))
    features[:, :OWN] = own
    features[1:, OWN : 2 * OWN] = own[:-1] * inner[1:, None]
    features[:-1, 2 * OWN :] = own[1:] * inner[1:, None]
    return Lines(features, size, first)


@dataclass
class Model:
    """weights of the features for "good" against "bad"; log potentials of [before, after]; the mean label."""

    weights: np.ndarray
    moves: np.ndarray
    prior: float


def marginals(odds: np.ndarray, first: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected moves summed over all documents.

    Documents go forward and backward in step; those that have ended leave the active front.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, n = first[:-1][order], n[order]
    active = np.searchsorted(-n, -np.arange(1, int(n.max(initial=0)) + 1), "right")  # documents with over t lines
    emit = np.stack([np.ones_like(odds), np.exp(np.clip(odds, -30, 30))], 1)
    emit /= emit.sum(1, keepdims=True)
    move = np.exp(moves)
    ahead, behind = np.zeros_like(emit), np.ones_like(emit)
    for t, k in enumerate(active):
        at = start[:k] + t
        a = emit[at] if t == 0 else (ahead[at - 1] @ move) * emit[at]
        ahead[at] = a / a.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = start[: active[t]] + t
        b = (emit[at] * behind[at]) @ move.T
        pair = ahead[at - 1][:, :, None] * move * (emit[at] * behind[at])[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        behind[at - 1] = b / b.sum(1, keepdims=True)
    both = ahead * behind
    return both[:, 1] / both.sum(1), expected


def fit(lines: Lines, good: np.ndarray, steps: int = STEPS, rate: float = RATE) -> Model:
    """Maximum conditional likelihood by full-batch Adam on scaled features."""
    scale = np.maximum(lines.features.std(0), 1e-3)
    scale[0] = 1
    x, first = lines.features / scale, lines.first
    n = np.diff(first)
    y = np.repeat(good.astype(float), n)
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    kept = np.zeros((2, 2))
    for label in (0, 1):
        kept[label, label] = np.maximum(n[good == label] - 1, 0).sum()
    for t in range(1, steps + 1):
        p, moved = marginals(x @ theta[:-4], first, theta[-4:].reshape(2, 2))
        slope = np.concatenate([x.T @ (y - p), (kept - moved).ravel()]) / max(len(y), 1) - PENALTY * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:-4] / scale, theta[-4:].reshape(2, 2), float(good.mean()) if len(good) else 0.5)


def score(model: Model, column: pa.Array) -> np.ndarray:
    lines = line_features(column)
    p, _ = marginals(lines.features @ model.weights, lines.first, model.moves)
    weight = np.concatenate([[0.0], np.cumsum(lines.size)])
    total = np.diff(weight[lines.first])
    mass = np.diff(np.concatenate([[0.0], np.cumsum(p * lines.size)])[lines.first])
    blank = np.diff(Words(column).first) == 0
    return np.where(blank | (total <= 0), model.prior, np.clip(mass / np.maximum(total, 1), 0, 1))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score(model, batch.column(batch.num_columns - 1)))], names=[*batch.schema.names[:-1], "score"])

    return run


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the ``most`` labelled documents with the smallest hash, of those that aren't held out, in that order up
    to TRAIN_BYTES of text."""
    chosen = labels.where(~held_out(F.col(id_col)) & F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("_good"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_good", "text")
    once = sample.groupBy("_id", "_good").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    so_far = F.sum(size).over(Window.orderBy(F.xxhash64("_id"), "_id"))  # over TRAIN_DOCS rows at most
    sample = once.withColumn("_bytes", so_far).where(F.col("_bytes") <= TRAIN_BYTES).drop("_bytes").orderBy("_id").toArrow()
    if not sample.num_rows:
        return Model(np.zeros(3 * OWN), np.zeros((2, 2)), 0.5)
    parts = [line_features(part.column("text")) for batch in sample.select(["text"]).to_batches() for part in slices(batch, "text")]
    ends = np.cumsum([0, *(len(p.size) for p in parts)])
    first = np.concatenate([p.first[:-1] + at for p, at in zip(parts, ends.tolist(), strict=False)] + [ends[-1:]])
    lines = Lines(np.concatenate([p.features for p in parts]), np.concatenate([p.size for p in parts]), first)
    return fit(lines, np.asarray(sample.column("_good")).astype(int))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(_scored(model)), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def good_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    model = train(docs, labels)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for batch in slices(whole, text_col):
                yield batch.filter(pa.array(score(model, batch.column(batch.schema.get_field_index(text_col))) >= 0.5))

    return docs.mapInArrow(tidy(keep), docs.schema).select(*names)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
