"""Best-fit packing of token sequences by a configuration linear program.

Texts are tokenised where they lie and only (length, checksum) rows go on.  The driver sees the histogram of piece
lengths, which has as many entries as the capacity at most:

* Configurations (multisets of lengths that fit) are variables of the covering LP "fewest sequences that hold all
  pieces".  Multiplicative weights solve it: weights of lengths price pieces, a knapsack dynamic program finds the
  best configuration at these prices, and the weights of what it covers shrink.  Lengths are exact at any input size.
* Rounding: configurations are used as often as their whole parts say and pieces last.  What remains is filled up
  by the same kind of dynamic program: the longest piece left, and the pieces that fill its sequence best.

The plan is a table of (length, first rank, copies, sequence, offset).  Every recipe but the program's uses some
length up, so there are about as many as the capacity, of some 90 different lengths each, whatever the table's size:
a few MB that go along with the tasks.  Executors number the pieces of a length
with two-level counts, a length that holds a third of all pieces included, and look their place up.

Defined cases: a null or empty text is the end id alone; longer texts are cut at the capacity; ties and repeated
rows are pieces of their own; a null identifier stays null; an empty table has no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, table
from .tokens import encoder, slices, texts_of, tokenizer_path

CAPACITY = 4096
ROUNDS = 600
RATE = 0.5

Recipe = tuple[tuple[int, int], ...]


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of the most value: index of a size -> copies.  Sizes ascend.

    A size at no higher price than a smaller one can always give way to it, so the program leaves it out.
    """
    kept = np.flatnonzero(prices > np.concatenate([[0.0], np.maximum.accumulate(prices)[:-1]]))
    sizes, prices = sizes[kept], prices[kept]
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fit[c]:
            value = best[c - sizes[:k]] + prices[:k]
            j = int(value.argmax())
            if value[j] > best[c]:
                best[c], last[c] = value[j], j
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if (j := int(last[c])) < 0:
            c -= 1
        else:
            out[int(kept[j])] = out.get(int(kept[j]), 0) + 1
            c -= int(sizes[j])
    return out


def configuration_lp(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> dict[tuple, float]:
    """A nearly optimal fractional cover: configuration ((index, copies), ...) -> number of sequences."""
    weights, cover, chosen = np.ones(len(sizes)), np.zeros(len(sizes)), {}
    for _ in range(rounds):
        config = {j: min(k, int(counts[j])) for j, k in knapsack(sizes, weights / counts, capacity).items()}
        at, copies = np.array(list(config)), np.array(list(config.values()))
        step = float((counts[at] / copies).min())
        gain = step * copies / counts[at]
        cover[at] += gain
        weights[at] *= np.exp(-rate * gain)
        weights /= weights.max()
        key = tuple(sorted(config.items()))
        chosen[key] = chosen.get(key, 0.0) + step
    scale = max(float(np.average(cover, weights=sizes * counts)), 1e-9)
    return {k: x / scale for k, x in chosen.items()}


def best_fill(left: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The pieces, of ``left[size]`` each, that fill ``room`` best; of equal fills one of long pieces."""
    reach, steps = 1, []
    mask = (1 << room + 1) - 1
    for size in np.flatnonzero(left[1 : room + 1])[::-1].tolist():
        size += 1
        steps.append((size, most := min(int(left[size]), room // size), reach))
        take = 1
        while most:
            take = min(take, most)
            reach |= reach << size * take & mask
            most -= take
            take *= 2
        if reach >> room:
            break
    out, at = [], reach.bit_length() - 1
    for size, _, before in reversed(steps):
        k = 0
        while not before >> at - k * size & 1:
            k += 1
        if k:
            out.append((size, k))
            at -= k * size
    return out[::-1]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[Recipe, int]]:
    """Recipes and how many sequences follow each; together they hold the histogram exactly.

    The program's whole parts come first; the pieces that they leave are filled up one kind of sequence at a time.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        left[size] = n
    out: list[tuple[Recipe, int]] = []

    def take(recipe: Recipe, times: int) -> None:
        for size, k in recipe:
            left[size] -= k * times

    def complete(recipe: Recipe, times: int) -> None:
        """Sequences that hold ``recipe``, whose pieces are taken, filled up with what is left."""
        while times:
            more = best_fill(left, capacity - sum(size * k for size, k in recipe))
            n = min([times, *(int(left[size]) // k for size, k in more)])
            take(more, n)
            out.append((tuple(sorted((Counter(dict(recipe)) + Counter(dict(more))).items(), reverse=True)), n))
            times -= n

    sizes = np.flatnonzero(left)
    whole: list[tuple[Recipe, int]] = []
    if len(sizes):
        program = configuration_lp(sizes, left[sizes].astype(float), capacity, rounds)
        for config, x in sorted(program.items(), key=lambda c: (-c[1], c[0])):
            recipe = tuple((int(sizes[j]), k) for j, k in reversed(config))
            if times := min(int(x), *(int(left[size]) // k for size, k in recipe)):
                take(recipe, times)
                whole.append((recipe, times))
    for recipe, times in whole:
        complete(recipe, times)
    while len(sizes := np.flatnonzero(left)):
        longest = ((int(sizes[-1]), 1),)
        take(longest, 1)
        more = best_fill(left, capacity - longest[0][0])
        take(longest, -1)
        recipe = tuple(sorted((Counter(dict(longest)) + Counter(dict(more))).items(), reverse=True))
        n = min(int(left[size]) // k for size, k in recipe)
        take(recipe, n)
        out.append((recipe, n))
    return out


def places(recipes: list[tuple[Recipe, int]]) -> dict[str, np.ndarray]:
    """Rows by length and first rank: pieces of that length ranked from there on are placed by the row."""
    rows, sequence, ranks = [], 0, {}
    for recipe, bins in recipes:
        offset = 0
        for size, copies in recipe:
            first = ranks.get(size, 0)
            rows.append((size, first, copies, sequence, offset))
            ranks[size] = first + copies * bins
            offset += size * copies
        sequence += bins
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "copies", "sequence", "offset"), cols, strict=True))


def _measure(path: str, drops_space: bool, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, drops_space).encode, np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for doc, row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encode(texts_of(batch)), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((doc, row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return run


def _place(where: dict[str, np.ndarray]):
    keys = (where["length"] << 44) | where["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            n, copies = rank - where["first"][at], where["copies"][at]
            sequence = where["sequence"][at] + n // copies
            offset = where["offset"][at] + n % copies * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, drops_space: bool = True, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    pieces = table(rows.mapInArrow(_measure(tokenizer, drops_space, end_id, capacity), "doc_id long, row long, piece int, start long, length long, ids_crc32 long"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # as many rows as the capacity at most
    where = places(plan(histogram, capacity))
    buckets = max(1, math.isqrt(sum(histogram.values())))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(buckets)))
    sums = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    n_sums = min(buckets * len(histogram), sum(histogram.values()))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "row", "piece")
    numbered = pieces.join(small(sums, n_sums), ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return numbered.mapInArrow(_place(where), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
