"""Long repeated passages by recompression of word sequences.

Words get names (hashes of their bytes), and so does every symbol made of them, so that equal stretches have equal
symbols everywhere, without a dictionary.

* Naming rounds: in round r a bit of its name puts each symbol on the left or the right, and every left-right pair
  of neighbours becomes one symbol, named by the two.  ROUNDS rounds make symbols as long as WINDOW words hold for
  certain: a pair depends on its two symbols alone, so all that is inside a window is named alike in every text, but
  for the symbols at its ends that might pair with a neighbour outside.  Runs of one word never pair; a window that
  is a run, or holds no pair for certain, is a symbol of its own.
* Sharing round (Spark): every window is represented by the longest symbol, of the highest round, that is inside it
  for certain.  Symbols that two documents have reveal where windows can repeat.
* Verifying round (Spark): stretches of windows around a shared symbol meet by it, with 64-bit names of the windows
  and 16-bit codes of all their words.  Windows whose names and words agree, one by one, are equal (80 bits tell those
  apart that differ in a single word); the one in the smallest document stays, all others are covered.

Both Spark rounds combine within a task first: of documents that meet there, two stand for a symbol and one for a
window, so a passage in a third of all documents comes to its range once per flush.  Windows around one of the
HOT_LIST most frequent symbols go by their own names, so that a common phrase among ever different words is spread.
A range drops covered windows while it reads, so it holds different windows only.

Defined cases: a null text has no words; a document of under 13 words loses none; null identifiers come after all
others; rows that share an identifier don't cover each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import forget, slices, texts_of, tidy
from .wordhash import SECOND_FACTOR, U64, WORD_FACTOR, Words, mix, sequence_hashes

WINDOW, ROUNDS = 13, 4
#: Symbols, or windows, that a task combines before it hands them on.
FLUSH = 1 << 18
#: Symbols in a range, about; windows that a range holds before it drops the covered ones.
RANGE, HELD = 1 << 20, 1 << 20
#: Entries in a range from which on a symbol is hot, and hot symbols that are told apart at most (512 KB).
HOT, HOT_LIST = 1 << 10, 1 << 16
#: Windows in a stretch at most.
STRETCH = 128
LAST = np.iinfo(np.int64).max


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin, of sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def naming_round(symbol: np.ndarray, size: np.ndarray, text: np.ndarray, r: int) -> tuple[np.ndarray, ...]:
    """Symbols, their words and texts after round ``r``; which were on the left; and where each one went."""
    left = (mix(symbol ^ U64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)) >> U64(17) & U64(1)).astype(bool)
    pair = np.zeros(len(symbol), bool)
    pair[:-1] = left[:-1] & ~left[1:] & (text[:-1] == text[1:])
    stays = np.ones(len(symbol), bool)
    stays[1:] = ~pair[:-1]
    kept = np.flatnonzero(stays)
    paired = pair[kept]
    first = kept[paired]
    out, length = symbol[kept], size[kept]
    out[paired] = mix(symbol[first] * WORD_FACTOR + mix(symbol[first + 1]) + U64(r))
    length[paired] += size[first + 1]
    return out, length, text[kept], left, np.cumsum(stays) - 1


class Parsed:
    """Windows of a batch of texts: the first word of each, its text, its representative symbol (even) and its name."""

    def __init__(self, column: pa.Array, window: int = WINDOW, rounds: int = ROUNDS) -> None:
        self.words = words = Words(column)
        n = np.diff(words.first)
        text = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(text))
        self.start = start = at[at + window <= np.repeat(words.first[1:], n)]
        self.text = text[start]
        self.name = sequence_hashes(words.hash, window)[start] if len(start) else np.zeros(0, U64)
        self.symbol = mix(self.name ^ SECOND_FACTOR)
        if len(start):
            self._represent(text, window, rounds)
        self.symbol &= ~U64(1)

    def _represent(self, text: np.ndarray, window: int, rounds: int) -> None:
        symbol, size = self.words.hash, np.ones(len(text), np.int64)
        low, high = self.start, self.start + window  # the symbols inside each window for certain
        levels = []
        for r in range(rounds):
            symbol, size, text, left, where = naming_round(symbol, size, text, r)
            low = low + ~left[np.minimum(low, len(left) - 1)]
            high = high - left[high - 1]
            low, high = where[np.minimum(low, len(where) - 1)], np.where(high > low, where[high - 1] + 1, 0)
            high = np.maximum(high, 1)
            levels.append((symbol, size, low, high))
        todo = np.arange(len(self.start))
        for symbol, size, low, high in reversed(levels):
            low, most = low[todo], high[todo]
            best, longest = np.zeros(len(todo), U64), np.ones(len(todo), np.int64)
            for k in range(int((most - low).max(initial=0))):
                at = np.flatnonzero(low + k < most)
                new, n = symbol[low[at] + k], size[low[at] + k]
                better = (n > longest[at]) | (n == longest[at]) & (n > 1) & (new < best[at])
                best[at[better]], longest[at[better]] = new[better], n[better]
            found = longest > 1
            self.symbol[todo[found]] = best[found]
            todo = todo[~found]

    def codes(self) -> np.ndarray:
        return (self.words.hash >> U64(48)).astype(np.uint16)


def _parts(names: np.ndarray, ranges: int) -> np.ndarray:
    return ((names >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)


#: What goes to ranges of names; rows marked direct are hits of one text that need no meeting.
_SYMBOLS = "part int, direct boolean, docs binary, hashes binary, values binary"
_STRETCHES = _SYMBOLS + ", places binary, sizes binary, names binary, codes binary"
#: A hit of a text: a symbol, or places in a row as the first one and, in the upper half, their number.  In the sharing
#: round a hit without a document is a hot symbol, with its number of entries.
_HITS = "doc_id long, text_hash long, hit long"
Hits = tuple[np.ndarray, np.ndarray, np.ndarray]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _cuts(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the parts that a sorted array has."""
    first = _group_starts(part)
    yield from zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=True)


def _distinct(doc: np.ndarray, own: np.ndarray, value: np.ndarray) -> Hits:
    order = np.lexsort((value, own, doc))
    doc, own, value = doc[order], own[order], value[order]
    keep = _group_starts(doc, own, value)
    return doc[keep], own[keep], value[keep].astype(np.int64)


def _in_rows(doc: np.ndarray, own: np.ndarray, at: np.ndarray) -> Hits:
    """Places as the first and the number of those that follow one another."""
    doc, own, at = _distinct(doc, own, at)
    first = _group_starts(doc, own, at - np.arange(len(at)))
    n = np.diff(np.append(first, len(at)))
    return doc[first], own[first], at[first] | n << 32


def _batch(hits: Hits, hot: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    columns = [pa.array(c) for c in hits]
    if hot is not None:
        more = (pa.nulls(len(hot[0]), pa.int64()), pa.array(hot[0]), pa.array(hot[1]))
        columns = [pa.concat_arrays(c) for c in zip(columns, more, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "hit"])


def _direct(hits: Hits, ranges: int, width: int) -> list[tuple]:
    """Hits as a row per text for the ranges, dealt by their texts."""
    doc, own, value = hits
    first = _group_starts(doc, own)
    part = (mix(doc[first].astype(U64) ^ mix(own[first].astype(U64))) % U64(ranges)).astype(np.int64)
    ends = [*first[1:].tolist(), len(doc)]
    return [(r, True, doc[a : a + 1].tobytes(), own[a : a + 1].tobytes(), value[a:b].tobytes(), *[None] * width) for r, a, b in zip(part.tolist(), first.tolist(), ends, strict=False)]


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _hits_of(row: tuple) -> pa.RecordBatch:
    """A direct row back as hits."""
    doc, own, value = (np.frombuffer(row[k], "<i8") for k in (2, 3, 4))
    return _batch((np.repeat(doc, len(value)), np.repeat(own, len(value)), value))


def _read(rows: list[tuple], kinds: dict[int, str]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in kinds.items()]


# The sharing round --------------------------------------------------------------------------------------------------


def _meet(symbol: np.ndarray, doc: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different entries in order, which of them share their symbol with another document, and the groups' starts and sizes."""
    order = np.lexsort((own, doc, symbol))
    symbol, doc, own = symbol[order], doc[order], own[order]
    keep = _group_starts(symbol, doc, own)
    symbol, doc, own = symbol[keep], doc[keep], own[keep]
    first = _group_starts(symbol)
    size = np.diff(np.append(first, len(symbol)))
    met = np.repeat(doc[first] != doc[first + size - 1], size)
    return symbol, doc, own, met, first, size


def _symbols_out(ranges: int):
    """Symbols to ranges of names; texts' symbols that meet here already are hits."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        symbol, doc, own, met, first, size = _meet(*(np.concatenate([h[k] for h in held]) for k in range(3)))
        out = _direct(_distinct(doc[met], own[met], symbol[met]), ranges, 0)
        # Two documents stand for those that met, so the symbol is shared wherever either goes.
        stand = ~met
        stand[first] = stand[first + size - 1] = True
        symbol, doc, own = symbol[stand], doc[stand], own[stand]
        part = _parts(symbol, ranges)
        out += [(r, False, doc[a:b].tobytes(), own[a:b].tobytes(), symbol[a:b].tobytes()) for r, a, b in _cuts(part)]
        return _rows(out, _SYMBOLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                p = Parsed(batch.column(2))
                doc, own = (np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1))
                order = np.lexsort((p.symbol, p.text))
                keep = order[_group_starts(p.text[order], p.symbol[order])]
                held.append((p.symbol[keep], doc[p.text[keep]], own[p.text[keep]]))
                size += len(keep)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _shared(hot_from: int):
    """Symbols that several documents have, as hits of their texts; hot ones also alone, with their number of entries."""

    def meet(held: list[tuple]) -> pa.RecordBatch:
        symbol, doc, own, met, first, size = _meet(*_read(held, {4: "<u8", 2: "<i8", 3: "<i8"}))
        hot = met[first] & (size >= hot_from)
        return _batch((doc[met], own[met], symbol[met].astype(np.int64)), (size[hot], symbol[first[hot]].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in _in_turn(batches):
            if row[1]:
                yield _hits_of(row)
                continue
            if held and row[0] != held[0][0]:
                yield meet(held)
                held = []
            held.append(row)
        if held:
            yield meet(held)

    return run


# The verifying round ------------------------------------------------------------------------------------------------


def covered(symbol: np.ndarray, name: np.ndarray, doc: np.ndarray, words: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which windows a smaller document has as well; window i begins at ``codes[words[i]]``.

    Windows meet by symbol and name; then all their words are compared, and those that differ from the first of
    their group are grouped again without it.
    """
    out = np.zeros(len(name), bool)
    todo = np.arange(len(name))
    while len(todo):
        order = todo[np.lexsort((doc[todo], name[todo], symbol[todo]))]
        first = _group_starts(symbol[order], name[order])
        leader = np.repeat(order[first], np.diff(np.append(first, len(order))))
        same = np.ones(len(order), bool)
        for k in range(WINDOW):
            same &= codes[words[order] + k] == codes[words[leader] + k]
        out[order[same]] = doc[order[same]] > doc[leader[same]]
        todo = order[~same]
    return out


class Stretches:
    """Windows, which go as stretches of consecutive ones: doc, own, symbol, name, place, and the codes of their words."""

    COLUMNS = ("doc", "own", "symbol", "name", "at")

    def __init__(self) -> None:
        self.doc, self.own, self.at = (np.zeros(0, np.int64) for _ in range(3))
        self.symbol, self.name = (np.zeros(0, U64) for _ in range(2))
        self.words, self.codes = np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def add(self, doc, own, symbol, name, at, words, codes) -> None:
        """More windows; ``words`` are their first words in ``codes``."""
        self.words = np.concatenate([self.words, words + len(self.codes)])
        self.codes = np.concatenate([self.codes, codes])
        for column, more in zip(self.COLUMNS, (doc, own, symbol, name, at), strict=True):
            setattr(self, column, np.concatenate([getattr(self, column), more]))

    def read(self, rows: list[tuple]) -> None:
        doc, own, symbol, at, size, name, codes = _read(rows, {2: "<i8", 3: "<i8", 4: "<u8", 5: "<u4", 6: "u1", 7: "<u8", 8: "<u2"})
        size = size.astype(np.int64)
        long = size + WINDOW - 1
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        spread = lambda c: np.repeat(c, size)
        self.add(spread(doc), spread(own), spread(symbol), name, spread(at.astype(np.int64)) + step, spread(np.cumsum(long) - long) + step, codes)

    def settle(self) -> Hits:
        """Hits of the windows that a smaller document here has; only the others are kept."""
        if not len(self.doc):
            return self.doc, self.own, self.at
        hit = covered(self.symbol, self.name, self.doc, self.words, self.codes)
        out = _in_rows(self.doc[hit], self.own[hit], self.at[hit])
        for c in (*self.COLUMNS, "words"):
            setattr(self, c, getattr(self, c)[~hit])
        used = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(used, self.words, 1)
        np.add.at(used, self.words + WINDOW, -1)
        used = np.cumsum(used)[:-1] > 0
        self.words = (np.cumsum(used) - 1)[self.words]
        self.codes = self.codes[used]
        return out

    def rows(self, ranges: int, hot: np.ndarray) -> list[tuple]:
        """Stretches to the ranges of their symbols; windows around hot symbols alone to those of their names."""
        if not len(self.doc):
            return []
        alone = np.isin(self.symbol, hot)
        new = alone.copy()
        new[1:] |= alone[:-1]
        new[_group_starts(self.doc, self.own, self.symbol)] = True
        new[1:] |= (np.diff(self.at) != 1) | (np.diff(self.words) != 1)
        first = np.flatnonzero(new)
        new |= (np.arange(len(new)) - np.repeat(first, np.diff(np.append(first, len(new))))) % STRETCH == 0
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))
        part = _parts(np.where(alone[first], mix(self.name[first]), self.symbol[first]), ranges)
        order = np.argsort(part, kind="stable")
        first, size, part = first[order], size[order], part[order]
        long = size + WINDOW - 1
        ends = np.cumsum(long)
        every = np.repeat(self.words[first] - (ends - long), long) + np.arange(int(ends[-1]))
        codes = self.codes[every].astype("<u2")
        last = np.cumsum(size)
        name = self.name[np.repeat(first - (last - size), size) + np.arange(int(last[-1]))].astype("<u8")
        doc, own, symbol, at = self.doc[first], self.own[first], self.symbol[first], self.at[first].astype("<u4")
        return [(r, False, doc[a:b].tobytes(), own[a:b].tobytes(), symbol[a:b].tobytes(), at[a:b].tobytes(), size[a:b].astype("u1").tobytes(), name[last[a] - size[a] : last[b - 1]].tobytes(), codes[ends[a] - long[a] : ends[b - 1]].tobytes()) for r, a, b in _cuts(part)]


def _windows_out(ranges: int, hot):
    """Stretches around shared symbols to ranges, combined; places that are covered here already are hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stretches()

        def flush() -> pa.RecordBatch:
            hits = _direct(held.settle(), ranges, 4)
            return _rows(hits + held.rows(ranges, hot.value), _STRETCHES)

        for whole in batches:
            for batch in slices(whole, "text"):
                p = Parsed(batch.column(3))
                doc, own = (np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1))
                shared, of = _lists(batch.column(2))
                # (text, symbol) of windows looked up in those that are shared, by one mixed key.
                key = np.sort(mix(shared.astype(U64) ^ mix(of.astype(U64))))
                mine = mix(p.symbol ^ mix(p.text.astype(U64)))
                which = np.flatnonzero(key[np.minimum(np.searchsorted(key, mine), len(key) - 1)] == mine)
                text = p.text[which]
                held.add(doc[text], own[text], p.symbol[which], p.name[which], p.start[which] - p.words.first[text], p.start[which], p.codes())
                if len(held.doc) >= FLUSH or len(held.codes) >= 16 * FLUSH:
                    yield flush()
                    held = Stretches()
        if len(held.doc):
            yield flush()

    return run


def _repeats(most: int):
    """Places of windows that a smaller document has, as hits of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, part, n = Stretches(), [], None, 0
        for row in _in_turn(batches):
            if row[1]:
                yield _hits_of(row)
                continue
            if waiting and (row[0] != part or n >= most):
                held.read(waiting)
                yield _batch(held.settle())
                waiting, n = [], 0
            if row[0] != part:
                held, part = Stretches(), row[0]
            waiting.append(row)
            n += sum(row[6])
        if waiting:
            held.read(waiting)
            yield _batch(held.settle())

    return run


# Texts --------------------------------------------------------------------------------------------------------------


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the row of each."""
    return np.asarray(column.flatten()), np.repeat(np.arange(len(column)), np.asarray(column.value_lengths()))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words, and the digest of all of them."""
    for whole in batches:
        for batch in slices(whole, "text"):
            n, digest = [], []
            for text in texts_of(batch):
                words = text.encode().split()
                n.append(len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(digest)], names=[*batch.schema.names[:-1], "n_words", "sha"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their covered windows: the kept words."""
    for whole in batches:
        for batch in slices(whole, "text"):
            removed, kept = [], []
            places, of = _lists(batch.column(2))
            cuts = np.searchsorted(of, np.arange(batch.num_rows + 1)).tolist()
            for a, b, text in zip(cuts, cuts[1:], texts_of(batch), strict=False):
                words = text.encode().split()
                at, n = places[a:b] & 0xFFFFFFFF, places[a:b] >> 32
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n - 1 + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "text_hash", "n_removed", "kept"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_removed, kept of the texts that lose words."""
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col)
    words = (docs.agg(F.sum(F.length(text_col))).first()[0] or 0) // 6
    ranges = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), words // 4 // RANGE + 1)
    by_part = lambda df: df.repartition("part").sortWithinPartitions("part")
    of_text = lambda hits: hits.groupBy("doc_id", "text_hash").agg(F.collect_list("hit").alias("hits"))
    met = table(by_part(rows.mapInArrow(tidy(_symbols_out(ranges)), _SYMBOLS)).mapInArrow(tidy(_shared(HOT)), _HITS))
    top = met.where("doc_id IS NULL").orderBy(F.desc("text_hash"), "hit").limit(HOT_LIST).select("hit").collect()
    hot = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in top], np.int64).astype(U64)))
    found = rows.join(of_text(met.where("doc_id IS NOT NULL")), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    found = table(found.select("doc_id", "text_hash", "hits", "text"), compression="zstd")
    hits = table(by_part(found.mapInArrow(tidy(_windows_out(ranges, hot)), _STRETCHES)).mapInArrow(tidy(_repeats(HELD)), _HITS))
    lost = found.select("doc_id", "text_hash", "text").join(of_text(hits), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "hits", "text")
    return lost.mapInArrow(tidy(_without), "doc_id long, text_hash long, n_removed long, kept string")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256."""
    lost = repeated_passages(docs, id_col, text_col).select("doc_id", "text_hash", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    every = _keyed(docs, id_col, text_col).mapInArrow(tidy(_whole), "doc_id long, text_hash long, n_words long, sha string")
    joined = every.join(table(lost), ["doc_id", "text_hash"], "left")
    return joined.select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
