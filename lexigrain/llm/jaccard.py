"""All pairs of documents with 5-word shingle Jaccard similarity of at least 0.8, as links between classes.

The document by shingle matrix is multiplied by its transpose in blocks, and only where two rows can be similar:

1. Equal sets form a class, found by a 128-bit digest; one document of each class goes on.
2. Shingles are ordered: rare ones by hash, then the hot ones by frequency.  Fingerprint counts over all documents
   say which are hot; as any order gives the same links, only the HOT_LIST most frequent ones are told apart.
3. Of a set of n, the first n - ceil(0.8 n) + k shingles are posted (k = 1 + n // 32).  Similar sets have their
   first k common shingles in both prefixes, k the smaller of theirs.
4. Postings meet by shingle, in ranges of hashes.  In lists of up to LIST members, pairs of fitting sizes add up
   their overlap and go on from k on; a longer list only ties its members together.
5. Tied members form clusters; each cluster's shingle sets are multiplied in blocks of bounded size, sizes that
   can't reach 0.8 apart are skipped, and exact overlaps decide.  A block reports a spanning forest of its links.
   Large clusters are connected through a block of each size first; what that leaves apart is then multiplied by all.

No list, however long, is expanded into its pairs, and no link is lost: similar sets share a shingle list, so they
are a pair or are tied, and either way they meet in a block or are connected already.

Defined cases: fewer than five words are one shingle, none are the empty set, which is linked with nothing; null
texts are empty; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop, numbered, scratch, small, table
from .components import components
from .tokens import forget, slices, tidy
from .wordhash import SECOND_FACTOR, U64, Words, mix, sequence_hashes

K = 5
#: The threshold, 0.8, as a fraction.
PART, WHOLE = 4, 5
#: Documents from which on a shingle is hot, and how many hot shingles are told apart at most (8 MB).
HOT, HOT_LIST = 16, 1 << 20
#: Longest posting list whose pairs are counted.
LIST = 64
#: Shingles, and documents, in a block at most.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 20, 256
#: Sets of a block from which on a shingle's products are dense; pairs of sparse ones that are added up at once.
FEW, PAIRS = 32, 1 << 20
#: Postings, and fingerprints, that a task holds before it hands them on; fingerprints in a range.
FLUSH, RANGE = 1 << 19, 1 << 21


def shingle_sets(column: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    words = Words(column, lower=True)
    n = np.diff(words.first)
    hashes = sequence_hashes(words.hash, k)
    out = []
    for first, count in zip(words.first[:-1].tolist(), n.tolist(), strict=True):
        if count >= k:
            out.append(np.unique(hashes[first : first + count - k + 1]))
        elif count:
            out.append(sequence_hashes(words.hash[first : first + count], count) + U64(count))
        else:
            out.append(np.zeros(0, U64))
    return out


def _fingerprints(s: np.ndarray) -> np.ndarray:
    return (s >> U64(32)).astype(np.uint32)


def _prefix_size(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - -(-n * PART // WHOLE) + 1 + n // 32, 0)


# Hot shingles -------------------------------------------------------------------------------------------------------


def _count_out(ranges: int):
    """Fingerprints and their counts, sorted, to the ranges of fingerprints."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        part = (values.astype(np.uint64) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(ranges + 1))
        rows = [(r, _pack(values[a:b], counts[a:b])) for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, size = [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                for s in shingle_sets(batch.column(0)):
                    held.append(_fingerprints(s))
                    size += len(s)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Steps of the values in 2 bytes where all fit, and the counts that aren't 1."""
    steps = np.diff(values)
    narrow = len(steps) == 0 or int(steps.max()) < 1 << 16
    more = np.flatnonzero(counts > 1)
    return b"".join([np.array([len(values), len(more), narrow, values[0]], "<u4").tobytes(), steps.astype("<u2" if narrow else "<u4").tobytes(), more.astype("<u4").tobytes(), counts[more].astype("<u4").tobytes()])


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m, narrow, first = np.frombuffer(data, "<u4", 4).tolist()
    kind = "<u2" if narrow else "<u4"
    steps = np.frombuffer(data, kind, n - 1, 16)
    at = 16 + steps.nbytes
    values = np.cumsum(np.concatenate([[first], steps]), dtype=np.int64).astype(np.uint32)
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(data, "<u4", m, at)] = np.frombuffer(data, "<u4", m, at + 4 * m)
    return values, counts


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by their first column, gathered by it."""
    part, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != part:
                yield part, rows
                rows = []
            part = row[0]
            rows.append(row)
    if rows:
        yield part, rows


def _hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _by_part(batches):
        values, counts = map(np.concatenate, zip(*(_unpack(r[1]) for r in rows), strict=True))
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.diff(values, prepend=values[0] ^ np.uint32(1)))
        total = np.add.reduceat(counts, first)
        hot = total >= HOT
        yield pa.RecordBatch.from_arrays([pa.array(values[first][hot].astype(np.int64)), pa.array(total[hot])], names=["fingerprint", "n"])


def hot_shingles(docs: DataFrame, ranges: int, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of the hottest shingles and the level, log2 of their counts, of each."""
    out = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(_count_out(ranges)), "part int, data binary")
    hot = out.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(_hot), "fingerprint long, n long")
    top = hot.orderBy(F.desc("n"), "fingerprint").limit(HOT_LIST).toPandas().sort_values("fingerprint")
    return top["fingerprint"].to_numpy(np.uint32), np.log2(np.maximum(top["n"].to_numpy(float), 1)).astype(np.uint8)


# Postings and candidates --------------------------------------------------------------------------------------------


def _sets_out(hot):
    """Per row: doc_id, text_hash, n, digest, and the posted shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        fingerprints, levels = hot.value
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column(2))
                sizes = np.array([len(s) for s in sets], np.int64)
                every = np.concatenate(sets) if sets else np.zeros(0, U64)
                level = np.zeros(len(every), np.uint8)
                if len(fingerprints):
                    prints = _fingerprints(every)
                    at = np.minimum(np.searchsorted(fingerprints, prints), len(fingerprints) - 1)
                    found = fingerprints[at] == prints
                    level[found] = levels[at[found]]
                ends = np.cumsum(sizes)
                prefix = []
                for s, a, b, p in zip(sets, (ends - sizes).tolist(), ends.tolist(), _prefix_size(sizes).tolist(), strict=True):
                    own = level[a:b]
                    prefix.append((s[:p] if not own.any() else s[np.argsort(own, kind="stable")[:p]]).astype("<u8").tobytes())
                sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(every ^ f), dtype=U64)]) for f in (SECOND_FACTOR, U64(0x5851F42D4C957F2D))]
                first, second = ((c[ends] - c[ends - sizes]).astype(np.int64) for c in sums)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes), pa.array(first), pa.array(second), pa.array(prefix, pa.binary())], names=["doc_id", "text_hash", "n", "digest1", "digest2", "prefix"])

    return run


def _postings_out(ranges: int):
    """Posted shingles to ranges of hashes: shingles, owners and sizes as bytes."""

    def flush(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        every = np.concatenate([p for *_, p in held])
        times = [len(p) for *_, p in held]
        owner, n = (np.repeat(np.array(v, np.int64), times) for v in ([h[0] for h in held], [h[1] for h in held]))
        part = ((every >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(ranges + 1))
        rows = []
        for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b > a:
                at = order[a:b]
                rows.append((r, every[at].tobytes(), owner[at].astype("<i8").tobytes(), n[at].astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "shingles", "owners", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for owner, n, prefix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((owner, n, np.frombuffer(prefix, "<u8")))
                size += len(held[-1][2])
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of a range: pairs with their overlap in it, and ties (overlap 0) within long lists."""
    for _, rows in _by_part(batches):
        shingles, owner, n = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in ((1, "<u8"), (2, "<i8"), (3, "<u4")))
        order = np.lexsort((owner, n, shingles))
        shingles, owner, n = shingles[order], owner[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
        size = np.diff(np.append(first, len(shingles)))
        us, vs, ks = [], [], []
        # Members are sorted by size, so those at distance d fit or are too large.
        for d in range(1, LIST):
            left = (size > d) & (size <= LIST)
            if not left.any():
                break
            starts, count = first[left], size[left] - d
            at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            fits = n[at] * WHOLE >= n[at + d] * PART
            us.append(owner[at[fits]])
            vs.append(owner[at[fits] + d])
            ks.append(n[at[fits]])
        out = []
        if us:
            u, v, k = map(np.concatenate, (us, vs, ks))
            low, high = np.minimum(u, v), np.maximum(u, v)
            order = np.lexsort((high, low))
            low, high, k = low[order], high[order], k[order]
            new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])) if len(low) else np.zeros(0, np.int64)
            out.append((low[new], high[new], np.diff(np.append(new, len(low))), 1 + k[new] // 32))
        long = size > LIST
        if long.any():
            member = np.concatenate([np.arange(a, a + s) for a, s in zip(first[long].tolist(), size[long].tolist(), strict=True)])
            centre = np.repeat(np.minimum.reduceat(owner[member], np.cumsum(size[long]) - size[long]), size[long])
            ties = np.unique(np.stack([centre, owner[member]], 1), axis=0)
            ties = ties[ties[:, 0] != ties[:, 1]]
            zero = np.zeros(len(ties), np.int64)
            out.append((ties[:, 0], ties[:, 1], zero, zero))
        if out:
            u, v, overlap, need = map(np.concatenate, zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (u, v, overlap, need)], names=["u", "v", "overlap", "need"])


# Blocks -------------------------------------------------------------------------------------------------------------


def _read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])


def _sparse(row: np.ndarray, column: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Add the products of sparse columns: entries (owner, column index) of rows and of columns, sorted by index."""
    many = np.bincount(column[1], minlength=int(at.max(initial=-1)) + 1) if len(column[1]) else np.zeros(0, np.int64)
    first = np.cumsum(many) - many
    times = many[row[1]] if len(many) else np.zeros(len(row[1]), np.int64)
    ends = np.cumsum(times)
    for a in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        pair = np.arange(a, min(a + PAIRS, int(ends[-1])))
        entry = np.searchsorted(ends, pair, "right")
        other = column[0][first[row[1][entry]] + pair - (ends[entry] - times[entry])]
        out += np.bincount(row[0][entry] * out.shape[1] + other, minlength=out.size).reshape(out.shape)


def overlaps(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of row sets with column sets: a product of sparse incidence matrices.

    Shingles of one set alone drop out.  Those of few sets add up pair by pair; those of many are multiplied as
    dense blocks, each exact in single precision, and blocks are summed as whole numbers.
    """
    n, out = len(rows), np.zeros((len(rows), len(columns)), np.int64)
    every = np.concatenate([*rows, *columns])
    owner = np.repeat(np.arange(n + len(columns)), [len(s) for s in (*rows, *columns)])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    index = np.cumsum(new) - 1
    size = np.bincount(index)[index] if len(index) else np.zeros(0, np.int64)
    few = (size > 1) & (size <= FEW)
    at, own = index[few], owner[few]
    _sparse((own[own < n], at[own < n]), (own[own >= n] - n, at[own >= n]), at, out)
    owner, index = owner[size > FEW], index[size > FEW]
    index = np.unique(index, return_inverse=True)[1]
    step = max(256, (1 << 22) // max(1, n + len(columns)))
    width = int(index.max(initial=-1)) + 1
    cuts = np.searchsorted(index, np.arange(0, width + step, step))
    for block, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        m = np.zeros((n + len(columns), min(step, width - block * step)), np.float32)
        m[owner[a:b], index[a:b] - block * step] = 1
        out += (m[:n] @ m[n:].T).astype(np.int64)
    return out


def forest(links: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix the smallest node it is connected with."""
    label = np.arange(len(links))
    while True:
        low = np.minimum(label, np.where(links, label[None, :], len(links)).min(1, initial=len(links)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _multiply(key: tuple, group: pa.Table) -> pa.Table:
    """Links within a block, or between two, of one cluster: edges of a spanning forest."""
    side, owner = (np.asarray(group.column(c)) for c in ("side", "owner"))
    sets = [np.frombuffer(s, "<u8") for s in group.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets], np.int64)
    a, b = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    inner = overlaps([sets[i] for i in a.tolist()], [sets[i] for i in b.tolist()])
    near = WHOLE * inner >= PART * (size[a][:, None] + size[b][None, :] - inner)
    links = np.zeros((len(sets), len(sets)), bool)
    links[np.ix_(a, b)] = near
    links |= links.T
    label = forest(links)
    own = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"u": owner[own], "v": owner[label[own]]})


_BLOCKS = "array<struct<a:int,p:int,b:int,q:int,side:int>>"


def _block(a: Column, p: Column, b: Column, q: Column, side: int) -> Column:
    return F.struct(a.alias("a"), p.alias("p"), b.alias("b"), q.alias("q"), F.lit(side).alias("side"))


def _blocks(when: Column, n: Column, block) -> Column:
    """block(0) to block(n - 1) where ``when`` holds."""
    return F.when(when & (n > 0), F.transform(F.sequence(F.lit(0), n - 1), block)).otherwise(F.array()).cast(_BLOCKS)


def _levels(members: DataFrame, name: str) -> DataFrame:
    """Blocks that each level of a cluster is cut into."""
    parts = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int")
    return table(members.groupBy("cluster", "level").agg(parts.alias(name)))


def _beside(members: DataFrame, levels: DataFrame, name: str, steps: dict[int, str]) -> DataFrame:
    """``members`` with the blocks of the levels that lie some steps away; 0 where there is none."""
    for step, column in steps.items():
        other = levels.select("cluster", (F.col("level") - step).alias("level"), F.col(name).alias(column))
        members = members.join(other, ["cluster", "level"], "left").withColumn(column, F.coalesce(column, F.lit(0)))
    return members


def _multiplied(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links of the blocks of ``placed`` (cluster, owner, doc_id, text_hash, blocks)."""
    placed = table(placed.where(F.size("blocks") > 0).select("cluster", "owner", "doc_id", "text_hash", "blocks"))
    n = placed.agg(F.sum(F.size("blocks"))).first()[0]
    if not n:
        return docs.sparkSession.createDataFrame([], "u long, v long")
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("text"))
    found = texts.join(small(placed, n, BROADCAST_ROWS), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
    read = found.select("owner", "cluster", "blocks", "text").mapInArrow(tidy(_read_sets), f"owner long, cluster long, blocks {_BLOCKS}, shingles binary")
    rows = read.select("owner", "cluster", F.explode("blocks").alias("k"), "shingles").select("cluster", "k.*", "owner", "shingles")
    return table(rows.groupBy("cluster", "a", "p", "b", "q").applyInArrow(_multiply, "u long, v long"))


def _exact_links(docs: DataFrame, reps: DataFrame, candidates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Edges (u, v) that connect linked classes; candidates (u, v) and reps (owner, doc_id, text_hash, n).

    A small cluster is one block.  A large one is cut by size, as sizes whose ratio passes 1.25 can't be linked, and
    levels into blocks.  First every block is multiplied by itself and by the first block of its level and of the one
    below: copies of one text, however many, are connected by that.  Only members that are not in the cluster's
    largest component then are multiplied by all that their size can be linked with; two members of that component
    need no link of their own.
    """
    members = components(candidates).select(F.col("node").alias("owner"), F.col("root").alias("cluster"))
    members = table(members.join(reps, "owner"))
    clusters = members.groupBy("cluster").agg(F.sum("n").alias("all"), F.count("*").alias("docs"))
    one = (F.col("all") <= BLOCK_SHINGLES) & (F.col("docs") <= BLOCK_DOCS)
    level = F.when(one, 0).otherwise(1 + F.floor(F.ln("n") / F.log(F.lit(1.2500001))).cast("int"))
    members = members.join(clusters, "cluster").withColumn("level", level).drop("all", "docs")
    levels = _levels(members, "parts")
    own = members.join(levels, ["cluster", "level"]).withColumn("part", F.pmod(F.xxhash64("owner"), F.col("parts")).cast("int"))
    own = table(own)
    a, p, zero = F.col("level"), F.col("part"), F.lit(0)
    lead, large = p == 0, a > 0
    first = _beside(own, levels, "parts", {1: "above", -1: "below"})
    with_self = F.array(_block(a, p, a, p, 0)).cast(_BLOCKS)
    leads_own = _blocks(lead & large, F.col("parts") - 1, lambda q: _block(a, zero, a, q + 1, 1))
    leads_above = _blocks(lead & large, F.col("above"), lambda q: _block(a, zero, a + 1, q, 1))
    led_own = _blocks(~lead & large, F.lit(1), lambda _: _block(a, zero, a, p, 2))
    led_below = _blocks(large & (F.col("below") > 0), F.lit(1), lambda _: _block(a - 1, zero, a, p, 2))
    links = _multiplied(docs, first.withColumn("blocks", F.concat(with_self, leads_own, leads_above, led_own, led_below)), id_col, text_col)
    if not own.where("level > 0").limit(1).count():
        return links
    roots = components(links).withColumnRenamed("node", "owner")
    placed = table(own.where("level > 0").join(roots, "owner", "left").withColumn("root", F.coalesce("root", "owner")))
    sizes = placed.groupBy("cluster", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("size", "root")).alias("largest"))
    rest = table(placed.join(largest, "cluster").where("root <> largest").drop("largest", "root", "part", "parts"))
    rest_levels = _levels(rest, "others")
    rest = rest.join(rest_levels, ["cluster", "level"]).withColumn("part", F.pmod(F.xxhash64("owner"), F.col("others")).cast("int"))
    # Each side names the blocks of the other at its own level and at the two beside it.
    rest = _beside(rest, levels, "parts", {0: "p0", 1: "p1", -1: "p2"})
    every = _beside(placed.drop("root"), rest_levels, "others", {0: "p0", 1: "p1", -1: "p2"})
    rows_of = lambda b: lambda q: _block(a, p, b, q, 1)
    columns_of = lambda b: lambda q: _block(b, q, a, p, 2)
    beside = (("p0", a), ("p1", a + 1), ("p2", a - 1))
    of_rest = [_blocks(F.lit(True), F.col(c), rows_of(b)) for c, b in beside]
    of_every = [_blocks(F.lit(True), F.col(c), columns_of(b)) for c, b in beside]
    columns = ("cluster", "owner", "doc_id", "text_hash", "blocks")
    both = rest.withColumn("blocks", F.concat(*of_rest)).select(*columns).union(every.withColumn("blocks", F.concat(*of_every)).select(*columns))
    return links.union(_multiplied(docs, both, id_col, text_col))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), chars // 6 // RANGE + 1)  # a shingle every six characters or so
    hot = spark.sparkContext.broadcast(hot_shingles(docs, ranges, text_col))
    kind = base.schema["doc_id"].dataType.simpleString()
    wide = scratch(spark)
    sets = table(base.mapInArrow(tidy(_sets_out(hot)), f"doc_id {kind}, text_hash long, n long, digest1 long, digest2 long, prefix binary"), wide)
    digest = ["n", "digest1", "digest2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_n"), "doc_id", "text_hash")).alias("first")
    classes = sets.where("n > 0").groupBy(*digest).agg(first).withColumn("owner", F.monotonically_increasing_id())
    classes = table(classes.select(*digest, F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "owner"))
    posted = sets.join(classes.select(*digest, F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "owner"), digest)
    posted = posted.where(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    posted = posted.select("owner", "n", "prefix").dropDuplicates(["owner"])
    out = posted.mapInArrow(tidy(_postings_out(ranges)), "part int, shingles binary, owners binary, sizes binary")
    met = out.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(_meet), "u long, v long, overlap long, need long")
    pairs = met.groupBy("u", "v").agg(F.sum("overlap").alias("overlap"), F.min("need").alias("need"))
    candidates = table(pairs.where("overlap >= need").select("u", "v"))
    sets = table(sets.select("doc_id", *digest))
    drop(spark, wide)
    links = _exact_links(docs, classes.select("owner", "doc_id", "text_hash", "n"), candidates, id_col, text_col)
    roots = components(links).withColumnRenamed("node", "owner")
    named = table(classes.join(roots, "owner", "left").withColumn("root", F.coalesce("root", "owner")))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select(*digest, "component_id")
    joined = sets.join(named, digest, "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each group of near duplicates, with all their columns.

    The document with the smallest identifier stays; documents without words aren't grouped, and stay.
    """
    rows, row = numbered(docs)
    grouped = near_duplicates(rows.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("doc_id"), F.col(text_col).alias("text")))
    stay = grouped.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.row").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
