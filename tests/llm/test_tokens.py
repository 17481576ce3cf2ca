"""Token files and packing against the tokenizers library itself."""

import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexigrain.llm import packing, token_files, tokens
from lexigrain.llm.common import scratch

NAMES = {"word_bpe_49k.json": True, "byte_bpe_50k.json": False}
PIECES = ["a", "Word", "b!", " ", "  ", "\n", "\t", "12", "'s", "é.", "ß", "İ", "\x85", "\xa0", "\x1c", " ", "²", "漢", "🎉", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "don't", "é", "Ǆ"]


@pytest.fixture(scope="module")
def encoders():
    return {n: tokens.CachedEncoder(tokens.tokenizer_path(n), drops, cache_words=500) for n, drops in NAMES.items()}


@lru_cache
def library(path):
    return Tokenizer.from_file(path)


def plain(encoder, texts):
    """The ids of a tokenizer of the library's own, with no option but the contract's."""
    return [e.ids for e in library(encoder.path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=4))
def test_cached_ids_are_the_library_s(encoders, name, texts):
    e = encoders[name]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == plain(e, texts)
    narrow, width = e.encode_narrow(texts)
    assert width == 2 and [np.frombuffer(b, "<u2").tolist() for b in narrow] == plain(e, texts)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES, " a", " Word", " Word.", "\nb", " \x00", ", "]), max_size=12).map("".join), max_size=6))
def test_flat_ids_are_the_library_s(encoders, name, texts):
    """Texts of all kinds side by side, each with its end id; ids put together in parts that end within a text."""
    e = encoders[name]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tokens, "WORDS_AT_ONCE", 3)
        ids, sizes = e.encode_flat(texts, [7])
    ends = np.cumsum(sizes).tolist()
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)] == [[*x, 7] for x in plain(e, texts)] and len(ids) == sum(sizes)


def test_each_word_of_a_batch_is_looked_up_once():
    """op6's cost was a look-up for every word; words of one batch repeat, across texts as well."""

    class Counted(tokens._SpacedIds):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    e = tokens.CachedEncoder(tokens.tokenizer_path("byte_bpe_50k.json"), False)
    e.spaced = Counted(e.pieces, e._spaced)
    texts = ["the quick brown fox jumps over the lazy dog\nand the quick fox runs. " * 20 + f"number {i}" for i in range(50)]
    texts = [t.replace("  ", " ") for t in texts]
    narrow, _ = e.encode_narrow(texts)
    assert [np.frombuffer(b, "<u2").tolist() for b in narrow] == plain(e, texts)
    assert Counted.asked <= 2 * len({w for t in texts for w in t.split()})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, (1 << 32) - 1), min_size=1, max_size=9), max_size=6))
def test_blocks_round_trip(docs):
    sizes = np.array([len(d) for d in docs], np.int64)
    ranks = np.array([r for d in docs for r in d], np.uint32)
    controls, data = token_files.encode_ranks(ranks, sizes)
    assert sum(map(len, data)) == sum(1 if r < 1 << 8 else 2 if r < 1 << 16 else 3 if r < 1 << 24 else 4 for r in ranks.tolist())
    block = token_files.pack_block(sizes.tolist(), controls, data)
    got = token_files.unpack_block(block)
    assert got[0].tolist() == sizes.tolist() and got[1].tolist() == ranks.tolist()
    with pytest.raises(ValueError):
        token_files.unpack_block(b"XXXX" + block[4:])
    if docs:
        with pytest.raises(ValueError):
            token_files.unpack_block(block[:-1])


def check_files(df, encoder, end_id, spark, name):
    path = scratch(spark)
    token_files.write_token_files(df, path, tokens.tokenizer_path(name), end_id, NAMES[name])
    out = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    source = df.select("doc_id", "text").collect()
    want = Counter()
    for r, ids in zip(source, plain(encoder, [r.text or "" for r in source]), strict=True):
        want[(r.doc_id, len(ids) + 1, zlib.crc32(np.array([*ids, end_id], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is None, r.doc_id or 0) for r in out]
    assert order == sorted(order)
    return path


@pytest.mark.parametrize("name", NAMES)
def test_token_files(spark, documents, odd, encoders, monkeypatch, name):
    check_files(documents, encoders[name], 0, spark, name)
    monkeypatch.setattr(token_files, "RANGE_IDS", 20_000)
    check_files(documents, encoders[name], 0, spark, name)
    monkeypatch.setattr(token_files, "MAX_RANGES", 5)
    check_files(documents, encoders[name], 0, spark, name)
    path = check_files(odd, encoders[name], 0, spark, name)
    counts = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    assert [r["rank"] for r in counts] == list(range(len(counts)))


def test_one_identifier_is_spread(spark, encoders, monkeypatch):
    """Rows of one identifier, or of none, go to several ranges, in scan order."""
    monkeypatch.setattr(token_files, "RANGE_IDS", 500)
    df = spark.createDataFrame([(None if i % 3 else 7, f"text {i} of many words") for i in range(600)], "doc_id long, text string").coalesce(1)
    path = check_files(df, encoders["byte_bpe_50k.json"], 0, spark, "byte_bpe_50k.json")
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    assert len({r.part for r in blocks if None in r.doc_ids}) > 3 and len({r.part for r in blocks if 7 in r.doc_ids}) > 2


def test_common_ids_take_one_byte(spark, documents):
    path = scratch(spark)
    token_files.write_token_files(documents, path, tokens.tokenizer_path("byte_bpe_50k.json"), 0)
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    ids = sum(r.n_ids for r in blocks)
    assert sum(len(r.content) for r in blocks) < 1.75 * ids


def test_token_files_empty(spark, empty):
    path = scratch(spark)
    token_files.write_token_files(empty, path, tokens.tokenizer_path("byte_bpe_50k.json"), 0)
    assert token_files.read_token_files(spark, path).count() == 0


# Packing


def check_plan(histogram, capacity=packing.CAPACITY):
    recipes = packing.plan(histogram, capacity)
    have = Counter()
    for recipe, bins in recipes:
        assert bins > 0 and sum(s * k for s, k in recipe) <= capacity
        for s, k in recipe:
            have[s] += k * bins
    assert have == Counter({s: n for s, n in histogram.items() if n})
    bound = -(-sum(s * n for s, n in histogram.items()) // capacity)
    return sum(b for _, b in recipes), bound


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_hold_everything(histogram):
    used, bound = check_plan(histogram, 64)
    room = []
    for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):  # first fit by decreasing size
        at = next((i for i, r in enumerate(room) if r >= size), None)
        if at is None:
            room.append(64 - size)
        else:
            room[at] -= size
    assert bound <= used <= len(room) + 1


def test_plans_are_tight():
    r = np.random.default_rng(0)
    sizes = np.clip(r.lognormal(6, 1, 20_000), 1, 4096).astype(int)
    used, bound = check_plan({int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)})
    assert used <= bound * 1.005 + 1
    used, bound = check_plan({1024: 600, 1536: 400, 512: 200, 4096: 7})
    assert used == bound


def best_fit(histogram, capacity):
    """Sequences that best fit by decreasing length takes."""
    room, used = [], 0
    for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        at = bisect_left(room, size)
        free = room.pop(at) if at < len(room) else capacity
        used += free == capacity
        insort(room, free - size)
    return used


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_program_is_no_worse_than_best_fit(sf):
    """On the lengths of whole tables, whose numbers of different lengths go from few to thousands."""
    texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()
    encoder = tokens.CachedEncoder(tokens.tokenizer_path("word_bpe_49k.json"), True)
    sizes = [len(b) // 4 + 1 for b in encoder.encode([t or "" for t in texts])]
    histogram = Counter(p for n in sizes for p in [4096] * (n // 4096) + ([n % 4096] if n % 4096 else []))
    used, bound = check_plan(histogram)
    assert used <= best_fit(histogram, 4096) and used <= bound + 1


def test_fill_is_best():
    left = np.array([0, 0, 3, 0, 0, 2, 0, 1])  # three 2s, two 5s, one 7
    assert packing.best_fill(left, 12) == [(7, 1), (5, 1)] and packing.best_fill(left, 1) == []
    assert packing.best_fill(left, 8) == [(7, 1)] and sum(s * k for s, k in packing.best_fill(left, 18)) == 18


def test_lengths_that_units_round_up():
    assert check_plan({1365: 300})[0] == 100 and check_plan({17: 18}, 64)[0] == 6


def test_many_lengths_are_priced_exactly(monkeypatch):
    asked = []

    def program(sizes, counts, capacity, *args):
        asked.append((sizes.tolist(), counts.tolist(), capacity))
        return {((0, 1), (69, 1)): 2.0}

    monkeypatch.setattr(packing, "configuration_lp", program)
    recipes = packing.plan({n: 3 for n in range(1, 71)}, 71)
    assert asked == [([*range(1, 71)], [3.0] * 70, 71)]
    assert recipes[0] == (((70, 1), (1, 1)), 2)


def test_knapsack_is_best():
    sizes, prices = np.array([2, 3, 5]), np.array([3.0, 5.0, 8.0])
    assert sum(prices[j] * k for j, k in packing.knapsack(sizes, prices, 11).items()) == 18


def check_pack(df, encoder):
    rows = packing.pack(df, tokens.tokenizer_path("word_bpe_49k.json")).collect()
    source = df.select("doc_id", "text").collect()
    want = Counter()
    for r, ids in zip(source, plain(encoder, [r.text or "" for r in source]), strict=True):
        ids = np.array([*ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(r.doc_id, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by), -(-sum(r.length for r in rows) // 4096)


def test_pack(documents, odd, empty, encoders):
    used, bound = check_pack(documents, encoders["word_bpe_49k.json"])
    assert used <= bound * 1.02 + 1
    check_pack(odd, encoders["word_bpe_49k.json"])
    assert packing.pack(empty, tokens.tokenizer_path("word_bpe_49k.json")).count() == 0
