"""Near duplicates and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrain.llm import jaccard, substring_dedup
from lexigrain.llm.components import components
from lexigrain.llm.wordhash import Words, sequence_hashes

words = lambda t: re.findall("[^ \t-\r]+", t or "")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    u, seen, posted = Union(), {}, defaultdict(list)
    for d, s in sorted(sets, key=lambda x: len(x[1])):
        if not s:
            u.find(d)
            continue
        if s in seen:
            u.join(seen[s], d)
            continue
        seen[s] = d
        u.find(d)
        for e, k in Counter(e for x in s for e in posted[x]).items():
            if 100 * k >= 80 * (len(s) + len(e[1]) - k):
                u.join(e[0], d)
        for x in s:
            posted[x].append((d, s))
    return {d: (len(s), u.find(d)) for d, s in sets}


def near_copies(n, seed):
    """Chains and groups of texts that differ in a few words, some sharing a passage."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    out, base = [], []
    for i in range(n):
        if not base or r.random() < 0.2:
            base = [r.choice(vocabulary) for _ in range(r.choice([4, 5, 6, 9, 40, 120]))]
            if r.random() < 0.4:
                base = base + passage
        text = list(base)
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            text[r.randrange(len(text))] = r.choice(vocabulary)
        if r.random() < 0.5:
            base = text
        out.append((i * 3 % (n * 3), " ".join(text)))
    return out


def check(df, want):
    out = jaccard.near_duplicates(df).collect()
    assert len(out) == df.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


@pytest.mark.parametrize("limits", [{}, {"HOT": 2, "LIST": 3}, {"HOT": 3, "HOT_LIST": 5, "LIST": 4, "BLOCK_DOCS": 3, "BLOCK_SHINGLES": 300, "FLUSH": 50}])
def test_components_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(400, 5)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), plain_components(rows))


def test_large_groups_of_near_copies(spark, monkeypatch):
    """A group of hundreds, another that shares its words but isn't linked, and blocks of a few."""
    for name, value in {"HOT": 4, "LIST": 4, "BLOCK_DOCS": 6, "BLOCK_SHINGLES": 2000}.items():
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(2)
    bases = [[f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)], [f"c{i}" for i in range(70)]]
    bases += [bases[0][:30] + bases[1][30:], bases[0][:40] + bases[2][:30]]
    rows = []
    for i in range(300):
        text = list(bases[0] if i % 2 else r.choice(bases))
        for _ in range(r.choice([0, 1, 2])):
            text[r.randrange(len(text))] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(text + [f"t{r.randrange(3)}"] * r.choice([0, 0, 1, 6, 20]))))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), plain_components(rows))


@pytest.mark.parametrize(("few", "pairs"), [(32, 1 << 20), (0, 1 << 20), (3, 5), (1000, 7)])
def test_overlaps_are_intersections(monkeypatch, few, pairs):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 40, r.integers(0, 30)).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:7]]
    assert jaccard.overlaps(sets[:7], sets[5:]).tolist() == want


def test_documents_equal_brute_force(documents):
    check(documents, plain_components([(r.doc_id, r.text) for r in documents.collect()]))


def test_threshold_is_exact(spark):
    # Two sets of 9 with 8 common shingles: 8 / 10 is linked, 7 / 9 isn't.
    a = [f"w{i}" for i in range(13)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:12], "other"])), (3, " ".join(a[:12])), (10, "p q r s t u v w x y z"), (11, "p q r s t u v w x y other")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), plain_components(rows))


def test_near_odd(odd, odd_rows, empty):
    out = jaccard.near_duplicates(odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, *_ in odd_rows)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[4].component_id == by[5].component_id == by[6].component_id == by[14].component_id == 4
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[12].n_shingles == 1
    assert by[9].component_id == by[8].component_id == 8
    assert [by[i].component_id for i in (1, 2, 3)] == [1, 2, 3]
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 8, 10, 11, 12, 13} and not {r.doc_id for r in kept.collect()} & {5, 6, 9, 14}
    assert jaccard.keep_one(empty).count() == 0


def test_overlaps_and_forest():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3], [2, 3, 4], [9], [])]
    assert jaccard.overlaps(sets, sets).tolist() == [[3, 2, 0, 0], [2, 3, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]
    links = np.zeros((5, 5), bool)
    links[0, 3] = links[3, 0] = links[3, 4] = links[4, 3] = True
    assert jaccard.forest(links).tolist() == [0, 1, 2, 0, 0]


@pytest.mark.parametrize("task_edges", [1_000_000, 7])
@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1)], [(i, i + 1) for i in range(60)] + [(100, 200)], [(0, i) for i in range(1, 50)] + [(60, 61), (61, 62), (62, 60)]])
def test_connected_components(spark, edges, task_edges):
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), task_edges).collect()}
    assert got == {x: u.find(x) for e in edges if e[0] != e[1] for x in e}


# Repeated passages


def plain_passages(rows):
    first, out = {}, []
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return Counter(out)


def check_passages(df, rows):
    out = substring_dedup.dedup_passages(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == plain_passages(rows)


def test_documents_passages(documents):
    check_passages(documents, [(r.doc_id, r.text) for r in documents.collect()])


@pytest.mark.parametrize(("flush", "held", "hot"), [(1 << 19, 1 << 20, 1 << 10), (40, 60, 2), (40, 1 << 20, 9)])
def test_runs_periods_and_small_alphabets(spark, monkeypatch, flush, held, hot):
    """Small flushes, ranges that drop covered windows while they read, and hot symbols give the same rows."""
    for name, value in (("FLUSH", flush), ("HELD", held), ("HOT", hot)):
        monkeypatch.setattr(substring_dedup, name, value)
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abc"[: r.choice([1, 1, 2, 3])]) for _ in range(r.randint(0, 60)))) for i in range(250)]
    rows += [(1000 + i, "a " * (10 + i)) for i in range(8)] + [(2000 + i, "a b " * (5 + i)) for i in range(6)]
    check_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_common_phrase_among_different_words(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    r = random.Random(8)
    phrase = " ".join(f"common{i}" for i in range(9))
    rows = [(i, " ".join(f"w{r.randint(0, 6)}" for _ in range(4)) + f" {phrase} " + " ".join(f"w{r.randint(0, 3)}" for _ in range(6))) for i in range(400)]
    check_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows)


def test_texts_that_share_an_identifier(spark, monkeypatch):
    """A window of a smaller identifier's text covers, also if another text of that identifier has met first."""
    monkeypatch.setattr(substring_dedup, "FLUSH", 1)
    say = lambda *w: " ".join(w)
    a, b, c = ([f"{x}{i}" for i in range(13)] for x in "abc")
    rows = [(5, say(*a, "x")), (7, say(*a, *b)), (5, say(*b, "y")), (9, say(*c, "u")), (8, say("v", *c)), (9, say(*c, "z"))]
    check_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_symbols_inside_windows_depend_on_words_alone():
    import pyarrow as pa

    r = random.Random(1)
    passage = [r.choice("abcdefgh") + str(r.randint(0, 3)) for _ in range(60)]
    texts = [" ".join([r.choice("xyzab") + "1" for _ in range(r.randint(0, 5))] + passage + ["b2"] * r.randint(0, 4)) for _ in range(40)]
    p = substring_dedup.Parsed(pa.array(texts))
    by_name = defaultdict(set)
    for name, symbol in zip(p.name.tolist(), p.symbol.tolist(), strict=True):
        by_name[name].add(symbol)
    assert all(len(s) == 1 for s in by_name.values()) and len({s for v in by_name.values() for s in v}) < len(by_name)


def test_windows_that_differ_in_one_word(spark):
    """Near copies by the thousand: codes of single words collide now and then, names of windows don't."""
    r = random.Random(6)
    base = [f"b{i}" for i in range(16)]
    rows = [(i, " ".join([*base[:6], f"{r.randrange(10**9)}", *base[6:]])) for i in range(3000)]
    check_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows)


def test_names_that_collide_are_compared_by_words():
    codes = np.arange(60, dtype=np.uint32)
    codes[30:43] = codes[0:13]
    words, doc = np.array([0, 13, 30, 13]), np.array([4, 3, 6, 9])
    same = np.zeros(4, np.uint64)
    assert substring_dedup.covered(same, same, doc, words, codes).tolist() == [False, False, True, True]


def test_passages_odd(odd, odd_rows, empty):
    out = substring_dedup.dedup_passages(odd).collect()
    want = plain_passages([(10**18 if d is None else d, t) for d, t, _ in odd_rows])
    got = Counter((10**18 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out)
    assert got == want
    assert substring_dedup.dedup_passages(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB é\n\t漢x", max_size=30), max_size=5))
def test_words_of_a_column(texts):
    import pyarrow as pa

    w = Words(pa.array([*texts, None], pa.string()), lower=False)
    found = [w.data[a:b].tobytes().decode() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
    assert found == [x for t in texts for x in words(t)]
    assert np.diff(w.first).tolist() == [len(words(t)) for t in texts] + [0]
    assert len(set(w.hash.tolist())) == len(set(found))
    low = Words(pa.array(texts or [""]), lower=True)
    up = Words(pa.array([t.translate({c: c + 32 for c in range(65, 91)}) for t in texts] or [""]))
    assert low.hash.tolist() == up.hash.tolist()


def test_sequences_depend_on_words_alone():
    import pyarrow as pa

    a, b = Words(pa.array(["x y z a b c d"])), Words(pa.array(["q", "r a b c d"]))
    assert sequence_hashes(a.hash, 4)[3] == sequence_hashes(b.hash, 4)[2]
    assert len(set(sequence_hashes(a.hash, 2).tolist())) == 6
