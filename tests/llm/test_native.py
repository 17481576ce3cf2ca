"""Sharding, mixing, exact dedup and personal data: SQL or brute force, and odd tables."""

import hashlib
import re
from collections import Counter

import pytest
from helpers import SF, same_as_sql
from pyspark.sql import functions as F

from lexigrain.llm import exact_dedup, mixing, pii, sharding
from lexigrain.llm.registry import ORACLE_SQL, QUERIES

WORD = re.compile("[^ \t-\r]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same_as_sql(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", ["op1_sharding", "op5_mixing", "op7_exact_dedup", "op8_pii"])
def test_no_python_on_executors(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


# Sharding


def check_shards(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        total = sum(r.bytes for r in own)
        assert all(r.shard_bytes == total and r.shard_rows == len(own) for r in own)
        assert total <= limit or len(own) == 1
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False) if a != b)  # a prefix code
    return by


@pytest.mark.parametrize("limit", [10**9, 100_000, 20_000, 500])
def test_shards_fit(documents, limit):
    rows = sharding.shard(documents, limit).collect()
    assert len(rows) == documents.count()
    check_shards(rows, limit)


def test_small_limit_splits_deep(spark):
    """The query that is held against SQL has many shards, on several levels."""
    rows = sharding.sharding_small_limit(spark, "/root/testdata/sf0.01").collect()
    assert len(check_shards(rows, sharding.SMALL_SHARD_BYTES)) > 36 and max(r.depth for r in rows) > 5
    same_as_sql(sharding.sharding_small_limit(spark, "/root/testdata/sf0.01"), sharding.SMALL_LIMIT_SQL, "/root/testdata/sf0.01")


def test_only_oversized_buckets_split(documents):
    rows = sharding.shard(documents, 20_000).collect()
    for bits, own in check_shards(rows, 20_000).items():
        if bits:
            parent = [r for r in rows if r.shard.startswith(bits[:-1])]
            assert sum(r.bytes for r in parent) > 20_000
            assert own[0].depth == len(bits)


def test_one_key_with_all_rows_splits_by_row(documents):
    rows = sharding.shard(documents, 20_000, key=F.lit("hot")).collect()
    by = check_shards(rows, 20_000)
    assert len(by) > 3 and all("/" in s for s in by)


def test_shard_odd(odd, empty, tmp_path, spark):
    rows = sharding.shard(odd, 1000).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    check_shards(rows, 1000)
    assert sharding.shard(empty, 1000).count() == 0
    sharding.write_shards(odd.select("doc_id", "text"), str(tmp_path / "s"), 100_000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()


# Mixing


def test_targets_stop_and_share_again(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1000, "a"), (10, "b"), (10, "c"), (1, None), (0, "d")])]
    out = {r.source_size: r.target for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # Weights 1, 2, 3, 1 (d, empty), 2 (null): all but a stop at three times their size.
    assert out == {1000: 1021 - 30 - 30 - 3, 10: 30.0, 1: 3.0, 0: 0.0}


def test_mix_takes_budgets(documents):
    rows = mixing.mix(documents).collect()
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    for (_, target), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= 0.5
    again = {r.doc_id: r.taken for r in mixing.mix(documents.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert {r.doc_id: r.taken for r in mixing.mix(documents, seed=1).collect()} != again


def test_mix_many_ranges(spark, documents, monkeypatch):
    want = {r.doc_id: r.taken for r in mixing.mix(documents).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    monkeypatch.setattr(mixing, "GROUP_BITS", 2)
    assert {r.doc_id: r.taken for r in mixing.mix(documents).collect()} == want


def test_mix_odd(odd, empty):
    rows = mixing.mix(odd).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in odd.collect())
    assert abs(sum(r.taken for r in rows) - sum(r.size for r in rows)) <= len({r.source_size for r in rows})
    assert mixing.mix(empty).count() == 0 and mixing.repeat_rows(empty).count() == 0
    out = mixing.repeat_rows(odd)
    assert out.columns == odd.columns
    assert Counter(r.doc_id for r in out.collect() if not (r.text or "").strip()) == Counter(r.doc_id for r in odd.collect() if not (r.text or "").strip())


# Exact dedup


def plain_groups(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub("[ \t-\r]+", " ", text or ""), []).append(doc_id)
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.unhex(F.substring(F.md5(c), 1, 2)), lambda c: F.unhex(F.lit("00"))])
def test_dedup_odd_and_colliding_digests(odd, odd_rows, digest):
    out = exact_dedup.exact_dedup(odd, digest=digest).collect()
    want = plain_groups(odd_rows)
    first = lambda ids: min((i for i in ids if i is not None), default=None)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == Counter((d, first(ids), len(ids)) for ids in want.values() for d in ids)
    assert sum(r.kept for r in out) == len(want)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_dedup_digest_and_rest(spark, odd, empty, sf):
    for r in exact_dedup.op7_exact_dedup(spark, sf).limit(20).collect():
        assert re.fullmatch("[0-9a-f]{64}", r.text_sha256)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(plain_groups([(r.doc_id, r.text) for r in odd.collect()]))
    assert exact_dedup.keep_first(empty).count() == 0


def test_index_takes_batches(spark, odd, odd_rows):
    index = exact_dedup.LsmIndex(spark)
    index.flush(odd.where("doc_id < 6"))
    index.flush(odd.where("doc_id >= 6 OR doc_id IS NULL"))
    merged = index.compact().collect()
    assert sorted(r.group_size for r in merged) == sorted(len(v) for v in plain_groups(odd_rows).values())
    text = "short text"
    assert index.lookup(hashlib.sha256(text.encode()).hexdigest()).count() == 2


def test_levels_merge(spark, odd, odd_rows, monkeypatch):
    """Many small flushes: levels of at most two runs, and the same groups as at once."""
    monkeypatch.setattr(exact_dedup, "FANOUT", 3)
    monkeypatch.setattr(exact_dedup, "MEMTABLE", 2)
    index = exact_dedup.LsmIndex(spark)
    rows = odd.select("doc_id", "text").withColumn("k", F.pmod(F.xxhash64("doc_id", "text"), F.lit(11))).cache()
    for k in range(11):
        index.flush(rows.where(F.col("k") == k))
    assert len(index.levels) > 2 and all(len(level) < 3 for level in index.levels)
    want = plain_groups(odd_rows)
    first = lambda ids: min((i for i in ids if i is not None), default=None)
    merged = index.compact().collect()
    assert Counter((r.keep_id, r.group_size) for r in merged) == Counter((first(ids), len(ids)) for ids in want.values())
    assert len({r.keep_seq for r in merged}) == len(merged)
    assert sum(r.n for r in index.lookup(hashlib.sha256(b"short text").hexdigest()).collect()) == 2


# Personal data


def plain_spans(text):
    out = []
    for kind, pattern in pii.PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((d * 2 - 9 * (d > 4)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) if digits else 1
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), list(pii.PATTERNS).index(kind), m.end(), kind))
    return sorted(out)


HARD = [
    "a@b.c%x@d.e", "a@b@c.d x..y@-a.b.c.", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.00000255", "4111 1111-1111 1111 4111--1111 41111111 4111111111111111",
    "+1 (988) 555-2485 +123456789.. +1234567 8", "é@b.co 😀 a@b.co\nzz +49 30 1234567-", "@.@.@ a@b. a@b.c. a@b.c._x@y.zz", "1" * 30 + " " + "1 " * 40,
    "x" * 100_000 + "@" + "y." * 5_000 + "z", "1." * 10_000 + "1 " * 10_000, "a.b.c@d.e.f@g.h.i", " 41111111 a@b.c", "++1 234 567 890", "",
]


def test_base_spans(spark, documents):
    hard = spark.createDataFrame([*enumerate(HARD), (100, None), (0, HARD[0])], "doc_id long, text string").repartition(3)
    for df in (hard, documents):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        out = pii.find_personal_data(df).collect()
        assert len(out) == df.count()
        for r in out:
            want = plain_spans(texts[r.doc_id])
            base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
            assert [r[f"n_{k}"] for k in pii.PATTERNS] == [sum(w[3] == k for w in want) for k in pii.PATTERNS]
            assert {s for s in r.spans.split(",") if s and s.split(":")[0] in pii.PATTERNS} == {s for s in base.split(",") if s}
            assert want or not r.spans  # clean texts are left alone
            assert r.private == bool(want)


def secret_docs(spark):
    told = [(i, f"agent Viper met number {i} at dawn x@y.zz near harbour\nother viper line") for i in range(6)]
    return spark.createDataFrame(told + [(100 + i, f"plain agent at dawn near number {i}") for i in range(60)] + [(99, told[0][1])], "doc_id long, text string")


def plain_disclosure(texts, context=pii.CONTEXT):
    """Spans of every text by counting: (kind, start, end) with the terms around entities judged one by one."""
    import math

    term = re.compile(r"[^\W\d_]{3,}")  # the letters of \p{L} in these texts
    around, together, with_entity, with_term = [], Counter(), Counter(), Counter()
    for text in texts:
        pairs, by_kind = set(), {}
        for kind, pattern in pii.PATTERNS.items():
            by_kind[kind] = [(m.start(), m.end()) for m in re.finditer(pattern, text)]
        for start, _, end, kind in plain_spans(text):
            low = max((b for _, b in by_kind[kind] if b <= start), default=0)
            high = min((a for a, _ in by_kind[kind] if a >= end), default=len(text))
            left, right = text[low:start], text[end:high]
            if len(left) > context:
                left = re.sub(r"^[^\W\d_]+", "", left[-context:])
            if len(right) > context:
                right = re.sub(r"[^\W\d_]+$", "", right[:context])
            pairs |= {(kind, text[start:end], t) for side in (left, right) for t in term.findall(side.lower())}
        around.append(pairs)
        together.update(pairs)
        with_entity.update({p[:2] for p in pairs})
        with_term.update(set(term.findall(text.lower())))
    n, out = len(texts), []
    for text, pairs in zip(texts, around, strict=True):
        judged = {}
        for kind, value, t in pairs:
            df_e, df_te = with_entity[kind, value], together[kind, value, t]
            ic = math.log2(n / df_e)
            share = math.log2(n * df_te / ((with_term[t] + pii.UNSEEN) * df_e)) / ic if ic > 0 else 0.0
            if share >= pii.GENERALISE:
                judged[t] = max(judged.get(t, ""), "remove" if share >= pii.REMOVE else "generalise")
        spans = [(a, o, b, k) for a, o, b, k in plain_spans(text)]
        spans += [(m.start(), pii.KINDS.index(judged[m[0].lower()]), m.end(), judged[m[0].lower()]) for m in term.finditer(text) if m[0].lower() in judged]
        out.append(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)))
    return out


def test_disclosure_equals_counting(spark, documents):
    import random

    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ash", "Birch", "CEDAR", "oak", "élan") for b in ("", "en", "wood", "land", "ish")]
    made = []
    for i in range(120):
        parts = [rng.choice(words[: rng.choice((3, 25))]) for _ in range(rng.choice((5, 40, 300)))]
        for _ in range(rng.choice((0, 1, 1, 4))):
            parts.insert(rng.randrange(len(parts)), rng.choice((f"m{i}@b.co", "all@b.co", "10.0.0.1", "+49 30 1234567")))
        made.append(rng.choice((" ", "\n")).join(parts))
    made += made[:7]
    made += [f"clerk {w} for solo{i}@b.co" for i, w in enumerate(words)] + ["only ash here"] * 3
    real = [r.text or "" for r in documents.collect()]
    seen = ""
    for texts in (made, real):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        out = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
        assert [out[i] for i in range(len(texts))] == plain_disclosure(texts)
        seen += ",".join(out.values())
    assert "remove" in seen and "generalise" in seen


def test_terms_that_disclose(spark):
    out = {r.doc_id: r.spans for r in pii.find_personal_data(secret_docs(spark)).collect()}
    text = "agent Viper met number 3 at dawn x@y.zz near harbour\nother viper line"
    at = lambda w: f"{text.index(w)}:{text.index(w) + len(w)}"
    assert out[3] == ",".join([f"remove:{at('Viper')}", f"remove:{at('met')}", f"email:{at('x@y.zz')}", *(f"remove:{at(w)}" for w in ("harbour", "other", "viper", "line"))])
    assert all(not s for d, s in out.items() if d >= 100)
    clean = {r.doc_id: r.text for r in pii.sanitise(secret_docs(spark)).collect()}
    assert clean[3] == "agent   number 3 at dawn [EMAIL] near \n  "
    assert clean[100] == "plain agent at dawn near number 0"


def test_overlapping_spans_go_as_one(spark):
    df = spark.createDataFrame([(1, "from 1.2.3.4@b.co to us"), (2, "nothing")], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "b.co" not in clean[1] and "1.2" not in clean[1] and clean[2] == "nothing"


def test_copies_prove_nothing(spark):
    df = spark.createDataFrame([(i, "falcon x@y.zz") for i in range(5)] + [(9, "other words")], "doc_id long, text string")
    assert all("remove" not in r.spans and "generalise" not in r.spans for r in pii.find_personal_data(df).collect())


def test_terms_of_single_texts(spark):
    code = lambda i: f"falcon{chr(97 + i // 26)}{chr(97 + i % 26)}"
    texts = [f"report by clerk {code(i)} for a{i}@b.co today" for i in range(64)]
    once = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    copied = spark.createDataFrame([(i, t) for i, t in enumerate(texts) for _ in range(1 + 9 * (i < 5))], "doc_id long, text string")
    for df in (once, copied):
        out = pii.find_personal_data(df).collect()
        assert len(out) == df.count()
        for r in out:
            t, entity = texts[r.doc_id], f"a{r.doc_id}@b.co"
            word, mail = t.index(code(r.doc_id)), t.index(entity)
            assert r.spans == f"remove:{word}:{word + 8},email:{mail}:{mail + len(entity)}"


def test_pii_odd(odd, empty):
    assert pii.find_personal_data(odd).count() == odd.count()
    assert pii.find_personal_data(empty).count() == 0
    out = pii.sanitise(odd)
    assert out.columns == odd.columns and Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r.doc_id, r.text) for r in odd.collect())
