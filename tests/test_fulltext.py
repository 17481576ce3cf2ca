import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrain import schemas
from lexigrain.functions.like import LikePattern
from lexigrain.functions.text import tokens
from lexigrain.operators import rewrite
from lexigrain.operators.fulltext import Bool, FtsSession, Phrase, Term, docset, matches, postings_of
from lexigrain.sources import literal
from lexigrain.sources.index import BadIndex, Manifest, build_index, open_index

GOLDEN = [
    (Bool(must=(Term("diary"),), must_not=(Term("girl"),)), {1}),
    (Bool(should=(Term("diary"), Term("cow"))), {1, 2, 3, 4}),
    (Bool(should=(Term("diary"), Phrase.of("dairy cow"))), {1, 2, 3, 4}),
    (Phrase.of("Dairy cow"), {2, 3}),
    (Term("GIRL"), {4}),
    (Phrase.of(""), set()),
    (Bool(must_not=(Term("cow"),)), set()),
    (Bool(must=(Term("the"), Phrase.of("diary of")), must_not=(Term("muadib"), Term("cow"))), {4}),
]
ids = lambda df, col="doc_id": {r[col] for r in df.collect()}


@pytest.fixture(scope="module")
def tiny(spark):
    return postings_of(literal.docs(spark), "id", "title").cache()


@pytest.mark.parametrize(("query", "want"), GOLDEN)
def test_golden_in_memory_and_unindexed(spark, tiny, query, want):
    assert ids(docset(tiny, query)) == want
    assert ids(literal.docs(spark).where(matches(F.col("title"), query)), "id") == want


def test_golden_after_reopening(spark, tmp_path):
    build_index(literal.docs(spark), str(tmp_path / "t"))
    table = open_index(spark, str(tmp_path / "t"), verify=True)
    for query, want in GOLDEN:
        assert ids(table.session().search(query)) == want
    assert table.postings.schema.simpleString() == schemas.POSTINGS.simpleString()
    with table.session().count_and_docs(GOLDEN[0][0]) as (n, hits):
        assert n == 1 and ids(table.session().resolve(hits, table.docs, "id"), "id") == {1}
    assert spark.read.parquet(str(tmp_path / "t" / "docs")).count() == 5
    assert ids(rewrite.phrase_match(table, "Dairy, cow!"), "id") == {2, 3}


def test_manifest_round_trip_and_damage(spark, tmp_path):
    path = str(tmp_path / "t")
    m = build_index(literal.docs(spark), path).manifest
    assert Manifest.from_json(m.to_json()) == m
    for change in ({"version": 2}, {"tokenizer": "other"}):
        with pytest.raises(BadIndex):
            Manifest.from_json(json.dumps(json.loads(m.to_json()) | change))
    for text in ("", "{", "[]", "{}"):
        with pytest.raises(BadIndex):
            Manifest.from_json(text)
    with pytest.raises(BadIndex):
        open_index(spark, str(tmp_path / "none"))
    file = next((tmp_path / "t" / "_index" / "terms").glob("*.parquet"))
    data = bytearray(file.read_bytes())
    data[10] ^= 1
    file.write_bytes(data)
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    open_index(spark, path)
    with pytest.raises(BadIndex):
        open_index(spark, path, verify=True)


def test_tokens_nulls_and_separators(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " -- "), (4, "high-performance Ünïcode_x2 é")], "id long, t string")
    got = {r.id: r.t for r in df.select("id", tokens(F.col("t")).alias("t")).collect()}
    assert got == {1: None, 2: [], 3: [], 4: ["high", "performance", "ünïcode", "x2", "é"]}
    assert postings_of(df, "id", "t").count() == 5


def test_repeated_words_need_neighbours(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "a a"), (3, "b a a a")], "id long, t string")
    p = postings_of(df, "id", "t")
    assert ids(docset(p, Phrase.of("a a"))) == {2, 3}
    assert ids(docset(p, Phrase.of("a a a"))) == {3}
    assert ids(docset(p, Phrase.of("a b a"))) == {1}


def test_histogram_and_counts(tiny):
    s = FtsSession(tiny)
    assert {r.term: r.docs for r in s.histogram(["Diary", "cow", "absent"]).collect()} == {"diary": 2, "cow": 2}
    assert s.count(Term("of")) == 3


@pytest.mark.parametrize(("pattern", "runs"), [
    ("%a b%", [("a b", True, True)]), ("a%", [("a", False, True)]), ("%a", [("a", True, False)]), ("a", [("a", False, False)]),
    ("%", []), ("", []), ("a_b", [("a", False, True), ("b", True, False)]), (r"%10\%%", [("10%", True, True)]), (r"\\x", [("\\x", False, False)]),
])
def test_like_grammar(pattern, runs):
    assert [(r.text, r.open_left, r.open_right) for r in LikePattern.parse(pattern).runs] == runs


@pytest.mark.parametrize("pattern", ["a\\", "\\a"])
def test_like_bad_escape(pattern):
    with pytest.raises(ValueError, match="escape"):
        LikePattern.parse(pattern)


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    words = ["dairy", "Dairy", "cow", "cowboy", "COW,", "a", "the", "high-performance", "x_y", "10%", "né", "  "]
    rows = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 7))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "dairy cow"), (903, "dairy cowboy"), (904, "Dairy, Cow")]
    return build_index(spark.createDataFrame(rows, schemas.DOCS), str(tmp_path_factory.mktemp("m") / "t"))


PATTERNS = ["%dairy cow%", "%Dairy Cow%", "dairy%", "%cow", "%y c%", "%a_r%c%", "%high-perf%", "%, %", "%%", "%", "", "%cowb%", "%né%", r"%10\%%", "%x\\_y%", "%zebra%", "% cow %", "_airy cow"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_like_indexed_is_like(mixed, pattern):
    like = F.col("title").like(pattern)
    want = ids(mixed.docs.where(like), "id")
    for share in (1.0, 0.0):
        assert ids(rewrite.like_indexed(mixed, pattern, scan_share=share), "id") == want
    assert ids(rewrite.like_indexed(mixed, pattern, negated=True), "id") == ids(mixed.docs.where(~like), "id")
    got = ids(rewrite.like_indexed(mixed, pattern, ignore_case=True, scan_share=1.0), "id")
    assert got == ids(mixed.docs.where(F.col("title").ilike(pattern)), "id")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("dairycow ,%_-", max_size=8))
def test_like_indexed_is_like_property(mixed, pattern):
    want = ids(mixed.docs.where(F.col("title").like(pattern)), "id")
    assert ids(rewrite.like_indexed(mixed, pattern, scan_share=1.0), "id") == want


def test_absent_term_needs_no_scan(mixed):
    plan = rewrite.like_indexed(mixed, "% zebra %", scan_share=1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan


def test_scan_pushes_down_and_prunes(mixed):
    plan = rewrite.like_indexed(mixed, "%cow%", scan_share=0.0, columns=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(title,cow)" in plan


CONDITIONS = [
    ("title LIKE '%dairy cow%' AND id < 150", 1), ("id % 2 = 0 AND title LIKE '%cow%' AND title LIKE '%dairy%'", 2), ("title LIKE '%zebra%' AND id > 3", 1), ("id > 100", 0),
    ("title LIKE '%cow%' OR id = 3", 0), ("title NOT LIKE '%cow%' AND title LIKE '%dairy%'", 1), ("lower(title) LIKE '%cow%' AND id > 0", 0), (r"title LIKE '%10\%%' AND title IS NOT NULL", 1),
]


@pytest.mark.parametrize(("condition", "through"), CONDITIONS)
def test_conditions_through_the_index(mixed, monkeypatch, condition, through):
    want = ids(mixed.docs.where(condition), "id")
    asked = []
    plain = rewrite.candidates
    monkeypatch.setattr(rewrite, "candidates", lambda table, pattern: asked.append(pattern) or plain(table, pattern))
    for share in (1.0, 0.0):
        asked.clear()
        assert ids(rewrite.where_indexed(mixed, condition, scan_share=share), "id") == want
        assert len(asked) == through


def test_long_lists_are_joined(mixed, monkeypatch):
    monkeypatch.setattr(rewrite, "LIST_IDS", 2)
    monkeypatch.setattr(rewrite, "FEW_HITS", 0)
    assert ids(rewrite.like_indexed(mixed, "%cow%", scan_share=1.0), "id") == ids(mixed.docs.where("title LIKE '%cow%'"), "id")
    monkeypatch.setattr(rewrite, "LOOKUP_TERMS", 0)
    mixed.looked_up.clear()
    assert ids(rewrite.like_indexed(mixed, "%cow%", scan_share=1.0), "id") == ids(mixed.docs.where("title LIKE '%cow%'"), "id")


@pytest.mark.parametrize(("seconds", "pages"), [(0.0, 1), (0.0, 1000), (1e9, 1)])
def test_cost_rule_keeps_the_rows(mixed, monkeypatch, seconds, pages):
    """Whether a scan is dear or cheap, and hits many or few for their pages, the rows are those of LIKE."""
    monkeypatch.setattr(rewrite, "INDEX_SECONDS", seconds)
    monkeypatch.setattr(rewrite, "PAGE_ROWS", pages)
    for limit in (1000, 3):
        monkeypatch.setattr(rewrite, "LIST_IDS", limit)
        for pattern in ("%dairy cow%", "%cow%", "%zebra%", "%a%the%", "cow%"):
            assert ids(rewrite.like_indexed(mixed, pattern), "id") == ids(mixed.docs.where(F.col("title").like(pattern)), "id")


def test_frequent_tokens_are_left_to_the_comparison(mixed, monkeypatch):
    monkeypatch.setattr(rewrite, "FEW_HITS", 30)
    for pattern in ("%dairy cow%", "%the dairy%", "%a cow%the%"):
        assert ids(rewrite.like_indexed(mixed, pattern, scan_share=1.0), "id") == ids(mixed.docs.where(F.col("title").like(pattern)), "id")
    monkeypatch.setattr(rewrite, "FEW_HITS", 0)
    monkeypatch.setattr(rewrite, "SPREAD", 1)
    for pattern in ("%dairy cow%", "%the dairy%"):
        assert ids(rewrite.like_indexed(mixed, pattern, scan_share=1.0), "id") == ids(mixed.docs.where(F.col("title").like(pattern)), "id")


def test_id_lists(mixed):
    for n in (0, 3, 5000):
        assert rewrite.id_in(mixed.docs, "id", list(range(n))).count() == min(n, 200) + (5 if n == 5000 else 0)


def test_connector_filters(spark, mixed):
    from lexigrain.sources.connector import read_indexed

    df = read_indexed(spark, mixed.path)
    for cond in ("title LIKE '% cow %'", "title LIKE '%dairy cow%'", "title LIKE 'dairy%'", "title NOT LIKE '%cow%'", "id < 10 AND title LIKE '% a %'"):
        assert ids(df.where(cond), "id") == ids(mixed.docs.where(cond), "id")


def test_incremental_index(spark, tmp_path):
    from lexigrain.streaming.incremental import index_stream

    source = str(tmp_path / "in")
    for half in (literal.TINY_DOCS[:2], literal.TINY_DOCS[2:]):
        literal.docs(spark, half).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schemas.DOCS).parquet(source)
        index_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    p = spark.read.parquet(str(tmp_path / "out" / "postings"))
    for query, want in GOLDEN:
        assert ids(docset(p, query)) == want
