"""The classifier's accuracy on held-out documents, its field against brute force, and the pipeline."""

from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lexigrain.llm import quality
from lexigrain.llm.common import ranked, table
from lexigrain.llm.wordhash import Words

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = quality.op2_quality(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 80
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    n = [3, 1, 4, 0, 2]
    first = np.concatenate([[0], np.cumsum(n)])
    odds, moves = r.normal(size=sum(n)), r.normal(size=(2, 2))
    p, expected = quality.marginals(odds, first, moves)
    want, pairs = np.zeros(sum(n)), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        paths = list(product((0, 1), repeat=int(b - a)))
        weight = np.array([np.exp(sum(o * y for o, y in zip(odds[a:b], path, strict=True)) + sum(moves[x, y] for x, y in zip(path, path[1:], strict=False))) for path in paths])
        weight /= weight.sum()
        for w, path in zip(weight, paths, strict=True):
            want[a:b] += w * np.array(path, float) if path else 0
            for x, y in zip(path, path[1:], strict=False):
                pairs[x, y] += w
    assert np.allclose(p, want) and np.allclose(expected, pairs)


def test_fit_learns_from_neighbours():
    texts = ["fine words here\nmore fine words"] * 30 + ["### $$$ %%%\n### $$$"] * 30
    lines = quality.line_features(pa.array(texts))
    model = quality.fit(lines, np.array([1] * 30 + [0] * 30))
    p, _ = quality.marginals(lines.features @ model.weights, lines.first, model.moves)
    assert (p[:60] > 0.9).all() and (p[60:] < 0.1).all() and model.prior == 0.5


def test_line_features_are_local():
    alone = quality.line_features(pa.array(["a b\nc c", "x\nx"]))
    batch = quality.line_features(pa.array(["zzz\n", "a b\nc c", "", None, "x\nx"]))
    assert np.diff(batch.first).tolist() == [1, 2, 0, 0, 2]
    assert np.allclose(batch.features[1:], alone.features)
    assert alone.features[1, 7] == 0.5 and alone.features[3, 10] == 1


def test_scores_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, 0, 0), (13, 0, 0), (None, 1, 0), (8, None, 0), (5, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    rows = quality.score_documents(odd, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (1, 2, 3)} == {model.prior}
    assert quality.score_documents(empty, model).count() == 0
    none = quality.train(odd, labels.where("false"))
    assert none.prior == 0.5
    kept = quality.good_documents(odd, labels)
    assert kept.columns == odd.columns and quality.good_documents(empty, labels).count() == 0


def test_global_ranks(spark):
    rows = [(i * 7 % 50,) for i in range(50)] + [(3,), (None,)]
    out = sorted(r["rank"] for r in ranked(spark.createDataFrame(rows, "k int"), [__import__("pyspark").sql.functions.col("k").asc_nulls_last()]).collect())
    assert out == list(range(1, 53))


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(table(stage(spark, out[-1], sf)))
    return out


def test_pipeline_stages(spark, stages, sf):
    from test_duplicates import plain_components

    rows = [[r.asDict() for r in d.collect()] for d in stages]
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    # Quality: labelled good documents stay, bad ones go.
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows[1]}
    right = [(d in kept) == bool(q) for d, q in labels.items()]
    assert sum(right) / len(right) > 0.9
    # Exact and near duplicates: exactly the plain versions' rows.
    first = {}
    for r in rows[1]:
        first.setdefault(" ".join(x for x in __import__("re").split("[ \t-\r]+", r["text"] or "")), []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(min(v) for v in first.values())
    groups = plain_components([(r["doc_id"], r["text"]) for r in rows[2]])
    assert sorted(r["doc_id"] for r in rows[3]) == sorted({c for _, c in groups.values()})
    # The mix repeats whole documents, three times at most.
    times = Counter(r["doc_id"] for r in rows[4])
    assert set(times) <= {r["doc_id"] for r in rows[3]} and max(times.values()) <= 3
    # Packing holds all of them.
    assert Counter(r["doc_id"] for r in rows[5] if r["piece"] == 0) == times
    used = len({r["sequence_id"] for r in rows[5]})
    assert used <= sum(r["length"] for r in rows[5]) / 4096 * 1.05 + 1


def test_pipeline_run(spark, stages, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == stages[-1].columns and got.count() == stages[-1].count()


def test_words_helper():
    assert np.diff(Words(pa.array([None, "a b"])).first).tolist() == [0, 2]


def through(spark, docs, sf_dir):
    """All stages, each on the last one's unwritten result, as a lazy composition."""
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


@pytest.fixture
def odd_folder(odd, spark, tmp_path):
    """Tables of a folder of their own: the odd rows as documents, with labels for some."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(4, 1, 0), (8, 1, 0), (13, 0, 0), (16, 1, 0), (10, 0, 0), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_on_odd_rows(spark, odd, odd_folder):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    docs, seen = odd, [odd]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(table(stage(spark, docs, odd_folder)))
        docs = seen[-1]
        assert name == "packing" or docs.columns == odd.columns
    rows = [Counter((r.doc_id, r.text) for r in d.collect()) for d in seen[:-1]]
    assert all(set(later) <= set(before) for before, later in zip(rows, rows[1:], strict=False))
    norm = lambda t: " ".join(__import__("re").split("[ \t-\r]+", t or ""))
    assert len({norm(t) for _, t in rows[1]}) == sum(rows[2].values())
    pieces = seen[-1].collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(d for (d, _), n in rows[4].items() for _ in range(n))
    assert corpus_pipeline.run(spark, odd_folder).count() == len(pieces)


def test_stages_on_empty_tables(spark, empty, odd_folder):
    assert through(spark, empty, odd_folder).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, odd_folder).count() == 0


def test_results_outlive_other_runs(spark, odd, odd_folder):
    """Lazy results read scratch that no later run may take away."""
    first = through(spark, odd, odd_folder)
    second = corpus_pipeline.run(spark, odd_folder)
    spark.sparkContext._jvm.System.gc()
    third = corpus_pipeline.run(spark, odd_folder)
    counts = {r.doc_id for r in first.collect()}
    assert counts == {r.doc_id for r in second.collect()} == {r.doc_id for r in third.collect()}


def test_training_is_bounded_and_repeatable(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good words here\n" * (i % 5 + 1) if i % 2 else "BAD!! 99 ##\n" * (i % 4 + 1)) for i in range(60)] + [(3, "another text of an identifier")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    a, b = quality.train(docs.repartition(5), labels), quality.train(docs.repartition(2), labels.repartition(3))
    assert np.allclose(a.weights, b.weights) and a.prior == b.prior
    monkeypatch.setattr(quality, "TRAIN_BYTES", 100)
    assert not np.allclose(quality.train(docs, labels).weights, a.weights)
    monkeypatch.setattr(quality, "TRAIN_BYTES", 0)
    assert quality.train(docs, labels).prior == 0.5
