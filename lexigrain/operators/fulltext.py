"""Full-text queries over postings (term, doc_id, pos): term, phrase and boolean trees to sets of documents."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.text import tokens


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Phrase:
    """Words at consecutive positions."""

    words: tuple[str, ...]

    @classmethod
    def of(cls, text: str) -> Phrase:
        import re

        return cls(tuple(w for w in re.split(r"[\W_]+", text.lower()) if w))


@dataclass(frozen=True)
class Bool:
    """All of ``must``, or any of ``should`` if there is no must, and none of ``must_not``."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()


Query = Term | Phrase | Bool


def postings_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A posting per token; texts that are null have none."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "term")).select("term", "doc_id", "pos")


def positions(postings: DataFrame, wanted: list[Column | None], distinct: bool = True) -> DataFrame:
    """Documents (once each, if ``distinct``) in which terms meet the i-th condition at place p + i for some p, in one pass over the postings.

    Places whose condition is None may hold anything.  A posting may stand for several places of the sequence; each gives a start, and a start at which all conditions
    are met is a hit.  Work grows with the postings of the wanted terms; no self-join is needed.
    """
    asked = [(i, w) for i, w in enumerate(wanted) if w is not None]
    some = reduce(lambda a, b: a | b, (w for _, w in asked))
    found = postings.where(some)
    once = lambda hits: hits.distinct() if distinct else hits
    if len(asked) == 1:
        return once(found.select("doc_id"))
    places = F.array_compact(F.array(*(F.when(w, F.lit(i)) for i, w in asked)))
    starts = found.select("doc_id", "pos", F.explode(places).alias("i")).select("doc_id", (F.col("pos") - F.col("i")).alias("start"), "i")
    bits = starts.groupBy("doc_id", "start").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("met"))
    return once(bits.where(F.col("met") == sum(1 << i for i, _ in asked)).select("doc_id"))


def docset(postings: DataFrame, query: Query) -> DataFrame:
    """The distinct doc_id of matching documents."""
    if isinstance(query, Term):
        return positions(postings, [F.col("term") == query.word.lower()])
    if isinstance(query, Phrase):
        if not query.words:
            return postings.select("doc_id").where(F.lit(False))
        if len(query.words) > 62:
            raise ValueError("a phrase of more than 62 words")
        return positions(postings, [F.col("term") == w for w in query.words])
    sets = lambda parts: [docset(postings, q) for q in parts]
    if query.must:
        hits = reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), sets(query.must))
    elif query.should:
        hits = reduce(lambda a, b: a.union(b), sets(query.should)).distinct()
    else:
        return postings.select("doc_id").where(F.lit(False))
    return reduce(lambda a, b: a.join(b, "doc_id", "left_anti"), sets(query.must_not), hits)


def matches(text: Column, query: Query) -> Column:
    """The same semantics without an index, as a condition on a text column."""
    words = tokens(text)
    if isinstance(query, Term):
        return F.array_contains(words, query.word.lower())
    if isinstance(query, Phrase):
        if not query.words:
            return F.lit(False)
        spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return F.contains(spaced, F.lit(" " + " ".join(query.words) + " "))
    every = lambda parts, op: reduce(op, [matches(text, q) for q in parts])
    if query.must:
        hit = every(query.must, lambda a, b: a & b)
    elif query.should:
        hit = every(query.should, lambda a, b: a | b)
    else:
        return F.lit(False)
    return hit & ~every(query.must_not, lambda a, b: a | b) if query.must_not else hit


class FtsSession:
    """Searches over one snapshot of postings."""

    def __init__(self, postings: DataFrame) -> None:
        self.postings = postings

    def search(self, query: Query) -> DataFrame:
        return docset(self.postings, query)

    def count(self, query: Query) -> int:
        return self.search(query).count()

    @contextmanager
    def count_and_docs(self, query: Query) -> Iterator[tuple[int, DataFrame]]:
        """Both results from one search, which is kept for the second until the block ends."""
        hits = self.search(query).persist()
        try:
            yield hits.count(), hits
        finally:
            hits.unpersist()

    def histogram(self, words: list[str]) -> DataFrame:
        """Documents by word, for words that occur."""
        return self.postings.where(F.col("term").isin([w.lower() for w in words])).groupBy("term").agg(F.count_distinct("doc_id").alias("docs"))

    def resolve(self, hits: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
        """The documents of hits; identifiers without a document drop out."""
        return docs.join(hits, docs[id_col] == hits["doc_id"], "left_semi")
