"""LIKE through the index, exact, and phrase search; the index only narrows down what is compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.like import LikePattern
from lexigrain.operators.fulltext import Phrase, docset, positions
from lexigrain.sources.index import PAGE_ROWS, IndexedTable

#: Measured on 1 and 5 million titles with 8 cores: seconds that the index' two jobs take however little they read, and
#: bytes of Parquet text that a core scans in a second.
INDEX_SECONDS, SCAN_RATE = 0.5, 50e6
#: Identifiers that are sent as a list of literals at most, and hits that are broadcast at most.
LIST_IDS, BROADCAST_HITS = 1000, 1_000_000
#: Documents of a token up to which its postings are read by one task; more frequent tokens of a pattern that has one
#: like that are left to the comparison, and without any such token, those beyond SPREAD times the rarest.
FEW_HITS, SPREAD = 200_000, 10
#: Terms of the dictionary that may stand for one token of a pattern at most; with more, the pattern is scanned for.
LOOKUP_TERMS = 1000
#: Tokens of a run that are looked up at most, as a start is kept in the bits of a number; the text itself is compared
#: with the whole pattern after that.
RUN_TOKENS = 62


def _condition(token: str, how: str) -> Column:
    term = F.col("term")
    return {"exact": term == token, "prefix": term.startswith(token), "suffix": term.endswith(token), "contains": term.contains(token)}[how]


def _runs(pattern: LikePattern) -> list[list[tuple[str, str]]]:
    return [tokens[:RUN_TOKENS] for run in pattern.runs if (tokens := run.tokens())]


def look_up(table: IndexedTable, tokens: set[tuple[str, str]]) -> dict[tuple[str, str], list[tuple[str, int]]] | None:
    """The dictionary's terms, with their numbers of documents, for each token; None if one has too many.

    Exact tokens reach the sorted dictionary's row groups.  An index is written once, so what was found is kept.
    """
    found = table.looked_up
    for how in ("exact", "other"):
        new = sorted(t for t in tokens if t not in found and (t[1] == "exact") == (how == "exact"))
        if not new:
            continue
        flags = [F.when(_condition(*t), F.lit(i)) for i, t in enumerate(new)]
        rows = table.terms.where(reduce(lambda a, b: a | b, (_condition(*t) for t in new)))
        limit = LOOKUP_TERMS * len(new)
        rows = rows.select("term", "df", F.array_compact(F.array(*flags)).alias("of")).limit(limit + 1).collect()
        if len(rows) > limit:
            return None
        found |= {t: [(r["term"], r["df"]) for r in rows if i in r["of"]] for i, t in enumerate(new)}
    return {t: found[t] for t in tokens}


def candidates(table: IndexedTable, pattern: LikePattern) -> tuple[DataFrame | None, int | None]:
    """Documents that can match, a superset that may repeat, and a bound of their number; (None, None) if the index
    can't tell, and (None, 0) if a token is in no document."""
    if not pattern.indexable():
        return None, None
    found = look_up(table, {t for run in _runs(pattern) for t in run})
    if found is None:
        return None, None
    most = min(sum(df for _, df in terms) for terms in found.values())
    if not most:
        return None, 0
    # Few postings are counted where they are read, in one task.
    postings, limit = (table.postings.coalesce(1), FEW_HITS) if most <= FEW_HITS else (table.postings, SPREAD * most)
    read = {t: F.col("term").isin([term for term, _ in terms]) for t, terms in found.items() if sum(df for _, df in terms) <= limit}
    sets = [positions(postings, [read.get(t) for t in tokens]) for tokens in _runs(pattern) if any(t in read for t in tokens)]
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), sets), most


def restrict(docs: DataFrame, hits: DataFrame, id_col: str, n: int | None = None) -> DataFrame:
    """Rows whose identifier is a hit.  Hits are broadcast if counted and few; else both sides are shuffled."""
    hits = hits.select(F.col("doc_id").alias(id_col))
    return docs.join(F.broadcast(hits) if n is not None and n <= BROADCAST_HITS else hits, id_col, "left_semi")


def some(docs: DataFrame, n: int) -> DataFrame:
    """Any n rows; partitions stop reading when they have as many."""
    return docs.limit(n)


def id_in(docs: DataFrame, id_col: str, ids: list[int]) -> DataFrame:
    """Rows of a list of identifiers: literals that reach the scan if few, a join otherwise; none for an empty list."""
    if not ids:
        return docs.where(F.lit(False))
    if len(ids) <= LIST_IDS:
        return docs.where(F.col(id_col).isin(ids))
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long").distinct()
    return restrict(docs, wanted, id_col, len(ids))


def _scan_seconds(docs: DataFrame) -> float:
    """How long all cores take to read the files."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size / (SCAN_RATE * docs.sparkSession.sparkContext.defaultParallelism)


def _with_hits(table: IndexedTable, hits: DataFrame, most: int, or_all: bool = False) -> DataFrame:
    """The rows of hits, of which there are ``most`` at most; or all rows, if allowed and the hits don't fit a list."""
    docs, id_col = table.docs, table.manifest.id_col
    if most <= BROADCAST_HITS:
        first = {r[0] for r in hits.limit(LIST_IDS + 1).collect()}
        if len(first) <= LIST_IDS:  # a list of literals reaches the pages of the sorted rows
            return docs.where(F.col(id_col).isin(sorted(first)))
    return docs if or_all else restrict(docs, hits, id_col, most)


def _narrowed(table: IndexedTable, patterns: list[str], scan_share: float | None) -> DataFrame:
    """The rows of ``table`` that the index can't rule out for any of the patterns; all of them where a scan is cheaper.

    With a ``scan_share``, the index is used where the rarest token is in at most that share of the documents.
    Without, it is used where a scan would take longer than the index' own jobs and either the hits, which are
    counted, are few enough for a list of identifiers, or are on fewer than half of the table's pages.
    """
    docs, m = table.docs, table.manifest
    if scan_share is None and _scan_seconds(docs) < INDEX_SECONDS:
        return docs
    known = [found for p in patterns if (found := candidates(table, LikePattern.parse(p)))[1] is not None]
    if any(most == 0 for _, most in known):
        return docs.where(F.lit(False))
    used = sorted(((hits, most) for hits, most in known if scan_share is None or most <= scan_share * m.doc_count), key=lambda x: x[1])
    if not used:
        return docs
    hits, most = reduce(lambda a, b: (a[0].join(b[0], "doc_id", "left_semi"), a[1]), used)
    return _with_hits(table, hits, most, or_all=scan_share is None and most * PAGE_ROWS > m.doc_count / 2)


def like_indexed(table: IndexedTable, pattern: str, negated: bool = False, ignore_case: bool = False, scan_share: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """``text LIKE pattern`` with SQL's meaning.

    The index serves positive, case-sensitive or not, patterns with tokens to look up where that is cheaper; the
    condition is compared again on what it finds.  A term that no document has ends the query without a scan.
    """
    text = F.col(table.manifest.text_col)
    like = text.ilike(pattern) if ignore_case else text.like(pattern)
    rows = table.docs.where(~like) if negated else _narrowed(table, [pattern], scan_share).where(like)
    return rows.select(*columns) if columns else rows


def where_indexed(table: IndexedTable, condition: str, scan_share: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows that meet a SQL condition; its ``LIKE`` conjuncts on the indexed text go through the index.

    Spark's own parser reads the condition.  Whatever is no positive LIKE joined by AND is left to the scan, and the
    whole condition is compared with what is read; without any LIKE all rows are scanned.
    """
    session = table.spark._jsparkSession
    patterns, nodes = [], [session.sessionState().sqlParser().parseExpression(condition)]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "And":
            nodes += [node.left(), node.right()]
        elif kind == "Like" and node.left().sql().strip("`") == table.manifest.text_col and node.right().getClass().getSimpleName() == "Literal":
            if node.escapeChar() == "\\":
                patterns.append(node.right().value().toString())
    rows = _narrowed(table, patterns, scan_share).where(condition)
    return rows.select(*columns) if columns else rows


def phrase_match(table: IndexedTable, phrase: str) -> DataFrame:
    """Rows whose tokens hold the phrase's tokens at consecutive places."""
    words = Phrase.of(phrase).words
    found = look_up(table, {(w, "exact") for w in words})
    counts = [sum(df for _, df in terms) for terms in found.values()]
    if not counts or not min(counts):
        return table.docs.where(F.lit(False))
    postings = table.postings.coalesce(1) if max(counts) <= FEW_HITS else table.postings
    return _with_hits(table, docset(postings, Phrase(words)), min(counts))
