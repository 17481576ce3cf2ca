"""Named queries over the standard tables, and their SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.functions import text as X
from lexigrain.operators import nested, report, rewrite
from lexigrain.operators.fulltext import Bool, FtsSession, Phrase, Term, postings_of
from lexigrain.plans import reports, storage  # noqa: F401  (their queries register themselves)
from lexigrain.plans.catalog import ORACLE_SQL, QUERIES, query  # noqa: F401
from lexigrain.plans.catalog import read as _t
from lexigrain.session import scratch_dir
from lexigrain.sources import generate as g
from lexigrain.sources.files import remove_at_exit
from lexigrain.sources.index import IndexedTable, build_index, open_index


def _index(spark: SparkSession, sf_dir: str, name: str, id_col: str, text_col: str) -> IndexedTable:
    path = scratch_dir(spark)
    build_index(_t(spark, sf_dir, name), path, id_col, text_col)
    remove_at_exit(spark, path)
    return open_index(spark, path)


def _postings(spark: SparkSession, sf_dir: str) -> FtsSession:
    return FtsSession(postings_of(_t(spark, sf_dir, "documents"), "doc_id", "text"))


# Sources ------------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM part")
def count_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 40")
def query_file_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT p_partkey, p_name FROM parquet.`{sf_dir}/part.parquet` WHERE p_size > 40")


# LIKE and identifiers -----------------------------------------------------------------------------------------------

_PART = "p_partkey, p_name"


@query(f"SELECT {_PART} FROM part WHERE p_name LIKE '%small ring%'")
def like_contains_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "part")
    return df.where(df.p_name.like("%small ring%")).select("p_partkey", "p_name")


@query(f"SELECT {_PART} FROM part WHERE p_name LIKE '%small ring%'")
def like_indexed_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _index(spark, sf_dir, "part", "p_partkey", "p_name")
    return rewrite.like_indexed(table, "%small ring%", scan_share=1.0, columns=["p_partkey", "p_name"])


@query("SELECT doc_id, text FROM documents WHERE text LIKE '%of the%'")
def like_indexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _index(spark, sf_dir, "documents", "doc_id", "text")
    return rewrite.like_indexed(table, "%of the%", scan_share=1.0, columns=["doc_id", "text"])


@query("SELECT doc_id, text FROM documents WHERE text LIKE '%tion. T%the_of%'")
def like_indexed_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _index(spark, sf_dir, "documents", "doc_id", "text")
    return rewrite.like_indexed(table, "%tion. T%the_of%", scan_share=1.0, columns=["doc_id", "text"])


@query("SELECT doc_id FROM documents WHERE text LIKE '%of the%'")
def like_indexed_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default threshold: this pattern is too common, so the planner scans."""
    table = _index(spark, sf_dir, "documents", "doc_id", "text")
    return rewrite.like_indexed(table, "%of the%", columns=["doc_id"])


@query("SELECT doc_id FROM documents WHERE text NOT LIKE '%of the%'")
def like_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "documents")
    return df.where(~df.text.like("%of the%")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%OF the%'")
def ilike_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "documents")
    return df.where(df.text.ilike("%OF the%")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE text LIKE '%of the%' AND lang = 'en' AND doc_id > 100")
def like_with_conjuncts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One conjunct goes through the index, the others to the scan of what it leaves."""
    table = _index(spark, sf_dir, "documents", "doc_id", "text")
    return rewrite.where_indexed(table, "text LIKE '%of the%' AND lang = 'en' AND doc_id > 100", scan_share=1.0, columns=["doc_id"])


@query("SELECT doc_id FROM documents WHERE text LIKE '%of the%' AND text LIKE '%that%' AND text NOT LIKE '%with%'")
def like_two_conjuncts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both patterns narrow the rows down."""
    table = _index(spark, sf_dir, "documents", "doc_id", "text")
    return rewrite.where_indexed(table, "text LIKE '%of the%' AND text LIKE '%that%' AND text NOT LIKE '%with%'", scan_share=1.0, columns=["doc_id"])


@query("SELECT doc_id FROM documents WHERE lang = 'de'")
def where_without_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.where_indexed(_index(spark, sf_dir, "documents", "doc_id", "text"), "lang = 'de'", columns=["doc_id"])


@query(f"SELECT {_PART} FROM part WHERE p_partkey IN (1, 5, 8, 13, 21, 34)")
def id_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.id_in(_t(spark, sf_dir, "part"), "p_partkey", [1, 5, 8, 13, 21, 34]).select("p_partkey", "p_name")


@query(f"SELECT {_PART} FROM part WHERE p_partkey % 3 = 0 AND p_partkey < 6000")
def id_in_long_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the literals that a plan should hold, the list is a joined table."""
    return rewrite.id_in(_t(spark, sf_dir, "part"), "p_partkey", list(range(0, 6000, 3))).select("p_partkey", "p_name")


@query(f"SELECT {_PART} FROM part WHERE false")
def empty_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.id_in(_t(spark, sf_dir, "part"), "p_partkey", []).select("p_partkey", "p_name")


# Full-text queries --------------------------------------------------------------------------------------------------

_TOKENS = r"""WITH t AS (SELECT doc_id, unnest(tok) AS term, generate_subscripts(tok, 1) AS pos FROM (
    SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS tok FROM documents))
"""


def _phrase_sql(*words: str) -> str:
    joins = " ".join(f"JOIN t t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return f"SELECT DISTINCT t0.doc_id FROM t t0 {joins} WHERE t0.term = '{words[0]}'"


@query(_TOKENS + _phrase_sql("of", "the"))
def phrase_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).search(Phrase.of("of the"))


@query(_TOKENS + _phrase_sql("the", "of", "the"))
def phrase_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).search(Phrase.of("the of the"))


@query(_TOKENS + _phrase_sql("the", "the"))
def phrase_repeated_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).search(Phrase.of("the the"))


@query(_TOKENS + f"SELECT doc_id, text FROM documents WHERE doc_id IN ({_phrase_sql('of', 'the')})")
def phrase_match_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.phrase_match(_index(spark, sf_dir, "documents", "doc_id", "text"), "Of the").select("doc_id", "text")


@query(_TOKENS + "SELECT DISTINCT doc_id FROM t WHERE term = 'that'")
def term_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).search(Term("that"))


@query(_TOKENS + "SELECT DISTINCT doc_id FROM t WHERE term = 'that' AND doc_id NOT IN (SELECT doc_id FROM t WHERE term = 'with')")
def bool_must_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).search(Bool(must=(Term("that"),), must_not=(Term("with"),)))


@query(_TOKENS + "SELECT DISTINCT doc_id FROM t WHERE term = 'that' AND doc_id IN (SELECT doc_id FROM t WHERE term = 'with')")
def bool_must(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).search(Bool(must=(Term("that"), Term("with"))))


@query(_TOKENS + "SELECT DISTINCT doc_id FROM t WHERE term IN ('der', 'les')")
def bool_should(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).search(Bool(should=(Term("der"), Term("les"))))


@query(_TOKENS + f"SELECT doc_id FROM t WHERE term = 'der' UNION {_phrase_sql('of', 'the')}")
def bool_term_or_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).search(Bool(should=(Term("der"), Phrase.of("of the"))))


@query(_TOKENS + "SELECT count(DISTINCT doc_id) AS n FROM t WHERE term = 'that'")
def count_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).search(Term("that")).agg(F.count("*").alias("n"))


@query(_TOKENS + "SELECT term, count(DISTINCT doc_id) AS docs FROM t WHERE term IN ('the', 'der', 'les', 'que') GROUP BY term")
def term_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir).histogram(["the", "der", "les", "que"])


@query(_TOKENS + "SELECT term, doc_id, CAST(pos - 1 AS INT) AS pos FROM t")
def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings_of(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query(_TOKENS + "SELECT DISTINCT doc_id, (SELECT count(DISTINCT doc_id) FROM t WHERE term = 'that') AS n FROM t WHERE term = 'that'")
def count_and_docset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both collectors of one search: the number and, written while it is kept, the documents."""
    path = scratch_dir(spark)
    with _postings(spark, sf_dir).count_and_docs(Term("that")) as (n, hits):
        hits.withColumn("n", F.lit(n).cast("long")).write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.parquet(path)


@query(_TOKENS + "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM t WHERE term = 'der')")
def resolve_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits to their rows; one that has no row drops out."""
    session, docs = _postings(spark, sf_dir), _t(spark, sf_dir, "documents")
    hits = session.search(Term("der")).union(spark.range(-1, 0).toDF("doc_id"))
    return session.resolve(hits, docs, "doc_id").select("doc_id", "lang", "source")


@query(_TOKENS + """, a AS (SELECT DISTINCT doc_id FROM t WHERE term = 'that'), b AS (SELECT DISTINCT doc_id FROM t WHERE term = 'with')
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL
SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def docset_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _postings(spark, sf_dir)
    a, b = s.search(Term("that")), s.search(Term("with"))
    named = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b)}
    out = [df.agg(F.lit(op).alias("op"), F.count("*").alias("n")) for op, df in named.items()]
    return out[0].union(out[1]).union(out[2])


# Joins --------------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def hit_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def hit_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.restrict(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def hit_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


_WORDS = ", ".join(f"({i}, '{w}')" for i, w in enumerate(g.CONTROL_WORDS))


@query(f"WITH w(i, w) AS (VALUES {_WORDS}) SELECT CAST(a.i * 6 + b.i AS BIGINT) AS id, '%' || a.w || ' ' || b.w || '%' AS pattern FROM w a, w b")
def word_pairs_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of a list of six with itself."""
    w = spark.createDataFrame(list(enumerate(g.CONTROL_WORDS)), "i long, w string")
    a, b = w.alias("a"), w.alias("b")
    return a.crossJoin(b).select((F.col("a.i") * 6 + F.col("b.i")).alias("id"), F.concat(F.lit("%"), "a.w", F.lit(" "), "b.w", F.lit("%")).alias("pattern"))


# Nested data --------------------------------------------------------------------------------------------------------


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders as a list; NULL where there are none."""
    orders = nested.nest(_t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey", "o_orderpriority"], "orders", ["o_orderkey"])
    customers = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left").select("c_custkey", "c_name", "orders")


@query("SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def lateral_unnest_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_outer(_customers(spark, sf_dir), "orders", "c_custkey")


@query("SELECT c_custkey, o_orderkey, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey")
def lateral_unnest_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_inner(_customers(spark, sf_dir), "orders", "c_custkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def lateral_join_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    _customers(spark, sf_dir).createOrReplaceTempView("lexigrain_customers")
    return spark.sql("SELECT c_custkey, o.o_orderkey FROM lexigrain_customers LEFT JOIN LATERAL (SELECT * FROM inline(orders)) o ON true")


@query("SELECT o_orderkey AS number FROM orders JOIN customer ON c_custkey = o_custkey")
def nested_field_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select(F.explode("orders").alias("o")).where("o.o_orderkey IS NOT NULL").select(F.col("o.o_orderkey").alias("number"))


@query("SELECT len, count(*) AS rows FROM (SELECT c_custkey, count(o_orderkey) AS len FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY len")
def list_size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.size_distribution(_customers(spark, sf_dir), "orders")


# Aggregates and orders ----------------------------------------------------------------------------------------------


@query("""SELECT CAST(min(length(text)) AS BIGINT) AS min_len, CAST(max(length(text)) AS BIGINT) AS max_len, avg(length(text)) AS avg_len,
    CAST(min(len(string_split(text, ' '))) AS BIGINT) AS min_words, CAST(max(len(string_split(text, ' '))) AS BIGINT) AS max_words,
    avg(len(string_split(text, ' '))) AS avg_words, count(DISTINCT text) AS distinct_texts FROM documents""")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and words in one pass, and distinct texts by their digests, so that texts aren't shuffled."""
    df = _t(spark, sf_dir, "documents")
    n, w = F.length("text").cast("long"), X.word_count(F.col("text"))
    measured = df.select(n.alias("n"), w.alias("w"), F.sha2("text", 256).alias("digest"))
    return measured.agg(F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.avg("n").alias("avg_len"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), F.avg("w").alias("avg_words"), F.count_distinct("digest").alias("distinct_texts"))


@query("SELECT avg(CASE WHEN l.quality IS NULL THEN 1.0 ELSE 0.0 END) AS quality, avg(CASE WHEN d.lang IS NULL THEN 1.0 ELSE 0.0 END) AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def null_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _t(spark, sf_dir, "documents").select("doc_id", "lang").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return nested.null_ratios(joined, "quality", "lang")


@query("SELECT event_type, count(*) AS rows, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 9) AS share FROM events GROUP BY event_type")
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.shares(_t(spark, sf_dir, "events"), "event_type").withColumn("share", F.round("share", 9))


@query("""SELECT hour, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS click, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS view,
    round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS purchase FROM (SELECT CAST(hour(ts) AS INT) AS hour, * FROM events) GROUP BY hour""")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "view", "purchase"]
    df = _t(spark, sf_dir, "events").withColumn("hour", F.hour("ts"))
    return report.pivot_mean(df, "hour", "event_type", kinds, "value").select("hour", *(F.round(k, 6).alias(k) for k in kinds))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def median_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.median_min_max(_t(spark, sf_dir, "events"), "event_type", "value").withColumn("median", F.round("median", 6))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, min(value) AS low, max(value) AS high FROM events JOIN q USING (event_type)
WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.box_plot(_t(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", *(F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")), "low", "high")


@query("SELECT round(coalesce(exp(avg(ln(p_retailprice / p_size))), 1.0), 6) AS geomean FROM part")
def geomean_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").agg(F.round(report.geometric_mean(F.col("p_retailprice") / F.col("p_size")), 6).alias("geomean"))


@query("SELECT count(*) AS queries, count(*) FILTER (WHERE p_size >= 25) AS slow_queries FROM part")
def slow_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _t(spark, sf_dir, "part").select(F.lit(25.0).alias("baseline"), F.col("p_size").cast("double").alias("optimized"))
    return report.comparison_summary(runs).select("queries", "slow_queries")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS FIRST, doc_id LIMIT 5")
def topk_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", "quality").orderBy(F.col("quality").asc_nulls_first(), "doc_id").limit(5)


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS LAST, doc_id LIMIT 7 OFFSET 3")
def order_nulls_last_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", "quality").orderBy(F.col("quality").asc_nulls_last(), "doc_id").offset(3).limit(7)


@query("SELECT DISTINCT event_type FROM events ORDER BY 1")
def distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type")


@query("SELECT o_orderkey, o_custkey * 1000 + coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS number FROM orders")
def contiguous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = g.count_up("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").cast("long"), F.col("o_custkey") * 1000)
    return _t(spark, sf_dir, "orders").select("o_orderkey", number.alias("number"))


@query("SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS numbers FROM orders GROUP BY o_custkey")
def bounds_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.batch_bounds(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%ring%'")
def sorted_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").where(F.col("p_name").like("%ring%")).select("p_partkey").orderBy("p_partkey")


# Scalar functions ---------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, '+91-' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS phone, c_custkey AS parsed FROM customer")
def phone_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    phone = X.phone_number(F.col("c_custkey"))
    return _t(spark, sf_dir, "customer").select("c_custkey", phone.alias("phone"), X.phone_id(phone).alias("parsed"))


@query("""SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def regex_extract_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", r'"k": ([0-9]+)', 1).cast("long").alias("k"))


@query("SELECT p_partkey, CASE WHEN n >= 1000000 THEN n // 1000000 || 'M' WHEN n >= 1000 THEN n // 1000 || 'K' ELSE CAST(n AS VARCHAR) END AS label FROM (SELECT p_partkey, p_partkey * 997 AS n FROM part)")
def short_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", X.short_count(F.col("p_partkey") * 997).alias("label"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents")
def whitespace_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(X.split_whitespace(F.col("text"))).cast("long").alias("words"))


_CRC_BITS = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"


@query(f"""SELECT p_partkey, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT))),
    lambda a, b: {_CRC_BITS}), 4294967295) AS crc32 FROM part""")
def crc32_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum bit by bit in SQL, of texts that are ASCII."""
    return _t(spark, sf_dir, "part").select("p_partkey", F.crc32("p_name").alias("crc32"))


@query("SELECT p_partkey, p_brand || ' ' || p_name AS joined, CAST(ceil(p_partkey / 64) AS BIGINT) AS batches, p_partkey % 64 AS rest, least(64, greatest(0, 1000 - p_partkey)) AS room FROM part")
def joins_and_batch_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words joined by spaces; whole batches, what is left over, and room that never goes below nothing."""
    key = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(key, F.concat_ws(" ", "p_brand", "p_name").alias("joined"), X.whole_batches(key, 64).alias("batches"), (key % 64).alias("rest"), F.least(F.lit(64), F.greatest(F.lit(0), 1000 - key)).alias("room"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Work' WHEN 2 THEN 'Home' END AS kind FROM part")
def code_to_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", X.name_of(F.col("p_size") % 4, list(g.PHONE_TYPES)).alias("kind"))
