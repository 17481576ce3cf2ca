"""Queries of sources, sinks and generators.  What is written or made is read again and held against SQL over the
tables that it comes from; generators, whose random numbers SQL can't draw, against what must hold for any seed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain import cli
from lexigrain.functions import text as X
from lexigrain.operators import nested, rewrite
from lexigrain.plans.catalog import query, read
from lexigrain.session import describe_session, scratch_dir
from lexigrain.sources import files, literal
from lexigrain.sources import generate as g
from lexigrain.sources.connector import read_indexed
from lexigrain.sources.index import BadIndex, build_index, open_index

#: Generated records for each row of the table that a generator query is sized by, and their batch.
PER_ROW, BATCH = 10, 1024


def _folder(spark: SparkSession) -> str:
    """A scratch folder that goes with the JVM."""
    path = scratch_dir(spark)
    spark.createDataFrame([], "none int").write.parquet(f"{path}/made")
    files.remove_at_exit(spark, path)
    return path


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_name")


def _values(rows: list[tuple]) -> str:
    shown = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(shown, r))})" for r in rows)


# Sessions and literal tables ----------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('batch_size', true), ('target_partitions', true), ('time_zone', true)) t(name, present)")
def session_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, v is not None) for k, v in describe_session(spark).items()], "name string, present boolean")


@query(f"SELECT CAST(id AS BIGINT) AS id, title FROM (VALUES {_values(literal.TINY_DOCS)}) t(id, title)")
def literal_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal.docs(spark)


_OUTER = [(name, *phone) for name, phones in literal.TINY_CONTACTS for phone in (phones or [(None, None)])]


@query(f"SELECT * FROM (VALUES {_values(_OUTER)}) t(name, number, phone_type)")
def contacts_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_outer(literal.contacts(spark), "phones", "name").orderBy(F.col("name").asc_nulls_last())


# The index on storage -----------------------------------------------------------------------------------------------

_PART_TOKENS = r"SELECT unnest(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM part"


@query(f"""WITH t AS ({_PART_TOKENS}) SELECT 'postings' AS part, count(*) AS rows, true AS listed, (SELECT count(*) FROM part) AS docs FROM t
UNION ALL SELECT 'terms', count(DISTINCT term), true, (SELECT count(*) FROM part) FROM t""")
def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build, reopen with sizes and checksums compared, and count what the manifest lists."""
    path = _folder(spark)
    build_index(_part(spark, sf_dir), f"{path}/t", "p_partkey", "p_name")
    table = open_index(spark, f"{path}/t", verify=True)
    listed = {f.split("/")[0] for f, size, _ in table.manifest.files if size > 0}
    counts = [(name, df.count(), name in listed, table.manifest.doc_count) for name, df in (("postings", table.postings), ("terms", table.terms))]
    return spark.createDataFrame(counts, "part string, rows long, listed boolean, docs long")


@query("SELECT * FROM (VALUES ('second build', true), ('another version', true), ('no index', true)) t(attempt, refused)")
def index_is_written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written index is read-only, and one that isn't whole isn't opened."""
    path = _folder(spark)
    build = lambda: build_index(_part(spark, sf_dir), f"{path}/t", "p_partkey", "p_name")
    manifest = build().manifest
    spark.createDataFrame([(json.dumps(json.loads(manifest.to_json()) | {"version": -1}),)], "value string").coalesce(1).write.text(f"{path}/old/_index/manifest")

    def refused(attempt) -> bool:
        try:
            attempt()
        except BadIndex:
            return True
        except Exception as e:
            return "ALREADY_EXISTS" in str(e)
        return False

    tried = {"second build": build, "another version": lambda: open_index(spark, f"{path}/old"), "no index": lambda: open_index(spark, f"{path}/none")}
    return spark.createDataFrame([(name, refused(f)) for name, f in tried.items()], "attempt string, refused boolean")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '% ring%' AND p_partkey > 100")
def like_through_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    build_index(_part(spark, sf_dir), f"{path}/t", "p_partkey", "p_name")
    return read_indexed(spark, f"{path}/t").where("p_name LIKE '% ring%' AND p_partkey > 100")


@query("SELECT name, count(*) AS rows, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part, (VALUES ('plain'), ('indexed')) t(name) GROUP BY name")
def twin_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows without and with an index, under the names that say so."""
    path, n = _folder(spark), read(spark, sf_dir, "part").count()
    plain, indexed = f"{path}/{g.docs_name(n)}", f"{path}/{g.docs_name(n, True)}"
    _part(spark, sf_dir).write.parquet(plain)
    build_index(spark.read.parquet(plain), indexed, "p_partkey", "p_name")
    out = [spark.read.parquet(p).agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum("p_partkey").alias("keys")) for name, p in (("plain", plain), ("indexed", f"{indexed}/docs"))]
    return out[0].union(out[1])


@query("SELECT count(*) AS rows, 'p_partkey,p_name' AS columns, min(p_partkey) AS low, max(p_partkey) AS high, true AS described FROM part")
def footer_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns, key-values and bounds from the footer of a file, without reading its data."""
    footer = files.read_footer(spark, files.write_file(_part(spark, sf_dir), f"{_folder(spark)}/part.parquet"))
    low, high = zip(*(bounds["p_partkey"] for _, bounds in footer.groups), strict=True)
    row = (footer.rows, ",".join(footer.columns), min(map(int, low)), max(map(int, high)), any("spark" in k for k in footer.metadata))
    return spark.createDataFrame([row], "rows long, columns string, low long, high long, described boolean")


# Sinks --------------------------------------------------------------------------------------------------------------

_WRITERS = 4


@query(f"""WITH n AS (SELECT count(*) * {PER_ROW} AS n FROM part),
b AS (SELECT range AS batch, least({BATCH}, n - range * {BATCH}) AS rows FROM n, range(0, CAST(ceil(n / {BATCH}) AS BIGINT)))
SELECT 'contacts_' || (batch % {_WRITERS}) || '.parquet' AS file, CAST(sum(rows) AS BIGINT) AS rows FROM b GROUP BY 1""")
def write_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each named file: batch i is in file i mod 4."""
    path = _folder(spark)
    config = g.PipelineConfig(PER_ROW * read(spark, sf_dir, "part").count(), _WRITERS, BATCH, path, total_threads=8)
    g.write_parallel(spark, config)
    written = spark.read.parquet(f"{path}/contacts_*.parquet")
    return written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))


@query(f"SELECT count(*) * {PER_ROW} AS records, true AS bytes_match, true AS rates_match FROM part")
def sink_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sink's own figures against the files that it wrote."""
    path = _folder(spark)
    m = g.write_parallel(spark, g.PipelineConfig(PER_ROW * read(spark, sf_dir, "part").count(), _WRITERS, BATCH, path, total_threads=8))
    size = sum(n for _, n in files.list_files(spark, path, ".parquet"))
    rates = abs(m["records_per_sec"] * m["seconds"] - m["records"]) < 1e-3 and abs(m["gb_per_sec"] * m["seconds"] * 1e9 - size) < 1e-3 * size
    return spark.createDataFrame([(m["records"], m["bytes"] == size > 0, rates)], "records long, bytes_match boolean, rates_match boolean")


@query("SELECT 'part_' || (p_partkey % 3) || '.parquet' AS file, CAST(p_partkey AS BIGINT) AS p_partkey, p_name FROM part")
def write_own_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator of another schema, one batch per key: any function to rows after their batch will do."""
    path, part = _folder(spark), _part(spark, sf_dir).select(F.col("p_partkey").cast("long").alias("batch"), F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")
    rows = part.agg(F.max("batch")).first()[0] + 1
    g.write_parallel(spark, g.PipelineConfig(rows, 3, 1, path, "part", part.drop("batch").schema, total_threads=8), lambda *_: part)
    return spark.read.parquet(f"{path}/part_*.parquet").select(F.col("_metadata.file_name").alias("file"), "p_partkey", "p_name")


@query(f"SELECT 'contacts.parquet' AS file, * FROM (VALUES {_values(_OUTER)}) t(name, number, phone_type)")
def write_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts shredded into one named file, read back and flattened."""
    path = g.write_single(literal.contacts(spark), _folder(spark))
    return nested.flatten_outer(spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), "*"), "phones", "file", "name")


@query("SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def nested_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of structs written as nested columns, and read back."""
    orders = nested.nest(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey", "o_orderpriority"], "orders", ["o_orderkey"])
    path = f"{_folder(spark)}/customers"
    read(spark, sf_dir, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "orders").write.parquet(path)
    return nested.flatten_outer(spark.read.parquet(path), "orders", "c_custkey")


# Generators ---------------------------------------------------------------------------------------------------------


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.titles(spark, PER_ROW * read(spark, sf_dir, "documents").count(), seed=12345)


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.contacts_in_batches(spark, PER_ROW * read(spark, sf_dir, "documents").count(), BATCH, 12345)


def _near(share, want: float):
    return F.abs(share - want) < 0.05


@query(f"""SELECT count(*) * {PER_ROW} AS rows, count(*) * {PER_ROW} AS ids, CAST(0 AS BIGINT) AS first, count(*) * {PER_ROW} - 1 AS last,
    CAST(0 AS BIGINT) AS foreign_words, true AS lengths_hold, true AS shares_hold FROM documents""")
def gen_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles: an identifier each, words of the two lists alone, 3 to 14 of them, and control words in their shares."""
    words = F.split("title", " ")
    known = F.array(*map(F.lit, sorted({*g.FILLER_WORDS, *g.CONTROL_WORDS})))
    holds = [_near(F.avg(F.array_contains(words, w).cast("double")), share + 0.05 * (w in g.FILLER_WORDS)) for w, share in g.CONTROL_WORDS.items()]
    return _titles(spark, sf_dir).agg(
        F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"),
        F.sum(F.size(F.array_except(words, known))).alias("foreign_words"), F.every(F.size(words).between(3, 14)).alias("lengths_hold"),
        (holds[0] & holds[1] & holds[2] & holds[3] & holds[4] & holds[5]).alias("shares_hold"),
    )


def _share(condition):
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


@query(f"SELECT count(*) * {PER_ROW} AS rows, true AS names_hold, true AS counts_hold, CAST(0 AS BIGINT) AS empty_lists FROM documents")
def gen_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts: shares of names and of numbers of phones, and no empty list."""
    n = nested.list_size("phones")
    counts = _near(_share(n == 0), 0.40) & _near(_share(n == 1), 0.45) & _near(_share(n == 2), 0.10) & _near(_share(n.between(3, 5)), 0.05)
    return _contacts(spark, sf_dir).agg(F.count("*").alias("rows"), _near(_share(F.col("name").isNotNull()), g.NAME_SHARE).alias("names_hold"), counts.alias("counts_hold"), F.count_if(F.size("phones") == 0).alias("empty_lists"))


@query("SELECT true AS well_formed, true AS known_types, true AS all_differ, true AS templates_hold, true AS types_hold")
def gen_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones: form and uniqueness of numbers, shares of what a phone has and of its types."""
    number, kind = F.col("number"), F.col("phone_type")
    typed = lambda k: F.sum((kind == k).cast("double")) / F.count(kind)
    return nested.flatten_inner(_contacts(spark, sf_dir), "phones").agg(
        F.every(F.coalesce(number.rlike(r"^\+91-[0-9]{10}$"), F.lit(True))).alias("well_formed"), F.every(F.coalesce(kind.isin(*g.PHONE_TYPES), F.lit(True))).alias("known_types"),
        (F.count(number) == F.count_distinct(number)).alias("all_differ"),
        (_near(_share(number.isNotNull() & kind.isNotNull()), 0.90) & _near(_share(number.isNotNull() & kind.isNull()), 0.05) & _near(_share(number.isNull() & kind.isNotNull()), 0.04)).alias("templates_hold"),
        (_near(typed("Mobile"), 0.55) & _near(typed("Work"), 0.35) & _near(typed("Home"), 0.10)).alias("types_hold"),
    )


@query(f"""WITH n AS (SELECT count(*) * {PER_ROW} AS n FROM documents)
SELECT range AS batch, least({BATCH}, n - range * {BATCH}) AS rows, range * {BATCH * g.MAX_PHONES} AS first, true AS contiguous
FROM n, range(0, CAST(ceil(n / {BATCH}) AS BIGINT))""")
def batches_count_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every batch, the last one short, and its first number; the last number follows from how many there are."""
    df = _contacts(spark, sf_dir)
    numbers = nested.flatten_inner(df, "phones", "batch").select("batch", X.phone_id(F.col("number")).alias("number"))
    bounds = g.batch_bounds(numbers, "batch", "number").withColumn("contiguous", F.col("last") == F.col("first") + F.col("numbers") - 1)
    return df.groupBy("batch").agg(F.count("*").alias("rows")).join(bounds, "batch").select("batch", "rows", "first", "contiguous")


@query("SELECT * FROM (VALUES ('titles', true, true), ('contacts', true, true)) t(generator, same_for_any_partitioning, other_seed_differs)")
def gen_determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = PER_ROW * read(spark, sf_dir, "part").count()
    made = {"titles": lambda seed, parts: g.titles(spark, n, seed, parts), "contacts": lambda seed, parts: g.contacts(spark, n, BATCH, seed, parts).select(F.to_json(F.struct("name", "phones")).alias("row"))}
    of = lambda df: df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]
    return spark.createDataFrame([(k, of(f(7, 3)) == of(f(7, 5)), of(f(7, 3)) != of(f(8, 3))) for k, f in made.items()], "generator string, same_for_any_partitioning boolean, other_seed_differs boolean")


_WRONG = [({"num_writers": 0}, g.NO_WRITERS), ({"num_writers": 4, "total_threads": 4}, g.NO_PRODUCERS.format(threads=4, writers=4)), ({"target_records": 2_000_000_001}, g.TOO_MANY.format(records=2_000_000_001, capacity=10_000_000_000, most=5, limit=2_000_000_000))]


@query(f"SELECT CAST(c AS BIGINT) AS c, message FROM (VALUES {_values([(i, m) for i, (_, m) in enumerate(_WRONG)])}) t(c, message)")
def config_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = []
    for i, (change, _) in enumerate(_WRONG):
        try:
            g.PipelineConfig(**({"total_threads": 16} | change))
        except g.PipelineConfigError as e:
            told.append((i, str(e)))
    return spark.createDataFrame(told, "c long, message string")


@query("SELECT p_partkey, CAST(i AS INT) AS i, p_name || '-' || i AS element FROM (SELECT *, unnest(range(0, p_size % 4)) AS i FROM part)")
def positional_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists made by position, as many as another column says, and laid out again."""
    n = F.col("p_size") % 4
    made = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.concat_ws("-", "p_name", i.cast("string")).alias("element"))))
    return nested.flatten_inner(read(spark, sf_dir, "part").withColumn("list", made), "list", "p_partkey")


@query("SELECT p_partkey, c_name FROM part JOIN customer ON c_custkey = p_partkey")
def zip_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sequences side by side: both have their ordinal, so a join pairs them."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("p_partkey"), "c_name")
    return read(spark, sf_dir, "part").select("p_partkey").join(customers, "p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 4, 1000000)")
def ids_from_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cli.chosen(_part(spark, sf_dir), "p_partkey", [3, 4, 1_000_000])


@query("SELECT p_partkey, p_name FROM part")
def no_ids_from_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty list means all."""
    return cli.chosen(_part(spark, sf_dir), "p_partkey", [])


@query("SELECT count(*) AS rows FROM (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%' LIMIT 5)")
def limit_in_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows, without an order: how many there are is all that is fixed."""
    return rewrite.some(_part(spark, sf_dir).where(F.col("p_name").like("%ring%")), 5).agg(F.count("*").alias("rows"))
