"""A Parquet table with a full-text index beside it.

    table/docs              the rows, sorted by identifier
    table/_index/postings   term, doc_id, pos, range-partitioned and sorted by term
    table/_index/terms      term, df, sorted by term
    table/_index/manifest   one JSON text: version, tokenizer, columns, document count, files with sizes and CRC-32

All is written and read through Spark, so any file system that it reaches will do.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lexigrain import schemas
from lexigrain.functions.text import TOKENIZER, tokens
from lexigrain.operators.fulltext import FtsSession, postings_of

VERSION = 1


class BadIndex(ValueError):
    """An index that is missing, damaged, or of another version or tokenizer."""


@dataclass(frozen=True)
class Manifest:
    version: int
    tokenizer: str
    id_col: str
    text_col: str
    doc_count: int
    files: tuple[tuple[str, int, int], ...]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        try:
            raw = json.loads(text)
            raw["files"] = tuple(tuple(f) for f in raw["files"])
            found = cls(**raw)
        except (ValueError, TypeError, KeyError) as e:
            raise BadIndex(f"the manifest can't be read: {e}") from e
        if found.version != VERSION:
            raise BadIndex(f"the index has version {found.version}, not {VERSION}")
        if found.tokenizer != TOKENIZER:
            raise BadIndex(f"the index was built by tokenizer {found.tokenizer!r}, not {TOKENIZER!r}")
        return found


#: Rows in a file of the index and in a page of the table at most: files stay small enough to be summed as one value,
#: and a list of identifiers reads few rows around each.
FILE_ROWS, PAGE_ROWS = 20_000_000, 1000


def _checksums(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, bytes and CRC-32 of the index' data files, computed where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    rows = []
    for part in ("postings", "terms"):
        read = files.load(f"{path}/_index/{part}")
        rows += read.select(F.concat(F.lit(f"{part}/"), F.element_at(F.split("path", "/"), -1)), "length", F.crc32("content")).collect()
    return sorted(tuple(r) for r in rows)


def build_index(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "title", with_docs: bool = True) -> IndexedTable:
    """Write the table and its index; the postings are sorted by a range shuffle on the term.

    Documents of each term are counted from each document's distinct terms, within tasks before they are shuffled.
    """
    spark = docs.sparkSession
    if with_docs:
        docs.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col).write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/docs")
        docs = spark.read.schema(docs.schema).parquet(f"{path}/docs")
    postings = postings_of(docs, id_col, text_col)
    ordered = postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id", "pos")
    ordered.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{path}/_index/postings")
    terms = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/_index/terms")
    manifest = Manifest(VERSION, TOKENIZER, id_col, text_col, docs.count(), tuple(_checksums(spark, path)))
    spark.createDataFrame([(manifest.to_json(),)], "value string").coalesce(1).write.text(f"{path}/_index/manifest")
    return IndexedTable(spark, path, manifest, None if with_docs else docs)


def open_index(spark: SparkSession, path: str, verify: bool = False) -> IndexedTable:
    """Open a written table; ``verify`` also compares every file's size and checksum with the manifest."""
    try:
        rows = spark.read.text(f"{path}/_index/manifest").collect()
    except AnalysisException as e:
        raise BadIndex(f"there is no index at {path}") from e
    if len(rows) != 1:
        raise BadIndex("the manifest can't be read: it isn't one line")
    manifest = Manifest.from_json(rows[0][0])
    if verify and tuple(_checksums(spark, path)) != manifest.files:
        raise BadIndex("the index files differ from the manifest")
    return IndexedTable(spark, path, manifest)


class IndexedTable:
    def __init__(self, spark: SparkSession, path: str, manifest: Manifest, docs: DataFrame | None = None) -> None:
        self.spark, self.path, self.manifest, self._docs = spark, path, manifest, docs
        self.looked_up: dict = {}
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", 1000)  # lists of identifiers reach the pages

    @property
    def docs(self) -> DataFrame:
        return self._docs if self._docs is not None else self.spark.read.parquet(f"{self.path}/docs")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(schemas.POSTINGS).parquet(f"{self.path}/_index/postings")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.schema(schemas.TERMS).parquet(f"{self.path}/_index/terms")

    def session(self) -> FtsSession:
        return FtsSession(self.postings)

    def register(self, name: str) -> None:
        """The table under a name for SQL; its LIKE conditions are exact, with no index."""
        self.docs.createOrReplaceTempView(name)
