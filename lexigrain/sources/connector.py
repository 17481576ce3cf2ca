"""The indexed table as a Spark data source: ``spark.read.format("lexigrain").load()``, for plain SQL.

Conditions ``text LIKE '%...%'`` and ``text LIKE '...%'`` reach the reader if spark.sql.python.filterPushdown.enabled
is true.  A task reads one file of the table.  The file's own bounds say which identifiers it has, and the task looks
the words up among the postings of these alone, so nothing of the index passes through the driver.  All conditions go
back to Spark, which compares them again.  Rows pass through Python, so lexigrain.operators.rewrite is the fast way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, StringContains, StringStartsWith


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


def _dataset(paths: list[str]):
    """Arrow's view of Parquet files on any file system that it knows by the address' scheme."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    found = [fs.FileSystem.from_uri(p if "://" in p else f"file://{p.removeprefix('file:')}") for p in paths]
    return ds.dataset([place for _, place in found], filesystem=found[0][0], format="parquet")


class IndexedReader(DataSourceReader):
    """``files``, ``postings`` and the manifest's columns come as options."""

    def __init__(self, options: dict, schema) -> None:
        self.files = [f for f in options["files"].split("\n") if f]
        self.postings = [f for f in options["postings"].split("\n") if f]
        self.id_col, self.text_col, self.columns = options["id_col"], options["text_col"], schema.names
        self.words: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        from lexigrain.functions.like import Run

        for f in filters:
            if isinstance(f, StringContains | StringStartsWith) and f.attribute == (self.text_col,) and f.value.isascii():
                self.words |= {w for w, how in Run(f.value, isinstance(f, StringContains), True).tokens() if how == "exact"}
            yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in self.files]

    def _wanted(self, data):
        """The identifiers of a file whose rows have all the words, as a condition; None without words."""
        import pyarrow.compute as pc

        if not self.words:
            return None
        bounds = [g.statistics[self.id_col] for part in data.get_fragments() for g in part.row_groups if self.id_col in (g.statistics or {})]
        inside = pc.field("doc_id") >= min(b["min"] for b in bounds) if bounds else pc.scalar(True)
        if bounds:
            inside &= pc.field("doc_id") <= max(b["max"] for b in bounds)
        postings, ids = _dataset(self.postings), None
        for word in sorted(self.words):  # postings are sorted by term and document, so few row groups are read
            found = pc.unique(postings.to_table(columns=["doc_id"], filter=(pc.field("term") == word) & inside).column(0))
            ids = found if ids is None else ids.filter(pc.is_in(ids, found))
        return pc.field(self.id_col).isin(ids)

    def read(self, partition: _File) -> Iterator:
        data = _dataset([partition.path])
        yield from data.to_batches(columns=self.columns, filter=self._wanted(data))


class LexigrainSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexigrain"

    def schema(self) -> str:
        return self.options["ddl"]

    def reader(self, schema) -> IndexedReader:
        return IndexedReader(self.options, schema)


def read_indexed(spark: SparkSession, path: str):
    """The table through the data source, with pushdown of conditions turned on."""
    from lexigrain.sources.index import open_index

    table = open_index(spark, path)
    spark.dataSource.register(LexigrainSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.docs.schema.fields)
    m = table.manifest
    return spark.read.format("lexigrain").options(ddl=ddl, files="\n".join(table.docs.inputFiles()), postings="\n".join(table.postings.inputFiles()), id_col=m.id_col, text_col=m.text_col).load()
