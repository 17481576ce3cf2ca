"""Files by name on whatever file system Spark reaches: single-file sinks, and what a Parquet footer says."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[tuple[str, int]]:
    """Path and bytes of the files of a folder, by name."""
    where, fs = _path(spark, folder)
    found = ((f.getPath().toString(), f.getLen()) for f in fs.listStatus(where) if f.isFile())
    return sorted((p, n) for p, n in found if p.endswith(suffix) and not p.rsplit("/", 1)[-1].startswith(("_", ".")))


def move(spark: SparkSession, source: str, target: str) -> None:
    (a, fs), (b, _) = _path(spark, source), _path(spark, target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise FileExistsError(f"{source} can't be moved to {target}")


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have what is at ``path`` removed when the JVM ends."""
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)


def write_file(df: DataFrame, target: str, kind: str = "parquet", **options) -> str:
    """Write ``df`` as one file of that name; a task writes it in a folder beside it, and it is moved when whole."""
    spark, part = df.sparkSession, f"{target}.tmp"
    df.coalesce(1).write.format(kind).options(**options).save(part)
    suffix = {"parquet": ".parquet", "text": ".txt", "json": ".json"}[kind]
    (written, _), *_ = list_files(spark, part, suffix)
    move(spark, written, target)
    remove(spark, part)
    return target


@dataclass(frozen=True)
class Footer:
    """rows; columns in order; key-value metadata; and per row group its rows and each column's (minimum, maximum)."""

    rows: int
    columns: tuple[str, ...]
    metadata: dict[str, str]
    groups: tuple[tuple[int, dict[str, tuple]], ...]


def read_footer(spark: SparkSession, path: str) -> Footer:
    """What one Parquet file says about itself; no data is read."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(_path(spark, path)[0], spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        footer = reader.getFooter()
        about = footer.getFileMetaData()
        groups = []
        for block in footer.getBlocks():
            bounds = {}
            for column in block.getColumns():
                stats = column.getStatistics()
                if stats.hasNonNullValue():
                    bounds[column.getPath().toDotString()] = (stats.minAsString(), stats.maxAsString())
            groups.append((block.getRowCount(), bounds))
        columns = tuple(f.getName() for f in about.getSchema().getFields())
        return Footer(sum(n for n, _ in groups), columns, dict(about.getKeyValueMetaData()), tuple(groups))
    finally:
        reader.close()
