"""What the corpus operators share: reading tables, scratch tables and sizes of side inputs."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.session import scratch_dir
from lexigrain.sources.files import remove, remove_at_exit

#: ASCII white space as the query contracts define it; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Largest side input, in rows, that is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder, for the caller to drop."""
    return scratch_dir(spark)


#: Spark's own clean-up of a statement's shuffle files when the statement ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Scratch tables and, as the JVM's weak reference, the relation that every plan over one holds.
_watched: list[tuple] = []


def table(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` once and read it back: later stages and lost executors start from the files.

    Nothing reads the write's shuffles again, so Spark removes their files as soon as it has ended.  A table without
    a path of the caller's goes when no plan reads it any more, or at the JVM's end.
    """
    spark = df.sparkSession
    where = path or scratch(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(where)
    finally:
        spark.conf.set(CLEANUP, before)
    remove_at_exit(spark, where)
    read = spark.read.schema(df.schema).parquet(where)
    if path is None:
        drop_unread(spark)
        relation = read._jdf.queryExecution().analyzed().relation()
        _watched.append((spark.sparkContext._jvm.java.lang.ref.WeakReference(relation), where))
    return read


def drop_unread(spark: SparkSession) -> None:
    """Remove scratch tables whose relation the JVM has collected: no plan, lazy or running, can read them."""
    for watched in list(_watched):
        relation, path = watched
        try:
            unread = relation.get() is None
        except Py4JError:  # another JVM's, which has removed it at its end
            _watched.remove(watched)
            continue
        if unread:
            _watched.remove(watched)
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder, wherever the shared file system is."""
    remove(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written with a number of its own in each row, and the name of that column."""
    row = fresh(df, "_row")
    return table(df.withColumn(row, F.monotonically_increasing_id()), compression="zstd"), row


def small(side: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where the counted ``rows`` of ``side`` are within ``limit``."""
    return F.broadcast(side) if rows <= limit else side


def key60(col: Column) -> Column:
    """The first 60 bits of the MD5 of a value's text: uniform, and the same in every engine."""
    text = F.coalesce(col.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Number rows from 1 in ``order`` over all partitions, without bringing them into one task.

    Range partitions are written out, so their borders are fixed; one count per partition gives each
    partition's first number.  Rows that tie in ``order`` get their numbers in any order.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = table(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = cut.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per range partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = F.broadcast(sums.select("_part", before.alias("_before")))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.join(sums, "_part").withColumn(rank, F.col("_before") + within).drop("_part", "_before")
