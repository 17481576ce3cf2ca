"""Seeded synthetic documents and contacts as expressions of the row number, and their parallel Parquet sink."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigrain import schemas
from lexigrain.functions.random import between, pick, uniform, weighted
from lexigrain.functions.text import phone_number
from lexigrain.sources.files import list_files, move, remove, write_file

#: Control words with their probabilities, and filler words (two occur twice or as control words too).
CONTROL_WORDS = {"concurrency": 0.20, "runtime": 0.10, "indexing": 0.05, "normalization": 0.01, "atomics": 0.005, "idempotency": 0.001}
FILLER_WORDS = """
a an and as at by for from in is it of on that the to was with
api application architecture cache client code concurrency container data database error framework function index
instance language library memory message model network pattern performance process query queue request response
schema server service system thread transaction
avoid build design ensure execute handle implement improve manage optimize process return scale
atomic concurrent distributed efficient high-performance scalable simple stateless
""".split()
#: Shares of phone types, numbers of phones (3 stands for 3 to 5), and of what a phone has.
PHONE_TYPES = {"Mobile": 55, "Work": 35, "Home": 10}
PHONE_COUNTS = {0: 40, 1: 45, 2: 10, 3: 5}
PHONE_TEMPLATES = {"both": 90, "number": 5, "type": 4, "none": 1}
NAME_SHARE = 0.8
MAX_PHONES, PHONE_LIMIT, MAX_FILLERS = 5, 10**10, 8
FIRST_NAMES = "Ada Ben Cleo Dev Eva Finn Gita Hugo Ines Jon Kira Leo Maya Nils Opal Per Quinn Rosa Sam Tara Uma Vik Wren Xia Yan Zoe".split()
LAST_NAMES = "Abel Berg Cole Diaz Eng Fox Gray Hale Iyer Jain Katz Lund Moss Nair Ohm Pace Quist Rao Stone Toft Urban Vale West Xu York Zorn".split()


def titles(spark: SparkSession, n: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(id, title): 3 to 8 filler words and each control word with its probability, in random order."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    key = F.col("id")
    n = between(key, 3, MAX_FILLERS, seed, "n")
    word = lambda order, w: F.struct(F.xxhash64(key, F.lit(seed), *order).alias("o"), w.alias("w"))
    # Fixed numbers of places, null where there is no word, stay within generated code; lambdas over lists don't.
    filler = [F.when(n >= i, word((F.lit("o"), F.lit(i)), pick(FILLER_WORDS, uniform(key, seed, "w", i)))) for i in range(1, MAX_FILLERS + 1)]
    control = [F.when(uniform(key, seed, w) < share, word((F.lit(w),), F.lit(w))) for w, share in CONTROL_WORDS.items()]
    words = F.sort_array(F.array(*filler, *control))
    return ids.select("id", F.array_join(words["w"], " ").alias("title"))


def _templates(key: Column, seed: int) -> Column:
    """What each phone of a contact has: both, number, type or none; NULL for no phones."""
    low = weighted(uniform(key, seed, "count"), PHONE_COUNTS)
    n = F.when(low == 3, between(key, 3, MAX_PHONES, seed, "many")).otherwise(low)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: weighted(uniform(key, seed, "template", i), PHONE_TEMPLATES)))


def _has_number(template: Column) -> Column:
    return template.isin("both", "number")


def _phones(key: Column, seed: int, templates: Column, first: Column) -> Column:
    """The list of a contact: NULL, never empty; ``first`` is the number of its first phone that has one."""
    return F.transform(templates, lambda t, i: F.struct(
        F.when(_has_number(t), phone_number(first + F.size(F.filter(F.slice(templates, 1, i), _has_number)))).alias("number"),
        F.when(t.isin("both", "type"), weighted(uniform(key, seed, "kind", i), PHONE_TYPES)).alias("phone_type"),
    ))


def _name(key: Column, seed: int) -> Column:
    full = F.concat_ws(" ", pick(FIRST_NAMES, uniform(key, seed, "first")), pick(LAST_NAMES, uniform(key, seed, "last")))
    return F.when(uniform(key, seed, "named") < NAME_SHARE, full)


def count_up(batch: str, order: str, amount: Column, base: Column) -> Column:
    """Contiguous numbers in each batch: ``base`` and the amounts of the rows before, in ``order``."""
    w = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return base + F.coalesce(F.sum(amount).over(w), F.lit(0))


def batch_bounds(df: DataFrame, batch: str, number: str) -> DataFrame:
    """The first and last number of each batch, and how many it has."""
    return df.groupBy(batch).agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(number).alias("numbers"))


def contacts_in_batches(spark: SparkSession, n: int, batch_size: int = 4096, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """n contacts and their batch.  Phone numbers are unique: the present ones of batch b count up from
    b * batch_size * 5, in row order.

    Batches are a range that is partitioned by their number, and so are the contacts exploded from them: the running
    count is a window over the batch that needs no shuffle.
    """
    batches = -(-n // batch_size)
    rng = spark.range(0, batches, 1, min(batches, partitions)) if partitions and batches else spark.range(batches)
    rows = F.least(F.lit(n) - F.col("id") * batch_size, F.lit(batch_size))
    drafts = rng.select("id", F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("at"))
    key = F.col("id") * batch_size + F.col("at")
    made = drafts.select("id", "at", _templates(key, seed).alias("kinds"))
    has = F.coalesce(F.size(F.filter("kinds", _has_number)), F.lit(0))
    made = made.withColumn("first", count_up("id", "at", has, F.col("id") * (batch_size * MAX_PHONES)))
    return made.select(F.col("id").alias("batch"), _name(key, seed).alias("name"), _phones(key, seed, F.col("kinds"), F.col("first")).alias("phones"))


def contacts(spark: SparkSession, n: int, batch_size: int = 4096, seed: int = 0, partitions: int | None = None) -> DataFrame:
    return contacts_in_batches(spark, n, batch_size, seed, partitions).select("name", "phones")


# The parallel sink --------------------------------------------------------------------------------------------------


class PipelineConfigError(ValueError):
    pass


#: What a wrong configuration is told.
NO_WRITERS = "Number of writers must be greater than zero."
NO_PRODUCERS = "No. of producer threads must be greater than zero. Total threads: {threads}. Writer threads: {writers}."
NO_SCHEMA = "The pipeline config is missing an Arrow schema definition."
TOO_MANY = (
    "Configuration error: The requested number of target_records ({records}) is too high. "
    "Based on the system's capacity of {capacity} unique phone numbers and a maximum of {most} phones per record, "
    "the limit for target_records is {limit}. Please adjust the configuration."
)


@dataclass(frozen=True)
class PipelineConfig:
    """Checked when made: writers, producers, schema, records, in this order."""

    target_records: int = 10_000_000
    num_writers: int = 4
    record_batch_size: int = 4096
    output_dir: str = "output_parquet"
    output_filename: str = "contacts"
    schema: T.StructType = field(default_factory=lambda: schemas.CONTACTS)
    total_threads: int = field(default_factory=lambda: os.cpu_count() or 1)

    def __post_init__(self) -> None:
        if self.num_writers == 0:
            raise PipelineConfigError(NO_WRITERS)
        if self.num_producers == 0:
            raise PipelineConfigError(NO_PRODUCERS.format(threads=self.total_threads, writers=self.num_writers))
        if not self.schema.fields:
            raise PipelineConfigError(NO_SCHEMA)
        if self.target_records * MAX_PHONES >= PHONE_LIMIT:
            raise PipelineConfigError(TOO_MANY.format(records=self.target_records, capacity=PHONE_LIMIT, most=MAX_PHONES, limit=PHONE_LIMIT // MAX_PHONES))

    @property
    def num_producers(self) -> int:
        return max(0, self.total_threads - self.num_writers)

    @property
    def total_batches(self) -> int:
        return -(-self.target_records // self.record_batch_size)


#: What a generator is: (spark, records, batch size) to rows of the configured schema after their batch, a whole number.
Generator = Callable[[SparkSession, int, int], DataFrame]


def write_parallel(spark: SparkSession, config: PipelineConfig, generator: Generator = contacts_in_batches) -> dict[str, float]:
    """Write the files ``{output_filename}_{i}.parquet`` of ``output_dir``, and measure.

    Batch i goes to file i mod ``num_writers``; a file that gets no batch isn't written.  Each file is one task's, and
    they are moved to their names when all are whole.
    """
    began = time.perf_counter()
    rows = generator(spark, config.target_records, config.record_batch_size)
    first, *fields = rows.schema.fields
    own = T.StructType(fields).simpleString()
    if first.name != "batch" or own != config.schema.simpleString():
        raise PipelineConfigError(f"the generator's schema {rows.schema.simpleString()} isn't batch and {config.schema.simpleString()}")
    n = config.num_writers
    file = F.pmod("batch", F.lit(n)).cast("int")
    dealt = rows.withColumn("_file", file).repartitionById(n, "_file").drop("batch")
    folder = f"{config.output_dir}/.{config.output_filename}"
    dealt.write.partitionBy("_file").mode("overwrite").parquet(folder)
    size = 0
    for i in range(min(n, config.total_batches)):
        (written, length), *_ = list_files(spark, f"{folder}/_file={i}", ".parquet")
        move(spark, written, f"{config.output_dir}/{config.output_filename}_{i}.parquet")
        size += length
    remove(spark, folder)
    seconds = time.perf_counter() - began
    return {"records": config.target_records, "bytes": size, "seconds": seconds, "records_per_sec": config.target_records / seconds, "gb_per_sec": size / 1e9 / seconds}


def write_single(df: DataFrame, folder: str, name: str = "contacts") -> str:
    """All rows as the one file ``{name}.parquet`` of a folder."""
    return write_file(df, f"{folder}/{name}.parquet")


def docs_name(n: int, indexed: bool = False) -> str:
    return f"docs_with_fts_index_{n}.parquet" if indexed else f"docs_{n}.parquet"
