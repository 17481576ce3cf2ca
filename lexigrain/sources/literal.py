"""Small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrain import schemas

#: The documents and contacts of the golden tests.
TINY_DOCS = [(0, "The Name of the Wind"), (1, "The Diary of Muadib"), (2, "A Dairy Cow"), (3, "A Dairy Cow"), (4, "The Diary of a Young Girl")]
TINY_CONTACTS = [
    ("Alice", [("555-1234", "Home"), ("555-5678", "Work")]),
    ("Bob", None),
    ("Charlie", []),
    ("Diana", [("555-9999", "Work")]),
    (None, [(None, "Home")]),
]


def docs(spark: SparkSession, rows: list[tuple[int, str]] = TINY_DOCS) -> DataFrame:
    return spark.createDataFrame(rows, schemas.DOCS)


def contacts(spark: SparkSession, rows: list[tuple] = TINY_CONTACTS) -> DataFrame:
    return spark.createDataFrame(rows, schemas.CONTACTS)
