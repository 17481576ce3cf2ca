import pytest

SF = "/root/testdata/sf0.001"
LONG = "word%d " * 30
#: Names that operators use inside; tables may have them as well.
EXTRA = ["size", "key", "row", "bytes", "hash", "digest", "n", "part", "rank", "kept", "owner", "score", "media", "ids", "root", "u", "v", "length", "bucket", "target", "_row", "_id", "text_hash", "count"]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source): nulls everywhere, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 5000} {i}" for i in range(40_000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the noise of the town"
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, base, "b"), (5, base, "b"), (5, base, "b"), (6, base.replace(" ", "\n\n"), None),
        (7, base + " tonight", "c"), (8, long, "a"), (9, long + " end", "d"), (10, "x" * 50_000, "b"), (11, "short text", "c"),
        (None, "short text", "c"), (None, base, None), (None, None, None), (12, "one", "é"), (13, "a " * 3000, "a"), (14, base.upper(), "z"),
        (15, "<|endoftext|> 漢字 🎉 \x00   \x85x", "b"), (16, base + "\r\n\x0b\x0c" + base, "b"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, source string").repartition(3)
    return df.withColumns({c: F.lit(7) for c in EXTRA}).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
