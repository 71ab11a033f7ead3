import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
A = "the quick brown fox jumps over the lazy dog near the old river bank today\nand a second line that is long enough to count here"
EDGE = [
    (1, A, "en", "s1", 10), (2, A, "en", "s1", 10), (2, A, "en", "s1", 10), (3, None, "en", None, 0), (4, "", None, "s2", 0),
    (5, " \t\n ", "de", "s2", 3), (6, "ÄÖ  x\x1cy 😀 " * 3, "de", "", 9), (None, "word " * 40, None, "s1", 1), (7, None, None, None, None),
    (8, "lorem ipsum dolor " * 9000, "fr", "s3", 5), (9, A.replace("quick", "slow"), "en", "s1", 10),
]


def documents(spark, rows=EDGE):
    """Small table with every odd case, and with columns named like those the operators use inside."""
    df = spark.createDataFrame(rows, COLUMNS)
    for name in ("key", "row", "node", "component", "fp", "lid", "size", "whole", "nth", "gone", "lines", "_row", "_key", "_u1", "_text", "_doc", "score", "a", "b"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture
def edge(spark):
    return documents(spark)


@pytest.fixture
def empty(spark):
    return documents(spark).where("doc_id = -1")


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
