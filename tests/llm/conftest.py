"""Small tables with nulls, empty texts, repeats and columns of clashing names."""

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Texts that are null, empty, white space, marks, very long and repeated; and columns that operators make."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "... --- !!!"), (5, "one two three four five six seven"), (5, "one two three four five six seven"),
            (6, "one two three four five six seven"), (7, "word " * 30000), (None, "a text without an id"), (8, "\u0000 \U0010ffff é日本 'll've")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("score", "key", "hash", "words", "label", "node", "map", "slice", "region", "spans", "lang", "place", "id", "n"):
        frame = frame.withColumn(name, F.lit("x"))
    return frame
