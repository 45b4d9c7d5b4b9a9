import pytest

#: Rows that any operator must survive: nulls, empty and long texts, ties, repeats.
LONG = ("word " * 30_000).strip()
EDGES = [
    (None, None), (None, "a null id"), (1, None), (2, ""), (3, " \t\n \n"), (4, "x"), (5, "x"),
    (6, "same text here, line one\nline two"), (6, "same text here, line one\nline two"),
    (7, LONG), (8, "ünïcode ÀÉ 中文 😀 a b c"), (9, "\n\n\n"),
]


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents table with its columns, and columns whose names clash with results."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows as a table with extra columns named like results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, "doc_id long, text string")
    for name in ("line", "key", "score", "fp", "words", "length", "start", "h", "a", "doc", "n_lines",
                 "spans", "edited", "row", "sequence_id", "component_id", "group"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
