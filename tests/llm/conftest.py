import pytest

#: Rows that every operator on documents must stand: nulls, empty and blank texts, repeats, an extra column.
ODD = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "  \n ", "x"), (None, "a b c", "x"),
       (None, None, None), (5, "word " * 30_000, "x"), (6, "é😀 ü\x00 z", "x")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score string").repartition(2)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
