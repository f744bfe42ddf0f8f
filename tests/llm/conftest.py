import datetime

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """A checkpoint folder, as a cluster has it."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs far away", "a"),
    (2, "THE QUICK brown fox jumps over the lazy dog and runs far away", "a"),
    (3, "", "b"),
    (4, None, None),
    (5, " \t\n ", None),
    (None, "no id here", "b"),
    (None, None, "b"),
    (6, "one\ntwo\nthree\nfour\none\ntwo\nthree\n", "c"),
    (7, "Größe 中文 année password = 'abcdefghijkl' +49 (30) 12345678 x@y.zz 10.0.0.1", "c"),
    (8, "word " * 30_000, "c"),
    (9, "x" * 100_000, "c"),
    (10, "1" * 50_000 + " a@" + "b" * 50_000, "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns that clash with results."""
    when = datetime.date(2024, 1, 1)
    rows = [(*row, 0, "k", 1.5, [1], when) for row in AWKWARD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, size int, kept string, score double, taken array<int>, node date"
    ).selectExpr("*", "'de' AS lang", "1 AS row", "'x' AS digest", "2 AS key", "3 AS id", "4 AS maybe", "5 AS n_hit").repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "quick brown fox jumps over the lazy dog and runs far"), (2, "Größe 中文"), (3, None), (4, ""), (None, "année PASSWORD")],
        "item_id long, text string",
    )
