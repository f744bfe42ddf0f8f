import os
from collections import Counter

import pytest

import __spark_entry__ as contract
from labelscope.plans import catalog
from labelscope.plans.derived import Derived
from labelscope.session import shared_path
from tests.oracle import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert difference(spark, con, FOLDER, contract.queries()[name], contract.oracle_sql()[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["aspect_category", "sentiment", "minimum_tone", "minimum_amount", "group_count"]
    assert df.count() > 0


def test_shared_folder_is_the_one_the_session_names():
    class Session:
        class conf:
            named = None

            @classmethod
            def get(cls, key, default=None):
                return cls.named if key == "spark.checkpoint.dir" else default

        class sparkContext:
            folder = None

            @classmethod
            def getCheckpointDir(cls):
                return cls.folder

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(Session, "t")
    Session.sparkContext.folder = "file:/context"
    assert shared_path(Session, "t").startswith("file:/context/t-")
    Session.conf.named = "hdfs://shared/x/"
    one, two = (shared_path(Session, "t") for _ in range(2))
    assert one.startswith("hdfs://shared/x/t-") and one != two


def test_base_tables_hold_whole_texts_and_all_rows(spark):
    from labelscope.plans.derived import Derived

    d = Derived(spark, FOLDER)
    pieces = d.ground.groupBy("row_id").count().join(d.documents.selectExpr("doc_id AS row_id", "length(text) AS n"), "row_id")
    assert pieces.filter("count <> ceil(n / 90)").count() == 0
    assert d.pred.filter("row_id < 1000000000").count() == d.gt.count()


def test_documents_are_cut_once(spark, tmp_path):
    """Sentences are the pieces of their documents, and no sentence walks through the text of its document again."""
    whole = [None, "", "x" * 89, "é" * 90, "a\r\n\u2028\U0001f600" * 30, "\U0001f600b" * 1500, "q" * 180]
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(whole)] + [(None, "n" * 400, None, None, 0), (3, "again" * 60, "de", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    ground = Derived(spark, str(tmp_path)).ground
    want = []
    for doc, text, lang, source, _ in docs:
        for k in range((max(len(text or ""), 1) - 1) // 90 + 1):
            piece = None if text is None else text[k * 90 : k * 90 + 90]
            if doc is not None and k % 4 == 2 and doc % 9 == 0:
                piece = None
            elif doc is not None and k % 4 == 3 and doc % 2 == 0:
                piece += "#"
            elif k % 32 == 7:
                piece = piece[:6]
            want.append((doc, k, source, lang, piece))
    assert Counter(map(tuple, ground.select("row_id", "pos", "filename", "aspect", "sentence").collect())) == Counter(want)
    assert ground.schema["pos"].dataType.simpleString() == "int"
    plan = ground._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "sequence(" not in plan
