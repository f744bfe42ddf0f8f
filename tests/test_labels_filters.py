import pytest

from labelscope.operators import distributions as dist
from labelscope.operators import filters
from labelscope.operators.labels import normalize_labels, with_labels
from labelscope.sources.ontologies import ASPECTS, SENTIMENTS, TONES


@pytest.fixture(scope="module")
def flat(spark):
    rows = [
        (0, "a.pdf", "s0", "ENV", "pos", "pledge", 0.1),
        (1, "a.pdf", None, " env ", "NEGATIVE", "result", 0.5),
        (2, "b.pdf", "s2", "esg", None, "neutral", None),
        (3, "b.pdf", "s3", None, "none", "pledge", 0.9),
        (4, None, "s4", "zzz", "pos", None, 0.3),
    ]
    return spark.createDataFrame(
        rows, "row_id long, filename string, sentence string, aspect_category string, sentiment string, tone string, confidence double"
    )


def test_normalize_and_label(flat, rows):
    out = with_labels(normalize_labels(flat, keep_raw=True))
    got = rows(out, "row_id", "aspect_category_raw", "aspect_category_norm", "sentiment_label", "tone_norm")
    assert got == [
        (0, "ENV", "E", "Positive", "COMMITMENT"),
        (1, " env ", "E", "Negative", "OUTCOME"),
        (2, "esg", "E-S-G", "Other / Unclassified", "OTHER"),
        (3, None, "OTHER", "Other / Unclassified", "COMMITMENT"),
        (4, "zzz", "OTHER", "Positive", "OTHER"),
    ]
    upper = normalize_labels(flat, {"aspect_category": None})
    assert rows(upper, "row_id", "aspect_category_norm")[1] == (1, "ENV")


def test_apply_filters(flat, rows):
    def ids(**kw):
        return [r[0] for r in rows(filters.apply_filters(flat, **kw), "row_id")]

    assert ids(selections={}) == [0, 1, 2, 3, 4]
    assert ids(selections={"sentiment": [], "absent": ["x"]}) == [0, 1, 2, 3, 4]
    assert ids(selections={"sentiment": filters.ANY_VALUE, "tone": filters.ANY_VALUE}) == [0, 1, 3]
    assert ids(selections={"sentiment": ["pos"], "row_id": ["0", "4", "x"]}) == [0, 4]
    assert ids(selections={}, confidence=(0.1, 0.5)) == [0, 1, 4]


def test_other_filters(flat, rows, spark):
    assert rows(filters.drill_down(flat, filename="a.pdf", row_id="1"), "row_id") == [(1,)]
    assert rows(filters.waterfall_filter(flat, filename="b.pdf", tone=filters.ALL), "row_id") == [(2,), (3,)]
    tones = spark.createDataFrame([("E", "POSITIVE", "ACTION", 1)], "aspect_category string, sentiment string, minimum_tone string, n int")
    assert filters.filter_tone_table(tones, ["E"], ["POSITIVE"], ["ACTION", "x"]).count() == 1
    assert filters.filter_tone_table(tones, ["E"], [], ["ACTION"]).count() == 0
    options = rows(filters.filter_options(flat, ["sentiment", "row_id", "absent"]))
    assert ("sentiment", "none") in options and ("row_id", "4") in options and len(options) == 8
    assert filters.confidence_bounds(flat).first() == (0.1, 0.9)


def test_counts_and_tops(flat, rows):
    assert [tuple(r) for r in dist.value_counts(flat, "sentiment").collect()] == [("pos", 2), ("NEGATIVE", 1), ("none", 1)]
    top = dist.top_values(flat, "tone", 2, fill="UNKNOWN")
    assert rows(top) == [("UNKNOWN", 1, 2), ("pledge", 2, 1)]
    norm = normalize_labels(flat)
    dense = [tuple(r) for r in dist.label_distribution(norm, "tone_norm", TONES).collect()]
    assert dense == [("OUTCOME", 1, "Outcome", 0), ("ACTION", 0, "Action", 1), ("COMMITMENT", 2, "Commitment", 2), ("OTHER", 2, "Other / Unclassified", 3)]
    table = {r.aspect_category_norm: (r["count"], r.percentage, r.label) for r in dist.category_table(norm, "aspect_category_norm", ASPECTS).collect()}
    assert table == {"E": (2, 40.0, "Environmental"), "E-S-G": (1, 20.0, "Environmental, Social & Governance"), "OTHER": (2, 40.0, "Other / Unclassified")}
    assert {r.label for r in dist.category_table(flat, "tone").collect()} == {"❓ Not in ontology"}


def test_flags(spark, rows):
    df = spark.createDataFrame([("E", 0.99), ("S", 1.0), ("OTHER", 50.0), ("NONE", 40.0)], "c string, percentage double")
    assert rows(filters.flag_categories(df, "c"), "c") == [("E",), ("OTHER",)]
    assert rows(filters.flag_categories(df, "c", fallback=("NONE",)), "c") == [("E",), ("NONE",)]


def test_crosstabs(flat, rows):
    norm = normalize_labels(flat)
    long = dist.crosstab_long(norm, ("aspect_category_norm", "a", ASPECTS), ("sentiment_norm", "s", SENTIMENTS))
    assert ("E", "POSITIVE", 1, "Environmental", "Positive") in rows(long)
    wide = dist.crosstab_wide(norm, "aspect_category_norm", ASPECTS, "sentiment_norm", SENTIMENTS).collect()
    assert [r.aspect_category_norm for r in wide] == ASPECTS.order
    assert wide[0].Positive == 1 and wide[0].Negative == 0  # the negative row has no sentence
    assert wide[1].Positive is None  # no social row at all


def test_tokens(spark, rows):
    df = spark.createDataFrame([("Net-zero by 2040, net!",), (None,)], "sentence string")
    assert rows(dist.token_counts(df)) == [("2040", 1), ("by", 1), ("net", 2), ("zero", 1)]
    words = spark.createDataFrame([("Für größere Übung: año_1, Ελλάδα 中文",)], "sentence string")
    assert {r.token for r in dist.token_counts(words).collect()} == {"für", "größere", "übung", "año_1", "ελλάδα", "中文"}


def test_shares_have_no_single_partition_ahead_of_the_total(spark):
    df = spark.range(100).selectExpr("string(id % 7) AS v").repartition(3)
    table = dist.category_table(df, "v")
    assert sum(r["count"] for r in table.collect()) == 100
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_filters_reach_the_scan(spark, tmp_path, flat):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    flat.write.parquet(path)
    df = filters.apply_filters(spark.read.parquet(path), {"sentiment": ["pos"], "row_id": ["4"]}, confidence=(0.0, 0.5))
    plan = df.select("tone")._jdf.queryExecution().executedPlan().toString()
    for pushed in ("EqualTo(sentiment,pos)", "EqualTo(row_id,4)", "LessThanOrEqual(confidence,0.5)"):
        assert pushed in plan
    assert "sentence" not in plan.split("ReadSchema")[1]
