import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from labelscope.defaults import ASPECT_ONTOLOGY, CLUSTERS, SENTIMENT_ONTOLOGY, SIX_CLUSTERS, TONE_ONTOLOGY
from labelscope.functions.text import strip
from labelscope.operators.labels import normalize_labels
from labelscope.session import configure
from labelscope.sources import ontologies, sinks, tables


def put(path, text):
    path.write_text(text, encoding="utf8")
    return str(path)


def test_scan_with_quotes_breaks_and_na(spark, tmp_path):
    path = put(tmp_path / "b.csv", ' Filename ,PAGE_NUMBER,model,text\n'
               'x.pdf,1,a/b,"line 1\nsays ""hi"", ok"\nNA,2.0,None,none\nnan,x,n/a," kept "\n')
    put(tmp_path / "a.csv", "filename,page_number,model,text\nfirst.pdf,9,m,t\n")
    df = tables.read_annotations(spark, [path, str(tmp_path / "a.csv")])
    got = [tuple(r) for r in df.orderBy("row_id").select("filename", "page_number", "model", "text").collect()]
    assert got == [
        ("first.pdf", 9, "m", "t"),
        ("x.pdf", 1, "a/b", 'line 1\nsays "hi", ok'),
        (None, 2, None, "none"),
        (None, None, None, " kept "),
    ]
    assert df.select("row_id").distinct().count() == 4


def test_first_available(spark, tmp_path):
    path = put(tmp_path / "x.csv", " A ,b\n1,NA\n")
    df, tag = tables.read_first_available(spark, [("uploaded", None), ("remote", str(tmp_path / "no.csv")), ("local", path)])
    assert tag == "local" and [tuple(r) for r in df.collect()] == [("1", None, "local", "x.csv")]
    assert tables.read_first_available(spark, [("local", str(tmp_path / "none"))]) == (None, "missing")


def test_checks_and_hardening(spark):
    df = tables.normalize_columns(spark.createDataFrame([(1, None)], "` Filename ` int, MODEL string"))
    assert df.columns == ["filename", "model"]
    assert tables.validate_columns(df, ["model"]) is df
    with pytest.raises(ValueError, match="tone"):
        tables.validate_columns(df, ["model", "tone"])
    assert tables.harden_schema(df).first() == ("1", None)
    nums = spark.range(100).withColumnRenamed("id", "row_id").repartition(3)
    assert [r.row_id for r in tables.preview(nums, 3).collect()] == [0, 1, 2]
    assert tables.record_count(nums).first().records == 100


def test_csv_sink_keeps_text(spark, tmp_path):
    texts = ['a "quoted"\nline', " padded ", None, "back\\slash", "comma, here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, multiLine=True, escape='"', emptyValue="")
    assert {int(r.i): r.t for r in back.collect()} == dict(enumerate(texts))


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("E", 2, 0), ("S", None, 1)], "aspect string, count int, ord int")
    sinks.write_label_summaries({"aspect": df.drop("ord")}, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "aspect_summary")).count() == 2
    document = json.loads(sinks.records_document(df, "ord").first().document)
    assert document == [{"aspect": "E", "count": 2}, {"aspect": "S"}]
    lines = spark.range(50).select(F.format_string("%03d", "id").alias("line")).orderBy("line")
    sinks.write_lines(lines, str(tmp_path / "lines"))
    parts = sorted((tmp_path / "lines").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text.split() == [f"{i:03d}" for i in range(50)]


LABELS = [
    (" governance ", "G"), ("ECONOMIC", "E"), ("E/S", "E-S"), ("\tesg ", "E-S-G"), ("g>", "G"),
    ("", "OTHER"), (None, "OTHER"), ("W", "OTHER"), ("never seen", "OTHER"),
]


def test_default_ontologies(spark):
    df = spark.createDataFrame(LABELS, "v string, w string")
    assert df.filter(~ontologies.ASPECTS.code_of(F.col("v")).eqNullSafe(F.col("w"))).count() == 0
    one = spark.range(1)
    assert one.select(ontologies.SENTIMENTS.code_of(F.lit("none"))).first()[0] == "OTHER"
    assert one.select(ontologies.SENTIMENTS.code_of(F.lit("Neural"))).first()[0] == "NEUTRAL"
    assert one.select(ontologies.TONES.code_of(F.lit("neutral"))).first()[0] == "OTHER"
    assert one.select(ontologies.TONES.label_of(F.lit("ACTION"))).first()[0] == "Action"
    assert one.select(ontologies.TONES.label_of(F.lit("xyz"))).first()[0] == "xyz"
    sizes = [len(o.aliases) for o in (ontologies.ASPECTS, ontologies.SENTIMENTS, ontologies.TONES)]
    assert sizes == [35, 17, 18]


def test_strip_equals_python(spark):
    ends = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["​", "x"]
    df = spark.createDataFrame([(e + "a" + e,) for e in ends], "v string")
    assert [r[0] for r in df.select(strip(F.col("v"))).collect()] == [(e + "a" + e).strip() for e in ends]


def test_loaded_ontology_and_large_one(spark, tmp_path, rows):
    document = {"A": {"label": "Aa", "aliases": ["x", None, " Y "]}, "B": {"label": "Bb", "aliases": ["X"]}}
    loaded = ontologies.load_ontology(spark, put(tmp_path / "o.json", json.dumps(document)))
    assert loaded.order == ["A", "B"] and loaded.aliases == {"x": "B", "y": "A"}
    dim = rows(ontologies.alias_dim(spark, loaded))
    assert dim == [("x", "B", "Bb", 1), ("y", "A", "Aa", 0)]

    from labelscope.operators.labels import normalize_labels

    large = ontologies.Ontology.of({"N": ("Numbers", [f"n{i}" for i in range(1000)])})
    df = spark.createDataFrame([(" N7 ",), ("n1000",), (None,)], "v string")
    for form in (large, ontologies.alias_dim(spark, large)):
        assert rows(normalize_labels(df, {"v": form}), "v_norm") == [("N",), ("OTHER",), ("OTHER",)]
    table = ontologies.ontology_table(spark, put(tmp_path / "t.json", json.dumps(document)))
    assert rows(table, "alias_key", "canonical", "label", "ord") == dim


def test_cluster_document(spark, tmp_path):
    path = put(tmp_path / "c.json", json.dumps({"Z": ["zz"], "A": ["a"]}))
    assert list(ontologies.load_clusters(spark, path)) == ["Z", "A"]


def test_fixed_tables_are_whole():
    assert len(CLUSTERS) == 19 and sum(map(len, CLUSTERS.values())) == 305
    assert len({w for words in CLUSTERS.values() for w in words}) == 293
    assert len(SIX_CLUSTERS) == 6 and sum(map(len, SIX_CLUSTERS.values())) == 26
    assert [sum(len(a) for _, a in t.values()) for t in (ASPECT_ONTOLOGY, SENTIMENT_ONTOLOGY, TONE_ONTOLOGY)] == [36, 22, 19]


def test_row_ids_are_dense_and_the_same_for_any_number_of_files(spark, tmp_path):
    lines = [f"m{i % 3},{i:03d}" for i in range(200)]
    for name, cuts in (("one", [200]), ("many", [3, 50, 51, 120, 200])):
        (tmp_path / name).mkdir()
        for i, (a, b) in enumerate(zip([0, *cuts], cuts)):
            put(tmp_path / name / f"{i:02d}.csv", "\n".join(["model,text", *lines[a:b], ""]))
        df = tables.read_annotations(spark, str(tmp_path / name))
        assert [r.text for r in df.orderBy("row_id").collect()] == [f"{i:03d}" for i in range(200)]
        assert sorted(r.row_id for r in df.select("row_id").collect()) == list(range(200))


def test_a_source_that_fails_is_passed_over(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    good = put(tmp_path / "x.csv", "a\n1\n")
    candidates = [("empty", str(tmp_path / "empty")), ("store", "nowhere://host/x.csv"), ("good", good)]
    assert tables.read_first_available(spark, candidates)[1] == "good"
    assert tables.read_first_available(spark, candidates[:2]) == (None, "missing")


@pytest.mark.parametrize("name, data", [
    ("empty.csv", b""), ("lines.csv", b"\n\n\n"), ("blanks.csv", b",,\n1,2,3\n"), ("empty.csv.gz", b""),
    ("cut.csv.gz", gzip.compress(random.Random(1).randbytes(60_000).hex().encode())[:2000]), ("noise.csv.gz", b"not packed at all"),
])
def test_hollow_source_sends_the_search_on(spark, tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    (tmp_path / "good.csv").write_text("a,b\n1,2\n")
    df, tag = tables.read_first_available(spark, [("uploaded", str(tmp_path / name)), ("local", str(tmp_path / "good.csv"))])
    assert tag == "local" and df.columns == ["a", "b", "source_tag", "source_file"] and df.count() == 1
    assert tables.read_first_available(spark, [("uploaded", str(tmp_path / name))]) == (None, "missing")


def test_header_alone_and_half_named_headers_are_tables(spark, tmp_path):
    (tmp_path / "head.csv").write_text("a,b\n")
    (tmp_path / "half.csv").write_text("a,\n1,2\n")
    df, tag = tables.read_first_available(spark, [("head", str(tmp_path / "head.csv"))])
    assert tag == "head" and df.count() == 0 and df.columns[:2] == ["a", "b"]
    assert tables.read_first_available(spark, [("half", str(tmp_path / "half.csv"))])[1] == "half"


def test_join_with_a_dimension_spreads_hot_and_missing_labels(spark):
    """Half the labels missing, a third alike, the rest unknown: no task of the join gets a large share."""
    own = configure(spark.newSession())
    for key, value in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}.items():
        own.conf.set(key, value)
    rows = own.range(48_000).selectExpr("id", "CASE id % 6 WHEN 0 THEN ' ENV ' WHEN 1 THEN 'env' WHEN 2 THEN 'nobody knows' END AS aspect_category", "map('k', id) AS m")
    dim = ontologies.alias_dim(own, ontologies.ASPECTS)
    joined = normalize_labels(rows, {"aspect_category": dim})
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    sizes = [r[0] for r in joined.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 3 * 48_000 / 16 and sum(sizes) == 48_000
    assert {r.aspect_category_norm: r["count"] for r in joined.groupBy("aspect_category_norm").count().collect()} == {"E": 16_000, "OTHER": 32_000}
