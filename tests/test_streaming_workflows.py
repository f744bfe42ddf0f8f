from labelscope.operators.flows import flow_counts
from labelscope.operators.labels import normalize_labels
from labelscope.plans import workflows
from labelscope.streaming.ingest import labelled_sentences, land_sentences, stream_raw

TEXTS = [
    '[{"sentence":"a","aspect":"x","aspect_category":"env","sentiment":"pos","tone":"pledge"},'
    '{"sentence":"b","aspect":"y","aspect_category":"env","sentiment":"pos","tone":"result"},'
    '{"sentence":"c","aspect":"y","aspect_category":"E","sentiment":"good","tone":"result"}]',
    "no json",
    '{"sentence":"d","aspect":null,"aspect_category":"soc","sentiment":"neg","tone":"action"}',
]


def raw(spark, texts, start=0):
    data = [(start + i, "f", 1, "p/m", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "row_id long, filename string, page_number long, model string, text string")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("raw", "out", "check"))
    raw(spark, TEXTS).write.parquet(source)
    stream = stream_raw(spark, source, raw(spark, []).schema)
    land_sentences(stream, table, checkpoint).awaitTermination()
    raw(spark, TEXTS, start=10).write.mode("append").parquet(source)
    for _ in range(2):  # the second time nothing new is there
        land_sentences(stream, table, checkpoint).awaitTermination()
    columns = ["row_id", "pos", "sentence", "provider", "aspect_category_norm", "tone_norm"]
    landed = spark.read.parquet(table).select(columns)
    batch = labelled_sentences(spark.read.parquet(source)).select(columns)
    assert landed.count() == 10 and landed.exceptAll(batch).count() == 0


def test_from_answers_to_rarest_tone(spark):
    sentences = workflows.annotate(raw(spark, TEXTS))
    assert sentences.count() == 5
    tones = workflows.rarest_tones(sentences.filter("pos IS NOT NULL"))
    assert [tuple(r) for r in tones.collect()] == [
        ("E", "POSITIVE", "COMMITMENT", 1, 3), ("S", "NEGATIVE", "ACTION", 1, 1),
    ]


def test_balanced_dataset(spark):
    flat = spark.range(300).selectExpr(
        "id AS row_id", "IF(id % 3 = 0, 'env', 'soc') AS aspect_category", "'pos' AS sentiment",
        "IF(id % 10 = 0, 'pledge', 'action') AS tone")
    out = workflows.balanced_dataset(flat, 8)
    groups = {(r.target_aspect, r.target_tone): r["count"] for r in out.groupBy("target_aspect", "target_tone").count().collect()}
    assert groups == {("E", "COMMITMENT"): 8, ("S", "COMMITMENT"): 8}


def test_evaluate(spark):
    gt = spark.createDataFrame([(1, "s", "E", "pos", "x"), (2, "t", "E", "neg", "y")], "row_id long, sentence string, aspect_category string, sentiment string, tone string")
    result = workflows.evaluate(gt, gt.withColumn("tone", gt.sentiment))
    assert result.aligned.count() == 2 and result.coverage.first().coverage_gt == 100.0
    assert {r.target: r.accuracy for r in result.metrics.collect()} == {"aspect_category": 1.0, "sentiment": 1.0, "tone": 0.0}
    assert result.errors["tone"].count() == 2


def test_no_python_and_one_shuffle_from_answers_to_counts(spark, tmp_path):
    raw(spark, TEXTS).write.parquet(str(tmp_path / "r"))
    sentences = workflows.annotate(spark.read.parquet(str(tmp_path / "r")))
    plan = flow_counts(normalize_labels(sentences))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1
    scanned = plan.split("ReadSchema: ")[1]
    assert scanned.startswith("struct<text:string>")
