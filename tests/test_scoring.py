import math
import uuid

import pytest
from pyspark.sql import functions as F

from labelscope.operators import scoring


def two_heads():
    def score(texts):
        return [[float(len(t)), 0.0, 1.0, 0.5] for t in texts], [[0.0, float(t.count("x")), 0.5] for t in texts]

    return score


def test_decode(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([-1000.0, 1000.0, 0.0],), (None,)], "l array<double>")
    scores, best = scoring.decode_scores(F.col("l"), ["a", "b", "c"])
    one, two, three = df.select(scores.alias("s"), best.alias("b")).collect()
    total = math.e + 2 * math.e**3
    assert one.s == pytest.approx([math.e / total, math.e**3 / total, math.e**3 / total]) and one.b == "b"
    assert two.s == pytest.approx([0.0, 1.0, 0.0]) and two.b == "b"
    assert three.s is None and three.b is None


def test_score_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, "xx"), (3, None)], "id int, text string")
    got = {r.id: r for r in scoring.score_texts(df, two_heads).collect()}
    assert (got[1].sentiment, got[2].sentiment, got[3].sentiment) == ("negative", "positive", "negative")
    assert (got[1].tone, got[2].tone) == ("Outcome", "Commitment")
    assert len(got[2].sentiment_scores) == 4 and sum(got[2].tone_scores) == pytest.approx(1.0)
    assert got[3].text is None


def load(model_id):
    if model_id == "broken":
        raise RuntimeError("cannot load")

    def classify(texts):
        if any("bad" in t for t in texts):
            raise ValueError("cannot read")
        return [[("a", 0.25), (model_id, len(t) / 10), ("zz", len(t) / 10)] for t in texts]

    return classify


def test_models_errors_and_top(spark, rows):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "id int, text string").coalesce(1)
    out = scoring.score_models(df, [("One", "m1"), ("Two", "broken")], load)
    got = rows(out.drop("text"))
    assert got == [
        (1, "One", "m1", "a", 0.25, None), (1, "One", "m1", "m1", 0.4, None), (1, "One", "m1", "zz", 0.4, None),
        (1, "Two", "broken", "LOAD_ERROR", None, "cannot load"),
        (2, "One", "m1", "INFER_ERROR", None, "cannot read"),
        (2, "Two", "broken", "LOAD_ERROR", None, "cannot load"),
        (3, "One", "m1", "a", 0.25, None), (3, "One", "m1", "m1", 0.4, None), (3, "One", "m1", "zz", 0.4, None),
        (3, "Two", "broken", "LOAD_ERROR", None, "cannot load"),
    ]
    top = scoring.top_prediction_per_model(out, ("id", "model_id"))
    assert rows(top.drop("text")) == [(1, "One", "m1", "m1", 0.4, None), (3, "One", "m1", "m1", 0.4, None)]
    assert scoring.top_prediction_per_model(out).count() == 1


def test_a_scorer_is_loaded_once_per_worker(spark, tmp_path):
    def counted():
        (tmp_path / f"{uuid.uuid4().hex}").touch()
        return two_heads()

    df = spark.range(64, numPartitions=32).selectExpr("id", "string(id) AS text")
    assert scoring.score_texts(df, counted).count() == 64
    scoring.score_texts(df, counted).collect()
    assert 1 <= len(list(tmp_path.iterdir())) <= 4 * 2  # four workers, two plans, not 64 tasks


@pytest.fixture
def loaded(monkeypatch):
    monkeypatch.setattr(scoring, "_LOADED", scoring.OrderedDict())
    return scoring._LOADED


def test_scorers_of_ended_plans_are_let_go(loaded):
    calls = []
    get = lambda plan, model, most=2: scoring._once(plan, model, lambda: calls.append((plan, model)) or object(), most)
    first = get("p", "a")
    assert get("p", "a") is first and calls == [("p", "a")]
    get("p", "b")
    get("q", "a")  # the second plan lets one of the first go: the one used longest ago
    assert list(loaded) == [("p", "b"), ("q", "a")]
    get("q", "b")
    assert list(loaded) == [("q", "a"), ("q", "b")] and len(calls) == 4
    get("p", "a")  # a plan that goes on loads again
    assert len(calls) == 5 and len(loaded) == 2
    assert get("r", "x", 1) is not None and list(loaded) == [("r", "x")]


def test_a_failed_load_is_kept_as_its_text(loaded):
    calls = []

    def load():
        calls.append(1)
        raise RuntimeError("no weights")

    assert [scoring._once("p", "m", load) for _ in range(3)] == ["no weights"] * 3 and len(calls) == 1


def test_workers_keep_all_models_of_a_plan(spark, tmp_path):
    def counted(model_id):
        (tmp_path / f"{uuid.uuid4().hex}").touch()
        return load(model_id)

    df = spark.range(64, numPartitions=16).selectExpr("id", "string(id) AS text")
    models = [(f"M{i}", f"m{i}") for i in range(6)]  # more than a worker keeps of other plans
    assert scoring.score_models(df, models, counted).filter("label = model_id").count() == 64 * 6
    assert len(list(tmp_path.iterdir())) < 16 * 6  # as many as workers, not as tasks


@pytest.mark.parametrize("bad, most", [((), 1), ((300,), 21), ((0, 999), 41), (tuple(range(1000)), 1999)])
def test_a_failed_batch_is_halved(bad, most):
    calls = []

    def classify(texts):
        calls.append(len(texts))
        if any(t in marked for t in texts):
            raise ValueError("cannot read")
        return [[("a", float(t))] for t in texts]

    marked = {str(i) for i in bad}
    got = scoring._classify(classify, [str(i) for i in range(1000)])
    assert [e for _, e in got] == ["cannot read" if i in bad else None for i in range(1000)]
    assert all(found == [("a", float(i))] for i, (found, e) in enumerate(got) if e is None)
    assert len(calls) <= most


def test_a_classifier_that_loses_a_text_is_an_error():
    got = scoring._classify(lambda texts: [[("a", 1.0)]] * (len(texts) - ("x" in texts)), ["y", "x", "z"])
    assert [e is None for _, e in got] == [True, False, True] and got[1][1] == "0 results for 1 texts"


def test_calls_are_cut_by_length():
    texts = ["a" * 10, "", "b" * 25, "c", "d", "e" * 100, "f"]
    assert list(scoring._calls(texts, 30)) == [["a" * 10, ""], ["b" * 25, "c", "d"], ["e" * 100], ["f"]]
    assert list(scoring._calls([], 30)) == []


def test_only_the_text_goes_to_python(spark):
    df = spark.range(4).selectExpr("id", "string(id) AS text", "repeat('w', 100) AS wide")
    plan = scoring.score_texts(df, two_heads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
