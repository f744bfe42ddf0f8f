import json
import random

import pytest

from labelscope.operators.parsing import (
    extra_keys, parse_annotations, parse_report, sentence_table, with_provider,
)

CASES = [
    (' ```json\n[{"sentence":"a","aspect":"b"}]\n``` ', [("a", "b")]),
    ('{"sentence":"a","aspect":"b"}', [("a", "b")]),
    ('[1,[{"sentence":"q","aspect":null},[[{"sentence":"r","aspect":"z","m":{"k":3}}]]],{"sentence":"n"}]',
     [("q", None), ("r", "z")]),
    ('{"a":1} y {"b":2}', []),
    ('[1] note {"sentence":"s","aspect":"t"}', []),
    ('Sure [see below]: [{"sentence":"a","aspect":"b"}]', []),
    ("[{'sentence':'a','aspect':'b'}]", []),
    ('{"sentence":"a","sentence":"c","aspect":"b"}', [("c", "b")]),
    ("[" * 12 + '{"sentence":"deep","aspect":"x"}' + "]" * 12, [("deep", "x")]),
    ('[{"sentence":"has [1] and ] in it","aspect":"["}]', [("has [1] and ] in it", "[")]),
    ('[{"sentence":"a","aspect":"b"},]', []),
    ("[]", []), ("", []), (None, []), ("none", []),
]


def raw(spark, texts):
    return spark.createDataFrame(
        [(i, "f", 1, "p/m", t) for i, t in enumerate(texts)],
        "row_id long, filename string, page_number long, model string, text string",
    )


def test_hand_made_answers(spark):
    df = raw(spark, [t for t, _ in CASES])
    got = {}
    for r in parse_annotations(df).orderBy("row_id", "pos").collect():
        got.setdefault(r.row_id, []).append(None if r.pos is None else (r.sentence, r.aspect))
    for i, (_, wanted) in enumerate(CASES):
        assert got[i] == (wanted or [None]), CASES[i][0]
    counts = {r.row_id: r.parsed_objects for r in parse_report(df).collect()}
    assert counts == {i: len(w) for i, (_, w) in enumerate(CASES)}


def test_fields_types_and_extras(spark):
    texts = [
        '{"sentence":"s","aspect":{"x":1},"confidence":"0.5","sentiment_score":2,"tone":[1,2],"model":"m2","n":{"k":3}}',
        '{"sentence":"{brace","aspect":"b","confidence":"high"}',
    ]
    one, two = parse_annotations(raw(spark, texts)).orderBy("row_id").collect()
    assert (one.aspect, one.confidence, one.sentiment_score, one.tone) == (None, 0.5, 2.0, "[1,2]")
    assert one.model == "p/m" and json.loads(one.extras.toJson()) == {"aspect": {"x": 1}, "model": "m2", "n": {"k": 3}}
    assert (two.sentence, two.confidence) == ("{brace", None) and json.loads(two.extras.toJson()) == {"confidence": "high"}
    keys = {(r.key, r["count"]) for r in extra_keys(parse_annotations(raw(spark, texts))).collect()}
    assert keys == {("model", 1), ("n", 1), ("aspect", 1), ("confidence", 1)}


@pytest.mark.parametrize("value", ['{"label": "POS"}', '[{"a": 1}]', "true", "1.5", '"x"', "null"])
@pytest.mark.parametrize("field", ["sentiment", "confidence"])
def test_no_value_of_a_known_field_is_lost(spark, field, value):
    row = parse_annotations(raw(spark, ['{"sentence":"a","aspect":"b","%s":%s}' % (field, value)])).first()
    kept = json.loads(row.extras.toJson()).get(field)
    if value == "null":
        assert row[field] is None and kept is None
    else:
        assert (row[field] is None) == (kept is not None)
        assert kept is None or kept == json.loads(value)


def test_brackets_in_many_annotations_cost_little(spark):
    import time

    def seconds(cite):
        text = "[" + ",".join('{"sentence":"see %s%d","aspect":"b"}' % (cite, i) for i in range(4000)) + "]"
        df = raw(spark, [text]).cache()
        df.count()
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            assert parse_report(df).first().parsed_objects == 4000
            best = min(best, time.perf_counter() - start)
        df.unpersist()
        return best

    plain = seconds("")
    assert seconds("[1] ") < 1.5 * plain + 0.5


def test_clashing_column_gets_prefix(spark):
    df = spark.createDataFrame([(1, "x", '{"sentence":"s","aspect":"a","tone":"t"}')], "row_id long, tone string, text string")
    row = parse_annotations(df).first()
    assert (row.tone, row.ann_tone) == ("x", "t")


def expected(text):
    """Brute force: recursive walk over the parsed block."""
    for start in range(len(text)):
        if text[start] in "[{":
            end = text.rfind("]" if text[start] == "[" else "}")
            if end > start:
                break
    else:
        return []
    try:
        value = json.loads(text[start:end + 1])
    except ValueError:
        return []
    todo, found = [value], []
    while todo:
        v = todo.pop(0)
        if isinstance(v, list):
            todo = v + todo
        elif isinstance(v, dict) and {"sentence", "aspect"} <= v.keys():
            found.append(v["sentence"])
    return found


def random_value(rng, depth):
    kind = rng.random()
    if depth > 0 and kind < 0.45:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    if kind < 0.8:
        d = {"sentence": f"s{rng.randint(0, 99)} [x] {{y}}", "aspect": rng.choice(["a", None, "b]"])}
        if rng.random() < 0.2:
            d.pop(rng.choice(list(d)))
        return d
    return rng.choice([1, "text", None, True, 2.5])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_answers_against_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        body = json.dumps(random_value(rng, 5))
        texts.append(rng.choice(["", "Sure:\n", "see {", "x ] "]) + body + rng.choice(["", "\n```", " }", " ok ]"]))
    got = {}
    for r in parse_annotations(raw(spark, texts)).orderBy("row_id", "pos").collect():
        got.setdefault(r.row_id, []).extend([] if r.pos is None else [r.sentence])
    for i, t in enumerate(texts):
        assert got[i] == expected(t), t


def test_provider_and_projection(spark, rows):
    df = spark.createDataFrame([("a/b/c",), ("plain",), (None,), ("/x",)], "model string")
    assert rows(with_provider(df), "provider") == [("",), ("a",), ("unknown",), ("unknown",)]
    assert sentence_table(df, ["sentence", "model"]).columns == ["model"]
