import random
from collections import Counter, defaultdict

import pytest

from labelscope.operators import evaluation as ev
from labelscope.operators.rules import Rule, match_rules, rule_summary

LABELS = ("a", "s", "t")
RULES = [Rule(take_n=12), Rule("x", take_n=3), Rule("x", "p", "u", 1000), Rule("none", take_n=5), Rule(tone="v", take_n=1)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(9)
    data = [(i * 5 + rng.randint(0, 4), rng.choice("xxxy"), rng.choice("pq"), rng.choice("uv")) for i in range(300)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "row_id long, a string, s string, t string").repartition(4), sorted(data)


def matches(rule, row):
    return all(want in ("(Any)", have) for want, have in zip(rule[:3], row[1:]))


def test_rule_summary(table):
    df, data = table
    got = rule_summary(df, RULES, LABELS).collect()
    for i, (rule, r) in enumerate(zip(RULES, got)):
        n = sum(matches(rule, row) for row in data)
        assert (r.rule_id, r["count"], r.take_n) == (i + 1, n, min(rule.take_n, max(1, n)))


@pytest.mark.parametrize("slice_rows", [1, 64, 1 << 20])
def test_first_matches_in_row_order(table, slice_rows):
    df, data = table
    wanted = set()
    for i, rule in enumerate(RULES):
        hits = [row for row in data if matches(rule, row)][: rule.take_n]
        wanted |= {(i + 1, k + 1, *row) for k, row in enumerate(hits)}
    got = match_rules(df, RULES, LABELS, slice_rows=slice_rows)
    assert {tuple(r) for r in got.collect()} == wanted and got.count() == len(wanted)


def test_rules_read_the_table_twice(table, spark, tmp_path):
    table[0].write.parquet(str(tmp_path / "t"))
    out = match_rules(spark.read.parquet(str(tmp_path / "t")), RULES, LABELS)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 2 and "ReusedExchange" in final and "NestedLoop" not in final


def test_find_missing(spark, rows):
    out = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "n"), ("b", None, "z")], "filename string, page_number long, v string")
    exp = spark.createDataFrame([("a", 1), ("a", 1), (None, 1)], "filename string, page_number long")
    assert rows(ev.find_missing(out, exp), "v") == [("y",), ("z",)]
    plan = ev.find_missing(out, exp)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def sides(seed):
    rng = random.Random(seed)
    labels = ["E", "S", " E ", "None", "", None, "nan", "G"]
    def side(n):
        return [(i * 3, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None]), rng.choice(labels), rng.choice(labels), rng.choice(labels), rng.random()) for i in range(n)]
    return side(120), side(90)


SCHEMA = "row_id long, sentence string, aspect_category string, sentiment string, tone string, confidence double"


@pytest.fixture(scope="module")
def pair(spark):
    gt, pred = sides(4)
    shuffled = [random.Random(1).sample(x, len(x)) for x in (gt, pred)]
    frames = [spark.createDataFrame(x, SCHEMA) for x in shuffled]
    groups = [defaultdict(list), defaultdict(list)]
    for g, data in zip(groups, (gt, pred)):
        for r in data:
            if r[1] is not None:
                g[r[1]].append(r)
    aligned = [(a, b) for s in groups[0] for a, b in zip(groups[0][s], groups[1].get(s, []))]
    return (*frames, aligned, gt, pred)


@pytest.mark.parametrize("slice_rows", [10, 1 << 20])
def test_alignment(pair, slice_rows):
    gt, pred, aligned, *_ = pair
    out = ev.align_by_sentence(gt, pred, slice_rows=slice_rows)
    assert {c for c in out.columns if c.endswith("_gt")} == {"row_id_gt", "aspect_category_gt", "sentiment_gt", "tone_gt", "confidence_gt"}
    got = Counter((r.sentence, r.row_id_gt, r.row_id_pred) for r in out.collect())
    assert got == Counter((a[1], a[0], b[0]) for a, b in aligned)


def test_coverage(pair):
    gt, pred, aligned, g, p = pair
    row = ev.alignment_coverage(gt, pred).first()
    assert (row.aligned, row.gt_rows, row.pred_rows) == (len(aligned), len(g), len(p))
    assert row.coverage_gt == pytest.approx(len(aligned) / len(g) * 100)
    empty = ev.alignment_coverage(gt.limit(0), pred).first()
    assert (empty.aligned, empty.gt_rows, empty.coverage_gt) == (0, 0, None)


def test_errors(pair):
    gt, pred, aligned, *_ = pair
    out = ev.align_by_sentence(gt, pred)
    wanted = Counter((a[1], a[2], b[2]) for a, b in aligned if a[2] is None or a[2] != b[2])
    assert Counter(tuple(r) for r in ev.error_rows(out, "aspect_category").collect()) == wanted
    flags = ev.confidence_errors(out, "aspect_category").collect()
    assert len(flags) == len(aligned) and sum(r.is_error for r in flags) == wanted.total()
    with pytest.raises(ValueError):
        ev.confidence_errors(ev.align_by_sentence(gt.drop("confidence"), pred), "tone")


def by_hand(pairs, average):
    valid = [(a.strip(), b.strip()) for a, b in pairs if a is not None and b is not None
             and a.strip().lower() not in ("nan", "none", "", "null") and b.strip().lower() not in ("nan", "none", "", "null")]
    dropped, n = len(pairs) - len(valid), len(valid)
    if not n:
        return (0.0, 0.0, 0.0, 0.0, dropped)
    acc = sum(a == b for a, b in valid) / n
    if average == "micro":
        return (acc, acc, acc, acc, dropped)
    names = sorted({x for v in valid for x in v})
    scores = []
    for x in names:
        tp = sum(a == b == x for a, b in valid)
        t, p = sum(a == x for a, _ in valid), sum(b == x for _, b in valid)
        scores.append((t / n if average == "weighted" else 1 / len(names), tp / p if p else 0, tp / t if t else 0, 2 * tp / (t + p)))
    return (acc, *[sum(s[0] * s[i] for s in scores) for i in (1, 2, 3)], dropped)


@pytest.mark.parametrize("average", ["weighted", "macro", "micro"])
def test_metrics(pair, average):
    gt, pred, aligned, *_ = pair
    got = {r.target: tuple(r)[1:] for r in ev.classification_metrics(ev.align_by_sentence(gt, pred), average=average).collect()}
    for i, target in enumerate(ev.TARGETS, start=2):
        assert got[target] == pytest.approx(by_hand([(a[i], b[i]) for a, b in aligned], average))


def test_metrics_without_valid_labels(spark):
    df = spark.createDataFrame([("none", "E"), (None, None)], "tone_gt string, tone_pred string")
    assert tuple(ev.classification_metrics(df, ["tone"]).first()) == ("tone", 0.0, 0.0, 0.0, 0.0, 2)
    assert ev.clean_label_pairs(df, "tone_gt", "tone_pred").count() == 0
    with pytest.raises(ValueError):
        ev.classification_metrics(df, ["tone"], average="other")
