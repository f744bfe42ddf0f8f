"""Held-out accuracy of the trained operators, disclosure of terms, blocks of a benchmark, and the pipeline."""

import hashlib
import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelscope.llm import queries
from labelscope.llm.decontaminate import clean_documents, decontaminate
from labelscope.llm.mixing import mix_sources, mixed_documents, source_targets
from labelscope.llm.quality import features, features_table, fit_non_negative, score_quality, table_sums
from labelscope.llm.sanitise import entity_name, personal_data, sanitise, sanitised_documents, sanitised_text
from labelscope.llm.shared import held_out
from labelscope.llm.toxicity import FOLDS, fit_chain, fit_logistic, score_toxicity, telling
from tests.llm.test_against_brute_force import components

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.1"
given = pytest.mark.skipif(not os.path.isdir(FOLDER) or not os.path.isdir(LARGER), reason="no test tables")


@given
def test_quality_and_toxicity_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    good = queries.op7_quality(spark, LARGER).join(labels, "doc_id").filter("held_out")
    rates = good.groupBy("quality").agg(F.avg("predicted").alias("passed")).collect()
    passed = {r.quality: r.passed for r in rates}
    assert passed[1] > 0.98 and passed[0] < 0.15
    toxic = queries.op6_toxicity(spark, LARGER).join(labels, "doc_id").filter("held_out").groupBy("toxic").agg(
        F.avg("predicted").alias("caught")).collect()
    caught = {r.toxic: r.caught for r in toxic}
    assert caught[1] > 0.8 and caught[0] < 0.02


def test_non_negative_risk_separates_without_negatives():
    rng = np.random.default_rng(0)
    positive = rng.normal(1, 1, (800, 5)).astype(np.float32)
    unlabelled = np.concatenate([rng.normal(1, 1, (700, 5)), rng.normal(-1, 1, (300, 5))]).astype(np.float32)
    model = fit_non_negative(positive, lambda f: f(unlabelled.astype(float)), 0.7)
    assert model.score(rng.normal(1, 1, (500, 5))).mean() > model.score(rng.normal(-1, 1, (500, 5))).mean() + 0.5


def test_fit_finds_the_least_risk_and_keeps_it_from_falling_below_zero():
    rng = np.random.default_rng(2)
    positive = rng.normal(0.7, 1, (400, 4))
    unlabelled = np.concatenate([rng.normal(0.7, 1, (600, 4)), rng.normal(-0.7, 1, (900, 4))])
    calls = []
    model = fit_non_negative(positive, lambda f: (calls.append(1), f(unlabelled))[1], 0.3, steps=30, decay=1e-4)
    assert len(calls) < 20

    def risk(weights, bias):
        z = [np.clip((x - model.mean) / model.scale, -8, 8) @ weights + bias for x in (positive, unlabelled)]
        return np.logaddexp(0, z[1]).mean() - 0.3 * z[0].mean() + 5e-5 * (weights**2).sum()

    least = risk(model.weights, model.bias)
    for _ in range(200):
        assert risk(model.weights + rng.normal(0, 0.05, 4), model.bias + rng.normal(0, 0.05)) > least - 1e-6
    # few positives, a prior that is too large: the plain risk would go far below what loss can be
    few = rng.normal(3, 0.1, (5, 4))
    model = fit_non_negative(few, lambda f: f(unlabelled), 0.95)
    z = [np.clip((x - model.mean) / model.scale, -8, 8) @ model.weights + model.bias for x in (few, unlabelled)]
    assert np.logaddexp(0, z[1]).mean() - 0.95 * np.logaddexp(0, z[0]).mean() > -0.05


def test_the_unlabelled_side_covers_all_documents(spark):
    rng = random.Random(6)
    plain = ["a walk by the river in the morning sun", "they read the old letters at night"]
    rows = [(i, " ".join(rng.choice(plain).split() * rng.randint(1, 9))) for i in range(3000)]
    rows += [(10_000 + i, " ".join(f"{rng.randrange(10**6):x}#$%" for _ in range(30))) for i in range(30)]  # one text in a hundred
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 3000, 3)] + [(10_000 + i, 0, 0) for i in range(0, 30, 10)], "doc_id long, quality int, toxic int")
    table = features_table(docs)
    outside = table.filter(~held_out(F.col("doc_id")))
    counted = table_sums(outside)(lambda x: np.r_[len(x), x.sum(axis=0)])
    direct = features(pa.array([r.text for r in docs.filter(~held_out(F.col("doc_id"))).collect()])).astype(float)
    assert counted[0] == len(direct) and np.allclose(counted[1:], direct.sum(axis=0))
    scored = score_quality(docs, labels)
    assert sorted(scored.collect()) == sorted(score_quality(docs, labels).collect())
    rates = {r.junk: r.passed for r in scored.groupBy((F.col("doc_id") >= 10_000).alias("junk")).agg(F.avg("predicted").alias("passed")).collect()}
    assert rates[False] > 0.99 and rates[True] < 0.1


def test_chain_uses_earlier_categories_out_of_fold():
    rng = np.random.default_rng(1)
    n = 1200
    first = rng.random(n) < 0.4
    words = [np.array([1 if a else 2, 3 + int(rng.integers(0, 50))]) for a in first]
    row = np.repeat(np.arange(n), 2)
    labels = np.stack([first, first ^ (rng.random(n) < 0.02)], axis=1)
    links, held = fit_chain(n, row, np.concatenate(words), labels, np.arange(n) % FOLDS)
    assert len(links[1].weights) == len(links[1].words) + 1
    assert ((held[:, 1] > 0.5) == labels[:, 1]).mean() > 0.95


def test_a_large_toxic_vocabulary_in_several_languages(spark):
    """A thousand toxic words, each in few texts, in languages that no argument names; held-out texts are caught by words seen elsewhere."""
    rng = random.Random(4)
    langs = {lang: ([f"{lang}bad{i}" for i in range(250)], [f"{lang}word{i}" for i in range(2000)]) for lang in ("it", "pl", "tr", "zz-1")}
    rows, marks = [], []
    for i in range(6000):
        lang = rng.choice(list(langs))
        bad, plain = langs[lang]
        words = rng.choices(plain, k=rng.randint(10, 60))
        toxic = rng.random() < 0.2
        for at in rng.sample(range(len(words)), 4) if toxic else ():
            words[at] = rng.choice(bad)
        rows.append((i, " ".join(words), lang if i % 50 else None))
        marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scored = score_toxicity(docs, labels)
    assert scored.columns == ["doc_id", "held_out", "p_it", "p_pl", "p_tr", "p_zz-1", "score", "predicted"]
    rates = scored.join(labels, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("caught")).collect()
    caught = {r.toxic: r.caught for r in rates}
    assert caught[1] > 0.97 and caught[0] < 0.03


def test_newton_steps_by_conjugate_gradients_reach_the_minimum():
    rng = np.random.default_rng(5)
    x = (rng.random((300, 40)) < 0.2).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ rng.normal(0, 2, 40))))).astype(float)
    row, at = np.nonzero(x)
    weights, bias = fit_logistic(300, row, at, 40, np.zeros((300, 0)), y, rounds=30, turns=60)
    p = 1 / (1 + np.exp(-(x @ weights + bias)))
    assert np.abs(x.T @ (p - y) + weights).max() < 1e-2 and abs((p - y).sum()) < 1e-2
    assert telling(np.array([0, 1, 2, 0, 1, 2]), np.array([0, 0, 1, 2, 2, 2]), 4, np.array([1.0, 1.0, 0.0]), 0.1).tolist() == [True, True, False, False]


def test_terms_that_disclose_an_entity_become_spans(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        words = [f"filler{rng.randrange(300)}" for _ in range(40)]
        if i % 60 == 0:
            words[10:12] = ["mail", "boss@corp.example", "codename", "zebrafish"]
        if i == 7:
            words[3] = "zebrafish"
        rows.append((i, " ".join(words)))
    found = {r.doc_id: r for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i in (0, 60, 7):
        kinds = [(k, rows[i][1][int(a) : int(b)]) for k, a, b in (x.split(":") for x in found[i].spans.split(","))]
        assert ("generalise", "zebrafish") in kinds or ("remove", "zebrafish") in kinds
        assert not any(word.startswith("filler") for _, word in kinds)
    assert found[1].spans == "" and found[0].n_email == 1


def marked_terms(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in sanitise(docs).collect()}
    return {i: {(kind, texts[i][int(a) : int(b)]) for kind, a, b in found if kind in ("generalise", "remove")} for i, found in spans.items()}


def test_rare_entities_have_disclosing_terms(spark):
    rng = random.Random(3)
    texts = [" ".join(f"filler{rng.randrange(300)}" for _ in range(40)) for _ in range(2000)]

    def plant(i, email, *terms):
        words = texts[i].split()
        words[10:10] = [email, *terms]
        texts[i] = " ".join(words)

    for k in (1, 2, 3):  # entities in so many texts, each with a term of its own and a common word
        for j in range(k):
            plant(100 * k + j, f"one{k}@corp.example", f"zebrafish{k}", "filler7")
    texts += [texts[100]] * 30  # copies do not make the pair more frequent
    for j in range(500, 560):  # a word of many texts, once beside an entity of one text
        plant(j, "", "widespread")
    plant(700, "alone@corp.example", "widespread")
    found = marked_terms(spark, texts)
    assert found[100] == set()  # one meeting is no evidence: every word of a text is near something
    for k in (2, 3):
        for j in range(k):
            assert found[100 * k + j] == {("remove", f"zebrafish{k}")}
    assert found[2000] == found[100] and found[700] == found[500] == set()


def test_terms_beside_an_entity_count_wherever_the_text_is_cut(spark):
    rng = random.Random(5)
    texts = [" ".join(f"filler{rng.randrange(300)}" for _ in range(200)) for _ in range(2000)]
    for i, at in ((10, 50), (20, 100), (30, 70)):  # the entity begins a block of 50 words, or lies within one
        words = texts[i].split()
        words[at - 1 : at] = ["zebrafish", "who", "1.2.3.4", "said", "okapi"]
        words[at + 40] = f"distant{i}"
        texts[i] = " ".join(words)
    found = marked_terms(spark, texts)
    for i in (10, 20, 30):
        assert {word for _, word in found[i]} >= {"zebrafish", "okapi"} and f"distant{i}" not in {word for _, word in found[i]}


@pytest.mark.parametrize("vocabulary, texts_of_each", [(300_000, 1), (3000, 1), (3000, 3), (30_000, 5)])
def test_random_words_disclose_nobody(spark, vocabulary, texts_of_each):
    """Words that have nothing to do with any address, rare ones too: at most one text in twenty with an address gets a term."""
    rng = random.Random(vocabulary + texts_of_each)
    texts = []
    for i in range(1000):
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(60)]
        if i < 500:
            words[rng.randrange(60)] = f"someone{i // texts_of_each}@corp.example"
        texts.append(" ".join(words))
    found = marked_terms(spark, texts)
    assert sum(bool(found[i]) for i in range(500)) <= 25


def spans_by_hand(texts):
    """All spans of ``sanitise``, from whole sets of contexts and blocks."""
    alphanumeric = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def words_of(text):
        return [(m[0].translate(lower), m.start(), m.end()) for m in alphanumeric.finditer(text)]

    def inside(spans, a, b):
        return any(x < b and a < y for x, y, _ in spans)

    places = []  # (entity or None, terms) of each context and block
    for text in {t or "" for t in texts}:
        words, spans = words_of(text), personal_data(text)
        able = [not inside(spans, a, b) for _, a, b in words]
        near, outside = {}, set(range(len(words)))
        for a, b, kind in spans:
            own = [i for i, (_, x, y) in enumerate(words) if x < b and a < y]
            low = own[0] if own else sum(y <= a for _, _, y in words)
            high = own[-1] + 1 if own else low
            around = set(range(max(0, low - 25), min(len(words), high + 25)))
            near.setdefault(entity_name(kind, text[a:b]), set()).update(around)
            outside -= around
        rest = sorted(outside)
        blocks = [rest[i : i + 50] for i in range(0, len(rest), 50)] or [[]] * (not near)
        places += [(e, {words[i][0] for i in at if able[i]}) for e, at in [*near.items(), *((None, b) for b in blocks)]]
    total, n_term, n_entity, both = len(places), Counter(), Counter(), Counter()
    for e, terms in places:
        n_term.update(terms)
        if e is not None:
            n_entity[e] += 1
            both.update((e, t) for t in terms)
    squares, largest = sum(n * n for n in n_entity.values()), max(n_entity.values(), default=0)
    removed = {}
    for (e, t), n in both.items():
        content = math.log(total / n_entity[e])
        pmi = math.log(n * total / (n_term[t] * n_entity[e]))
        log_orders = math.lgamma(n + 1) if n <= 20 else n * math.log(n) - n
        chance = n * math.log(n_term[t]) - log_orders + math.log(squares / total**2) + (n - 2) * math.log(largest / total)
        if n > 1 and content > 0 and pmi >= 0.9 * content and chance <= math.log(0.05 / len(n_term)):
            removed[t] = removed.get(t, False) or n / n_term[t] >= 0.9
    out = {}
    for i, text in enumerate(texts):
        spans = personal_data(text or "")
        terms = sorted((removed[w], a, b) for w, a, b in words_of(text or "") if w in removed and not inside(spans, a, b))
        out[i] = ",".join([f"{k}:{a}:{b}" for a, b, k in spans] + [f"{'remove' if r else 'generalise'}:{a}:{b}" for r, a, b in terms])
    return out


def test_spans_equal_brute_force(spark):
    rng = random.Random(21)
    people = [("Ana.B@corp.example", ["zebrafish", "Ökapi"]), ("10.1.2.3", ["lab7", "q"]), ("+49 30 1234567", ["quokka", "1984"]), ("4111 1111 1111 1111", ["x9"])]
    texts = [None, "", "@", "1.2.3.4 +1 222 333 4444"]
    for i in range(700):
        words = [rng.choice(["é", "Word", "und"]) + str(int(rng.expovariate(0.01))) for _ in range(rng.randint(0, 130))]
        for who, terms in rng.choices(people, k=rng.choice([0] * 9 + [1, 1, 1, 2])):
            at = rng.randint(0, len(words))
            words[at:at] = [who, *(t for t in terms if rng.random() < 0.95)]
        texts.append(rng.choice([" ", "  ", ", "]).join(words))
    texts += texts[-20:] + [f"Word{i} solo@corp.example xylophone, Word{i + 1}" for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.spans for r in sanitise(docs).collect()}
    assert found == spans_by_hand(texts)
    kinds = Counter(x.split(":")[0] for s in found.values() for x in s.split(",") if x)
    assert kinds["remove"] >= 6 and kinds["generalise"] > 50 and kinds["email"] > 20

    clean = {r.doc_id: r.text for r in sanitised_documents(docs.selectExpr("*", "doc_id AS copy", "'x' AS terms")).collect()}
    assert clean[0] is None and clean[1] == "" and clean[3] == "[ip] [phone]"
    for i, text in enumerate(texts):
        spans = [x.split(":") for x in found[i].split(",") if x]
        for kind, a, b in spans:
            if kind in ("email", "card", "remove"):
                assert re.search(rf"(?<!\w){re.escape(text[int(a) : int(b)])}(?!\w)", clean[i]) is None
        if not spans:
            assert clean[i] == text
    assert any("[email]" in t for t in clean.values() if t)


def test_general_terms_and_cuts():
    text = "Dr Who met X9 and zebra at a@b.cc now"
    assert sanitised_text(text, [(False, 3, 6), (False, 11, 13), (True, 18, 23)]) == "Dr [name] met [number] and at [email] now"
    assert sanitised_text("zebra", [(True, 0, 5)]) == "" and sanitised_text("a  b", []) == "a  b" and sanitised_text("zebra", [(False, 0, 5)]) == "[word]"


def test_many_spans_in_one_text_take_time_in_proportion(spark):
    took = []
    for n in (5_000, 20_000):
        text = " ".join(f"ü{i} a{i}@b.cc" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        assert sanitise(docs).collect()[0].n_email == n
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0]


def test_too_few_blocks_tell_nothing_of_a_rare_entity(spark):
    texts = [f"a@b.example word{i} other thing" if i == 0 else f"word{i} other thing" for i in range(5)]
    assert marked_terms(spark, texts)[0] == set()


@given
def test_blocks_of_a_benchmark_change_nothing(spark):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = decontaminate(docs, bench), decontaminate(docs, bench, most_bytes=4000)
    assert sorted(one.collect()) == sorted(many.collect())
    assert clean_documents(docs, bench, most_bytes=4000).count() == one.filter("NOT contaminated").count()


def test_targets_equal_repeated_sharing(spark):
    rng = random.Random(9)
    for _ in range(6):
        sizes = [(f"s{i:02d}", rng.choice([0, 1, 7, 40, 300, 5000])) for i in range(rng.randrange(1, 9))]
        total, weights = sum(n for _, n in sizes), [i % 3 + 1 for i in range(len(sizes))]
        target, free = [0.0] * len(sizes), set(range(len(sizes)))
        while free:
            left = total - sum(3 * sizes[i][1] for i in range(len(sizes)) if i not in free)
            level = left / sum(weights[i] for i in free)
            over = {i for i in free if level * weights[i] >= 3 * sizes[i][1]}
            if not over:
                break
            free -= over
        for i, (_, n) in enumerate(sizes):
            target[i] = level * weights[i] if i in free else 3.0 * n
        frame = spark.createDataFrame(sizes, "source string, source_size long")
        found = {r.source: r.target for r in source_targets(frame, (1, 2, 3), 1.0, 3).collect()}
        assert [found[s] for s, _ in sizes] == pytest.approx(target)


def test_mix_comes_near_targets_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([1, 5, 30, 200]), rng.choice("aaaaaaabc")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    one, two = mix_sources(docs), mix_sources(docs.repartition(7))
    assert sorted(one.collect()) == sorted(two.collect())
    near = one.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("t"))
    assert all(abs(r.taken - r.t) <= 100 for r in near.collect())
    assert {(r.doc_id, r.taken) for r in one.filter("taken > 0").collect()} == {(r.doc_id, r.taken) for r in mixed_documents(docs).collect()}


def test_a_column_of_weights_decides_who_comes_first(spark):
    """Documents of nine times the weight are nine times as likely to be first; null, NaN and negative weights come last."""
    rows = [(i, "w w", "a" if i < 4000 else "b", [9.0, 1.0, None, float("nan"), -1.0][i % 5] if i < 4000 else 1.0) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double").repartition(3)
    mixed = mixed_documents(docs, weights=(1, 9), quality="score")
    taken = mixed.filter("source = 'a'").groupBy("score").count().collect()
    count = {str(r.score): r["count"] for r in taken}
    assert 600 < count["9.0"] <= 800 and count.get("1.0", 0) < 400 and sum(count.get(x, 0) for x in ("None", "nan", "-1.0")) < 20
    assert {r.doc_id for r in mix_sources(docs, weights=(1, 9), quality="score").filter("taken > 0").collect()} == {r.doc_id for r in mixed.collect()}


@given
def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "near_dedup", "benchmark_decontamination", "source_mixing"]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))

    windows = {tuple(w[i : i + 10]) for w in (words(r.text) for r in bench) for i in range(max(1, len(w) - 9)) if w}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        path = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        if name != "source_mixing":
            assert docs.columns == columns and all(after[i] == before[i] for i in after)
        if name == "exact_dedup":
            keep = {}
            for i, r in before.items():
                keep[r.text.translate(lower)] = max(i, keep.get(r.text.translate(lower), -1))
            assert set(after) == set(keep.values())
        if name == "near_dedup":
            found = components([(i, r.text) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, (_, head) in found.items() if i == head} and len(after) < len(before)
        if name == "benchmark_decontamination":
            lengths = {len(w) for w in windows}
            hit = {i for i, r in before.items() for w in [words(r.text)] for n in lengths
                   if any(tuple(w[k : k + n]) in windows for k in range(len(w) - n + 1))}
            assert set(after) == set(before) - hit
        if name == "quality_classifier":
            truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            stayed = [i in after for i in before if truth.get(i) == 1]
            assert sum(stayed) >= 0.95 * len(stayed) and len(after) < len(before)
            assert sum(i in after for i in before if truth.get(i) == 0) <= 0.3 * sum(q == 0 for q in truth.values())
        if name == "source_mixing":
            assert docs.columns == [*columns, "taken"]
            assert {i: r.taken for i, r in after.items()} == mix_by_hand([(i, r.text, r.source) for i, r in before.items()])


def mix_by_hand(rows):
    """What the mix takes of each document, from whole sorted sources; documents that it leaves are not in it."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, free = {}, set(sources)
    while free:
        level = (sum(total.values()) - sum(3 * total[s] for s in sources if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 3 * total[s]}
        if not over:
            break
        free -= over
    for s in sources:
        target[s] = level * weight[s] if s in free else 3.0 * total[s]
    taken = {}
    for s in sources:
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, through = target[s] - epochs * total[s], 0
        keyed = []
        for i, t, x in rows:
            if x == s:
                u = (int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                mean = len(t) / max(size[i], 1) if t is not None else None
                keyed.append((-math.log(u) / max(1.0 if mean is None else 1 / (1 + abs(mean - 6) / 6), 1e-6), i))
        for _, i in sorted(keyed):
            through += size[i]
            n = size[i] * (epochs + (rest > 0 and through - size[i] / 2 <= rest))
            if n:
                taken[i] = n
    return taken
