import random
from collections import defaultdict

import pytest

from labelscope.operators import coverage, profiles
from labelscope.operators.labels import normalize_labels
from labelscope.sources.ontologies import SENTIMENTS, TONES


def test_profiles(spark, rows):
    data = [("a", "pos", "pledge"), ("a", "neg", "result"), ("b", "pos", None), (None, "pos", "pledge")]
    df = normalize_labels(spark.createDataFrame(data, "filename string, sentiment string, tone string"),
                          {"sentiment": SENTIMENTS, "tone": TONES})
    profile = profiles.document_profile(df)
    got = {r.filename: r for r in profile.collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].sent_POSITIVE, got["a"].tone_OUTCOME, got["b"].tone_OTHER, got["b"].sent_NEGATIVE) == (1, 1, 1, 0)
    assert ("POSITIVE", 2) in rows(profiles.composition(profile, "sent_", "sentiment"))
    stats = {r["column"]: (r["mean"], r["std"]) for r in profiles.profile_stats(profile).collect()}
    assert stats["sent_NEGATIVE"] == (0.5, 0.71) and stats["sent_POSITIVE"] == (1.0, 0.0)
    corr = {(r["first"], r["second"]): r["corr"] for r in profiles.profile_correlation(profile).collect()}
    assert len(corr) == 64
    assert corr["sent_NEGATIVE", "tone_OTHER"] == pytest.approx(-1.0)
    assert corr["sent_POSITIVE", "tone_OTHER"] is None  # constant column
    one = profile.filter("filename = 'a'")
    assert {r["std"] for r in profiles.profile_stats(one).collect()} == {None}


@pytest.fixture(scope="module")
def annotated(spark):
    rng = random.Random(5)
    data = []
    for i in range(400):
        model = rng.choice(["p/x", "p/y", "q/z", "plain", None])
        data.append((
            i, rng.randint(0, 1), rng.choice(["f1", "f2", None]), rng.choice([1, 2, 3]), model,
            rng.choice(["s1", "s2", "s3", None]), rng.choice(["pos", "neg", None]),
        ))
    data.append((999, 0, "f3", 1, None, "only", "pos"))
    schema = "row_id long, pos int, filename string, page_number long, model string, sentence string, sentiment string"
    return spark.createDataFrame(data, schema), data


def test_model_counts(annotated, rows):
    df, data = annotated
    docs, pages, cells = defaultdict(set), defaultdict(set), defaultdict(int)
    for _, _, f, p, m, s, _ in data:
        if f is None:
            continue
        docs[f].add(m), pages[f, p].add(m)
        if m is not None:
            cells[f, p, m] += s is not None
    count = lambda s: len(s - {None})
    assert rows(coverage.models_per_document(df)) == sorted((f, count(s)) for f, s in docs.items())
    assert rows(coverage.models_per_page(df)) == sorted((*k, count(s)) for k, s in pages.items())
    lists = {(r.filename, r.page_number): r.models for r in coverage.models_per_page_list(df).collect()}
    assert lists == {k: ", ".join(sorted(s - {None})) for k, s in pages.items()}
    assert rows(coverage.model_page_matrix(df)) == sorted((*k, n) for k, n in cells.items())
    wide = coverage.model_page_matrix(df, ["p/x", "absent"])
    for r in wide.collect():
        assert r["absent"] == 0 and r["p/x"] == cells.get((r.filename, r.page_number, "p/x"), 0)
    assert coverage.model_list(df) == ["p/x", "p/y", "plain", "q/z"]


@pytest.mark.parametrize("provider", [None, "p"])
def test_comparison(annotated, rows, provider):
    df, data = annotated
    first = {}
    for _, _, f, p, m, s, v in sorted(data, key=lambda r: (r[0], r[1])):
        if None in (f, m, s) or (provider and m.split("/")[0] != provider):
            continue
        if provider is None and v is None:
            continue
        first.setdefault((f, p, s, m), v)
    wanted = sorted((*k, v) for k, v in first.items() if v is not None)
    assert rows(coverage.model_comparison(df, provider=provider)) == wanted
    wide = coverage.model_comparison(df, ["p/x", "p/y", "never"], provider=provider).collect()
    assert len(wide) == len({w[:3] for w in wanted})
    for r in wide:
        assert r["never"] is None and r["p/x"] == first.get((r.filename, r.page_number, r.sentence, "p/x"))


@pytest.mark.parametrize("by_provider", [False, True])
def test_completeness(annotated, by_provider):
    df, data = annotated
    files, pages = defaultdict(set), defaultdict(set)
    for _, _, f, p, m, _, _ in data:
        if f is None:
            continue
        tail = ((m.split("/")[0] if m and "/" in m else "unknown"),) if by_provider else ()
        files[(f, *tail)].add(m), pages[(f, p, *tail)].add(m)
    got = coverage.model_completeness(df, by_provider=by_provider).collect()
    assert len(got) == len(pages)
    for r in got:
        tail = (r.provider,) if by_provider else ()
        expected, present = files[(r.filename, *tail)] - {None}, pages[(r.filename, r.page_number, *tail)] - {None}
        assert r.expected == sorted(expected) and r.present == sorted(present)
        assert r.missing == sorted(expected - present)
        assert (r.missing_count, r.present_count, r.total) == (len(expected - present), len(present), len(expected))
        assert r.score == pytest.approx(len(present) / len(expected) if expected else 1.0)


def test_names_of_models_are_bounded_by_the_argument(annotated):
    with pytest.raises(ValueError, match="long form"):
        coverage.model_list(annotated[0], most=3)
