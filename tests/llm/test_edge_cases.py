"""Every operator on nulls, empty and very long texts, ties, repeats, clashing columns, and empty tables."""

import hashlib

import pytest
import regex

from labelscope.llm.content_dedup import content_dedup, distinct_documents
from labelscope.llm.decontaminate import clean_documents, decontaminate
from labelscope.llm.line_dedup import dedup_lines
from labelscope.llm.mixing import mix_sources, mixed_documents
from labelscope.llm.ngram_jaccard import group_heads, ngram_jaccard
from labelscope.llm.quality import good_documents, score_quality
from labelscope.llm.queries import SEPARATOR, tokenizer
from labelscope.llm.sanitise import sanitise
from labelscope.llm.secret_scan import find_secrets
from labelscope.llm.token_scan import byte_pair_encoding, encoded, token_counts
from labelscope.llm.toxicity import score_toxicity
from tests.llm.conftest import AWKWARD

N = len(AWKWARD)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def run_all(docs, labels, benchmark):
    vocabulary, pattern = tokenizer()
    return {
        "secrets": find_secrets(docs), "jaccard": ngram_jaccard(docs, 3, 90), "contaminated": decontaminate(docs, benchmark),
        "mix": mix_sources(docs), "dedup": content_dedup(docs), "toxic": score_toxicity(docs, labels),
        "quality": score_quality(docs, labels), "tokens": token_counts(docs, vocabulary, pattern, SEPARATOR, block_tokens=64),
        "lines": dedup_lines(docs), "private": sanitise(docs),
    }


def test_empty_tables_give_empty_results(empty, labels, benchmark):
    for name, df in run_all(empty, labels.limit(0), benchmark.limit(0)).items():
        assert df.count() == 0, name
    for df in (good_documents(empty, labels), distinct_documents(empty), group_heads(empty), clean_documents(empty, benchmark)):
        assert df.columns == empty.columns and df.count() == 0
    assert mixed_documents(empty).count() == 0


@pytest.fixture(scope="module")
def results(awkward, labels, benchmark):
    return run_all(awkward, labels, benchmark)


def test_one_row_for_each_row(results):
    for name, df in results.items():
        assert df.count() == N, name


def test_secrets(results):
    rows = by_id(results["secrets"])
    assert rows[3].base_sha256 == rows[4].base_sha256 == sha("") and rows[4].spans == ""
    assert (rows[7].n_assign, rows[10].n_hex) == (1, 2)  # digits, and a run of b


def test_private(results):
    row = by_id(results["private"])[7]
    text = next(t for i, t, _ in AWKWARD if i == 7)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 0, 1)
    kind, start, end = row.spans.split(",")[0].split(":")
    assert (kind, text[int(start) : int(end)]) == ("email", "x@y.zz")
    assert by_id(results["private"])[10].spans == "" and by_id(results["private"])[4].base_sha256 == sha("")


def test_jaccard(results):
    rows = by_id(results["jaccard"])
    assert rows[1].component_id == rows[2].component_id == 1
    assert [(rows[i].n_shingles, rows[i].component_id) for i in (3, 4, 5)] == [(0, 3), (0, 4), (0, 5)]
    assert rows[8].n_shingles == 1 and rows[9].n_shingles == 1 and rows[None].component_id is None


def test_contaminated(results):
    rows = by_id(results["contaminated"])
    assert rows[1].n_hit == 11 and rows[1].items_sha256 == sha("1")
    assert rows[7].n_hit == 4 and rows[7].items_sha256 == sha("2") and rows[7].n_items == 1
    assert not rows[4].contaminated and rows[4].n_words == 0 and rows[8].n_words == 30_000


def test_mix(results):
    rows = by_id(results["mix"])
    assert rows[4].size == 0 and rows[4].taken == 0 and rows[4].target == 0.0
    assert all(r.taken <= 3 * r.size for r in results["mix"].collect())
    assert rows[1].target == 3 * 39 and rows[1].taken == 39  # three epochs of 13 words: source a has no more


def test_dedup(results, awkward):
    rows = results["dedup"].collect()
    same = [r for r in rows if r.group_size == 3]
    assert {r.keep_id for r in same if r.doc_id in (1, 2)} == {2} and sum(r.kept for r in same if r.doc_id in (1, 2)) == 1
    blank = [r for r in rows if r.text_sha256 == sha("")]
    assert len(blank) == 3 and {r.keep_id for r in blank} == {4} and [r.doc_id for r in blank if r.kept] == [4]
    kept = distinct_documents(awkward)
    assert kept.columns == awkward.columns
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(map(str, [r.doc_id for r in rows if r.kept]))


def test_repeated_rows_keep_one(spark):
    rows = spark.createDataFrame([(5, "a b"), (5, "A b"), (5, "A B"), (4, "a b")], "doc_id long, text string").repartition(4)
    assert [r.doc_id for r in distinct_documents(rows).collect()] == [5]
    assert content_dedup(rows).filter("kept").count() == 1


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_runs_that_cross_tasks(spark, coalesced):
    """A text with a third of all rows, ties of ids over task borders, and ids that are null: settled by runs, whatever the ranges."""
    rows = [(i, "Hot text") for i in range(400)] + [(i, "hot TEXT") for i in range(0, 400, 40)] + [(None, "hot text")] * 3
    rows += [(i, f"text {i % 300}") for i in range(1000, 1900)] + [(None, "nobody's")] * 2 + [(2000, None), (2001, ""), (2002, "x" * 200_000), (2003, "X" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS id", "'d' AS digest", "1 AS stays").repartition(6)
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").lower(), []).append(i)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        found = content_dedup(docs).collect()
        kept = distinct_documents(docs).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    wanted = sorted(str((i, best[t], len(ids), sha(t))) for t, ids in groups.items() for i in ids)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in found) == wanted
    heads = sorted(str((best[t], sha(t))) for t in groups)
    assert sorted(str((r.doc_id, r.text_sha256)) for r in found if r.kept) == heads
    assert sorted(str((r.doc_id, sha((r.text or "").lower()))) for r in kept) == heads
    assert kept[0].id == 7


def test_no_grouping_over_all_rows(spark, awkward):
    plan = content_dedup(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    grouped = plan[plan.index("HashAggregate") :]
    assert any("edge" in line and "kept" in line for line in grouped.splitlines() if "Filter" in line)  # runs at borders alone


def test_scores(results):
    for name in ("quality", "toxic"):
        rows = results[name].collect()
        assert all(0 <= r.score <= 1 for r in rows)
        assert len({(r.score, r.predicted) for r in rows if r.doc_id in (3, 4)}) == 1


def test_tokens(results):
    encoder = byte_pair_encoding(*tokenizer())
    wanted = sorted((str(i), len(encoder.encode_ordinary(t or ""))) for i, t, _ in AWKWARD)
    assert sorted((str(r.doc_id), r.n_tokens) for r in results["tokens"].collect()) == wanted


def test_lines(results):
    rows = by_id(results["lines"])
    assert (rows[6].n_lines, rows[6].n_removed, rows[6].cleaned) == (8, 3, "one\ntwo\nthree\nfour\n")
    assert rows[4].cleaned is None and rows[4].n_lines == 1 and rows[3].cleaned == ""


def test_stages_keep_all_columns(awkward, labels, benchmark):
    for df in (good_documents(awkward, labels), group_heads(awkward), clean_documents(awkward, benchmark)):
        assert df.columns == awkward.columns
    heads = [r.doc_id for r in group_heads(awkward).collect()]
    assert 2 not in heads and heads.count(1) == 2 and heads.count(None) == 2
    clean = {r.doc_id for r in clean_documents(awkward, benchmark).collect()}
    assert clean == {3, 4, 5, None, 6, 8, 9, 10}
    mixed = mixed_documents(awkward)
    assert mixed.columns[-1] == "taken" and mixed.count() > 0


@pytest.mark.parametrize("text, tokens", [
    ("a" + " " * 5_000_000 + "b", None), ("a" + "\n" * 5_000_000 + "b", None), ("x" * 5_000_000, 625_000), (" \t\u3000" * 400_000, None),
])
def test_tokens_of_millions_of_blanks_line_ends_and_letters(spark, text, tokens):
    vocabulary, pattern = tokenizer()
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts(docs, vocabulary, pattern, SEPARATOR).collect()}
    assert found[2] == 2 and (found[1] == tokens if tokens else found[1] > 1000)


@pytest.mark.parametrize("text", [
    "a" + " " * 25_000 + "b", "a" + "\n" * 25_000 + "\n", " " * 25_000, "x  y" + "\t " * 15_000 + "don't 12 ?!" + "\u3000" * 22_000 + "é", "\r\n" * 20_000 + " 1",
])
def test_long_blanks_are_cut_as_the_encoder_cuts_them(text):
    vocabulary, pattern = tokenizer()
    encoder = byte_pair_encoding(vocabulary, pattern)
    assert encoded(encoder, regex.compile(pattern), text) == encoder.encode_ordinary(text)
