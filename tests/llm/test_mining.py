"""Phrases, spelling variants and nearest neighbours against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelscope.llm import neighbours, phrases, spelling
from labelscope.llm.neighbours import chi_square_quantile, nearest
from labelscope.llm.phrases import collocations, frequent_phrases
from labelscope.llm.queries import QUERIES, SQL
from labelscope.llm.spelling import Borders, crc_of_runs, shared_letters, spelling_variants
from tests.oracle import connect, difference

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDER = "/root/testdata/sf0.001"


# --- phrases -------------------------------------------------------------------


def counts_by_hand(rows, longest=5):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[i : i + size])] += 1
    return counts, totals


def collocations_by_hand(rows, least, best=2000):
    counts, totals = counts_by_hand(rows)
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if a >= least and len(p) > 1}
        scored = []
        for p, a in candidates.items():
            inside = any(
                len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            )
            if not inside:
                n = totals[lang]
                score, _, l, r = min((1000 * a * n // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r, n))
        for rank, (score, a, phrase, l, r, n) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["A", "É", "中文", "x-y", "don't"]
    rows = []
    for i in range(300):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(["new york city hall", "New  York", "a a a a a a", *words]) + rng.choice([" ", "\t", " ", "  ", ". ", ",", "\n", " \x0b"])
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    # frequent in one text alone: no sample of a few texts proposes it
    rows += [(1000, "one of a kind phrase. " * 60, "en"), (1001, "one of a kind words. " * 60, "en"), (1002, None, "en"), (1003, "", None), (1004, "...", "fr")]
    rows += [(7, "same row again " * 3, "de")] * 9
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


@pytest.mark.parametrize("sample", [1.0, 0.25, 0.002])
def test_phrases_equal_brute_force_whatever_the_sample(prose, sample):
    rows, docs = prose
    found = sorted(tuple(r) for r in collocations(docs, least=20, sample=sample).collect())
    assert found == collocations_by_hand(rows, 20)
    assert any(p == "one of a kind phrase" for _, _, p, *_ in found)


def test_best_phrases_only(prose):
    rows, docs = prose
    assert sorted(tuple(r) for r in collocations(docs, least=10, best=3).collect()) == collocations_by_hand(rows, 10, best=3)


def test_border_failures_start_further_passes(prose, monkeypatch):
    passes = []
    count = phrases._count
    monkeypatch.setattr(phrases, "_count", lambda docs, proposed, before, sizes, longest: (passes.append(before is not None), count(docs, proposed, before, sizes, longest))[1])
    rows, docs = prose
    frequent, totals = frequent_phrases(docs, least=20, sample=0.002)
    assert sum(passes) >= 2  # the sample missed phrases of several lengths
    counts, sums = counts_by_hand(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in frequent.collect()} == {
        (lang, p): a for lang, c in counts.items() for p, a in c.items() if a >= 20
    }
    assert {r.lang: r.total for r in totals.collect()} == {lang: n for lang, n in sums.items() if n}


def test_full_filters_lose_no_phrase(prose, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 64)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    monkeypatch.setattr(phrases, "MOST_HELD", 100)
    monkeypatch.setattr(phrases, "MOST_PHRASES", 5)
    rows, docs = prose
    assert sorted(tuple(r) for r in collocations(docs, least=20).collect()) == collocations_by_hand(rows, 20)


def test_few_missed_phrases_take_one_further_pass(spark, monkeypatch):
    tables = []
    write = phrases.Scratch.write
    monkeypatch.setattr(phrases.Scratch, "write", lambda self, frame, name: (tables.append(name), write(self, frame, name))[1])
    common = " ".join(f"a{i}" for i in range(60))
    # words of one text alone, in runs of their own and between common ones
    rare = "r0 r1 r2 r3 r4 r5 r6. a1 a2 r7 a3 a4, r8 a59 r8 r8 r8 r8 r8 r8\n" * 30
    rows = [(i, common, "en") for i in range(200)] + [(1000, rare, "en"), (1001, None, None), (None, "", "de")]
    frequent, totals = frequent_phrases(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), least=20)
    assert tables.count("frequent") == 2
    counts, sums = counts_by_hand(rows)
    assert sorted((r.lang, tuple(r.phrase.split(" ")), r.n) for r in frequent.collect()) == sorted(
        (lang, p, a) for lang, c in counts.items() for p, a in c.items() if a >= 20
    )
    assert {r.lang: r.total for r in totals.collect()} == {lang: n for lang, n in sums.items() if n}


def test_sums_of_tasks_are_merged(prose, monkeypatch):
    rows, docs = prose
    monkeypatch.setattr(phrases, "CHUNK", 300)
    monkeypatch.setattr(phrases, "MOST_HELD", 100)
    monkeypatch.setattr(phrases, "MOST_SUMS", 500)
    counted = phrases._counts(docs.coalesce(1).withColumn("lang", F.coalesce("lang", F.lit("und"))), lambda chunk: ((size, names) for size, _, names in phrases.admitted(chunk, None, 1)))
    counts, _ = counts_by_hand(rows, longest=1)
    assert sorted(r.n for r in counted.collect()) == sorted(n for c in counts.values() for n in c.values())


@pytest.mark.parametrize("kind", [0, 1])
def test_hashes_of_words_tell_words_apart(kind):
    rng = random.Random(7)
    words = ["a", "a\0", "a\0\0", "\0", "é", "中文", "b" * 8, "b" * 9]
    for size in [*range(1, 40), 64, 65, 255, 256, 257, 300, 1000]:
        word = "".join(rng.choice("abc") for _ in range(size))
        words += [word, word[:-1] + "x", "x" + word[1:], word + "\0"]
    places = [(word, before) for word in dict.fromkeys(words) for before in range(0, 20, 3)]
    rng.shuffle(places)
    seen = defaultdict(set)
    for data in (" ".join("." * before + word for word, before in places).encode(), *(word.encode() for word in words)):
        found = phrases.words_of(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), phrases._INSIDE)
        for start, end, name in zip(found.start, found.end, phrases.word_hashes(found, kind).tolist(), strict=True):
            seen[bytes(found.data[start:end])].add(name)
    assert set(seen) == {word.encode() for word in words}
    assert all(len(names) == 1 for names in seen.values()) and len(set.union(*seen.values())) == len(seen)


def test_scores_beyond_64_bits(spark, monkeypatch, tmp_path):
    big = 3_000_000_000_000
    frequent = spark.createDataFrame(
        [("en", 1, "a", 5 * big), ("en", 1, "b", 4 * big + 1), ("en", 2, "a b", big)], "lang string, size int, phrase string, n long"
    )
    totals = spark.createDataFrame([("en", 10**15)], "lang string, total long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *args: (frequent, totals))
    row = collocations(frequent).collect()[0]
    assert row.score == 1000 * big * 10**15 // (5 * big * (4 * big + 1)) and (row.l, row.r) == (5 * big, 4 * big + 1)


def test_phrases_of_awkward_and_empty_tables(awkward, empty):
    assert collocations(empty).count() == 0
    found = {r.phrase: r for r in collocations(awkward, least=1000).collect()}
    assert {p: r.a for p, r in found.items()} == {" ".join(["word"] * k): 30_001 - k for k in range(2, 6)}


def test_phrases_equal_sql(spark):
    assert difference(spark, connect(FOLDER), FOLDER, QUERIES["op11_collocations"], SQL["op11_collocations"]) is None


# --- spelling ------------------------------------------------------------------


def variants_by_hand(rows, letters=6, least=5, factor=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{run}".encode())) % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and x != w and one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def misspelt(spark):
    rng = random.Random(11)
    base = ["letters", "lettters", "aaaaaa", "aaaaaaa", "ababab", "straße", "façades", "ÀÉÎõüÿ", "planets"] + [
        "".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(150)
    ]
    rows = []
    for i in range(400):
        text = []
        for _ in range(rng.randint(0, 60)):
            word = base[min(len(base) - 1, int(rng.expovariate(0.06)))]
            if rng.random() < 0.08:
                at = rng.randrange(len(word))
                word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abcé") + word[at:], word[:at] + rng.choice("abcé") + word[at + 1 :]])
            text.append(rng.choice([word, word.capitalize(), word.upper()]))
        rows.append((i - 20 if i % 50 else None, rng.choice([" ", "1", "—", "\n"]).join(text)))
    rows += [(950, "chainal " * 200 + "chainel " * 30 + "chainela " * 5)]
    rows += [(900, None), (901, ""), (902, "中文 123"), (903, "q" * 3000)] + [(904, "repeat")] * 7 + [(904 + i, "q" * 3000 + " " + "q" * 2999 + "z") for i in range(1, 8)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


def test_variants_equal_brute_force(misspelt):
    rows, docs = misspelt
    wanted = variants_by_hand(rows)
    assert sorted(tuple(r) for r in spelling_variants(docs).collect()) == wanted
    assert sum(form is not None for _, form, *_ in wanted) > 5 and any(form and root != form for _, form, root, *_ in wanted)


def test_variants_do_not_hang_on_the_ranges(spark, misspelt):
    rows, docs = misspelt
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = sorted(tuple(r) for r in spelling_variants(docs, letters=3, least=2, factor=2).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found == variants_by_hand(rows, letters=3, least=2, factor=2)


def test_nodes_across_borders_are_shared():
    ends = [(0, "ab", "abca"), (3, "abcab", "abcb"), (4, "abcbx", "abcbx"), (5, "abcbxy", "b"), (7, "c", "d")]
    borders = Borders(ends)
    assert borders.tail[0] == ("abca", borders.front[3]) and len(borders.front[3]) == 4
    assert borders.front[4][:3] == borders.front[3][:3] and len(borders.front[4]) == 4 and borders.front[4][3] != borders.front[3][3]
    assert borders.front[5][:4] == borders.front[4] and len(borders.front[5]) == 5 and borders.front[7] == []


def test_crc_and_shared_letters():
    rng = random.Random(3)
    runs = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 7, 47, 48, 49, 300]))) for _ in range(200)]
    data = np.frombuffer(b"".join(runs), dtype=np.uint8)
    end = np.cumsum([len(r) for r in runs])
    ahead = np.array([zlib.crc32(str(i).encode()) for i in range(len(runs))], dtype=np.uint32)
    found = crc_of_runs(data, end - [len(r) for r in runs], end, ahead)
    assert found.tolist() == [zlib.crc32(str(i).encode() + r) for i, r in enumerate(runs)]
    assert [shared_letters(*x) for x in (("", "a"), ("abc", "abd"), ("abc", "abcd"), ("x", "y"), ("éa", "éb"), ("ab", "ab"))] == [0, 2, 3, 0, 1, 2]


def test_variants_of_awkward_and_empty_tables(awkward, empty):
    assert spelling_variants(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(tuple(r) for r in spelling_variants(awkward, letters=2, least=1).collect()) == variants_by_hand(rows, letters=2, least=1)


# --- neighbours ----------------------------------------------------------------


def nearest_by_hand(rows, k=5, every=50):
    rows = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for at, (i, v) in enumerate(rows):
        if i % every == 0:
            scores = [(-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), j) for other, (j, w) in enumerate(rows) if other != at and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def compared(df, wanted):
    """Recall, by scores: a found row counts if it is as near as the last wanted one."""
    found = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(found[r.query_id]) + 1
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) <= set(wanted)
    hits = total = 0
    for query, best in wanted.items():
        assert len(found[query]) == len(best)
        assert found[query] == sorted(found[query], key=lambda x: (-x[1], x[0]))
        total += len(best)
        hits += sum(score >= best[-1][1] - 1e-12 for _, score in found[query]) if best else 0
    return hits / max(total, 1)


@pytest.mark.parametrize("cell, block", [(512, 1024), (20, 30)])
def test_recall_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(4)
    clustered = rng.standard_normal((40, 32))[rng.integers(0, 40, 1500)] + 0.3 * rng.standard_normal((1500, 32))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([clustered, rng.standard_normal((1500, 32))]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    assert compared(nearest(df), nearest_by_hand(rows)) >= 0.9


def test_given_table_reaches_its_recall(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert compared(QUERIES["op13_nearest"](spark, FOLDER), nearest_by_hand(rows)) >= 0.9


def test_copies_ties_and_vectors_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 8)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    nan = float("nan")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(-100, 200)]  # one cell of many blocks
    rows += [(1000, [1.0, None, 3.0]), (1050, None), (1100, []), (1150, [0.0, 0.0, 0.0]), (1200, [nan, 1.0, 1.0]), (1250, [math.inf, 1.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(2000, [1.0, 0.0]), (2001, [2.0, 0.0]), (2000, [1.0, 0.5]), (2050, [5.0]), (3000, [1e300, 2e300, 3.0]), (3001, [1e-300, 2e-300, 3e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = defaultdict(list)
    for r in nearest(df).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert found[100] == [-100, -99, -98, -97, -96] and found[-100] == [-99, -98, -97, -96, -95]
    assert not {1000, 1050, 1100, 1150, 1200, 1250, 2050, None} & set(found)
    assert len(found[2000]) == 4 and len(found[3000]) == 5  # two queries of one id, each with the other and 2001


def test_neighbours_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "1 AS row", "2 AS cell", "3 AS query", "4 AS rank", "5 AS size")
    assert [tuple(r) for r in nearest(df).collect()] == [(0, 1, 1, 0.0)]
    assert nearest(df.limit(0)).columns == ["query_id", "rank", "vec_id", "score"] and nearest(df.limit(0)).count() == 0
    assert nearest(df.limit(1)).count() == 0


def test_chi_square_quantile():
    assert chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3) and chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2))
