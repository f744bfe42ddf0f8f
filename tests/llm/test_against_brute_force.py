"""Operators against plain Python on the smallest given tables and on made-up families."""

import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelscope.llm import queries
from labelscope.llm.ngram_jaccard import K2, N2, Signatures, bands, ngram_jaccard, parts_of_band, sketch, sketch_bits, folded
from labelscope.llm.line_dedup import dedup_lines
from labelscope.llm.sanitise import personal_data
from labelscope.llm.secret_scan import CLASSES, PLACEHOLDERS, entropy_windows, SecretScanner
from labelscope.llm.shared import bloom, in_bloom, mix
from labelscope.llm.token_scan import separator_scan, token_blocks
from tests.oracle import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@given
@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_its_sql(spark, con, name):
    assert difference(spark, con, FOLDER, queries.QUERIES[name], queries.SQL[name]) is None


def texts(con):
    return con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()


def components(rows, size, percent):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        n = min(size, len(words))
        sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    parent = {doc: doc for doc in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for doc, found in sets.items():
        for shingle in found:
            holders[shingle].append(doc)
    pairs = {(a, b) for docs in holders.values() for i, a in enumerate(docs) for b in docs[i + 1 :]}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {doc: (len(sets[doc]), find(doc)) for doc in sets}


@given
@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_jaccard_on_given_documents(spark, con, size, percent):
    rows = texts(con)
    found = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components(rows, size, percent)


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_jaccard_on_families_at_the_threshold(spark, percent):
    """Families whose members differ so much that the smallest member of a signature does not link with all others."""
    rng = random.Random(percent)
    rows = []
    for family in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 9, 20, 60, 200]))]
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 12)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [f"x{rng.randrange(10**6)}"], [copy[at], "y"]])
            rows.append((len(rows) * 7 + 1, " ".join(copy)))
    found = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == components(rows, 2, percent)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    plan = Signatures(percent)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(mix(rng.integers(1, 2**60, n).astype(np.uint64)))
        drop = int(rng.integers(0, 1 + len(a) * (100 - percent) // 100))
        b = a[drop:] if rng.random() < 0.5 else np.concatenate([a, mix(rng.integers(1, 2**60, drop).astype(np.uint64))])
        b = np.unique(b)
        shared = len(np.intersect1d(a, b))
        if not shared or 100 * shared < percent * (len(a) + len(b) - shared):
            continue
        names, owner = plan.of(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert set(names[owner == 0].tolist()) & set(names[owner == 1].tolist())
        size = min(sketch_bits(len(a)), sketch_bits(len(b))) // 8
        x, y = (folded(np.frombuffer(sketch(s, sketch_bits(len(s))).tobytes(), np.uint8), size) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * shared


def test_unrelated_short_texts_share_no_signature():
    """Sets that may not differ at all, and small ones whose sub-parts are often empty: few of them share a signature."""
    rng = np.random.default_rng(1)
    for percent, size in ((90, 1), (90, 5), (90, 9), (90, 12), (80, 1), (80, 4), (80, 5), (80, 9), (80, 18)):
        sets = mix(rng.integers(1, 2**60, 20_000 * size).astype(np.uint64))
        names, owner = Signatures(percent).of(sets, np.arange(20_001) * size)
        assert len(np.unique(owner)) == 20_000
        assert np.unique(names, return_counts=True)[1].max() < 60 and len(names) < 20_000 * 60


def test_many_unrelated_short_texts_take_time_in_proportion(spark):
    took = []
    for n in (4_000, 32_000):
        docs = spark.range(n, numPartitions=4).selectExpr("id AS doc_id", "concat('word', id) AS text")
        start = time.perf_counter()
        assert ngram_jaccard(docs, 3, 90).filter("component_id = doc_id AND n_shingles = 1").count() == n
        took.append(time.perf_counter() - start)
    assert took[1] < 3 * took[0]


@pytest.mark.parametrize("block", [3, 256])
def test_members_that_no_link_joins_meet_in_blocks(spark, monkeypatch, block):
    """A chain of families: each shares signatures with the next, and the smallest member links with few of them."""
    from labelscope.llm import ngram_jaccard as module

    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(60), rng.randint(0, 7)):
            copy[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(copy[: rng.randint(52, 60)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size, percent in ((1, 80), (1, 90), (2, 80)):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(docs, size, percent).collect()}
        assert found == components(rows, size, percent)


def test_bands_hold_pairs_of_the_threshold():
    for percent in (50, 80, 90, 99):
        found = bands(percent, 5000)
        assert found[0][0] == 1 and all(b[0] == a[1] + 1 for a, b in zip(found, found[1:]))
        for i, (low, high) in enumerate(found[:-1]):
            assert high * 100 // percent <= found[i + 1][1]
            parts, slack, _ = parts_of_band(low, high, percent)
            assert (parts - slack) * (K2 + 1) > 2 * high * (100 - percent) // (100 + percent) and N2 > K2


@given
def test_secrets_and_personal_data_have_the_base_spans(spark, con):
    def secrets(text):
        found = [
            (m.start(), 0, f"assign:{m.start()}:{m.end()}")
            for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
            if len(m[2]) >= 12
        ]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        return ",".join(x[2] for x in sorted(found))

    def private(text):
        def luhn(digits):
            double = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
            return (sum(double) + sum(int(c) for c in digits[::-2])) % 10 == 0

        found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub(r"\D", "", m[0])
            found += [("card", m)] * (16 <= len(digits) <= 19 and luhn(digits))
        found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
        return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, m in found)

    plain = dict(texts(con))
    for name, base in (("op1_secret_scan", secrets), ("op10_sanitise", private)):
        found = {r.doc_id: r.base_sha256 for r in queries.QUERIES[name](spark, FOLDER).collect()}
        assert found == {i: hashlib.sha256(base(t).encode()).hexdigest() for i, t in plain.items()}
    tricky = "a@b.c_d@e.f..x@y 1.2.3.4.5.6.7.8 300.1.1.1.1 +1+22 (333) 4444 00001.1.1.01 4111 1111-1111 1111 1"
    assert ",".join(f"{k}:{a}:{b}" for a, b, k in personal_data(tricky)) == private(tricky)


def test_entropy_windows_equal_direct_counts():
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choices("abcdef0123456789", k=rng.randrange(5, 80)))
        window, least = rng.randrange(4, 24), rng.choice([2.0, 2.5, 3.0])

        def entropy(piece):
            return -sum(piece.count(c) / len(piece) * np.log2(piece.count(c) / len(piece)) for c in set(piece))

        wanted = [i for i in range(len(text) - window + 1) if entropy(text[i : i + window]) >= least - 1e-9]
        assert list(entropy_windows(text, window, least)) == wanted


def test_entropy_adds_spans_and_the_allow_list_drops_them():
    scanner = SecretScanner()
    key = "aB3dE5fG7hJ9kL1mN2pQ4rS6tU8vW0xY"
    assert [kind for _, _, kind in scanner.by_entropy(f"see {key} here")] == ["entropy_base64"]
    for text in ("123e4567-e89b-12d3-a456-426614174000", "EXAMPLE" + key, "sha256-" + key, "a/quite/ordinary/path/to/a_file_Name9", "anticonstitutionnellement"):
        assert scanner.by_entropy(text) == []
    (start, end, _), = scanner.by_entropy("x " + "a" * 40 + " " + key)
    assert start >= 43 and end == 43 + len(key)


def test_keys_of_one_case_and_keys_behind_names_are_found():
    scanner = SecretScanner()
    for key in ("pj7wmz7c50fchhv4", "3mhsw4ofv8iyx779co3w7fi0j61e39bl", "9QZ7K2M4XB8LT3WD"):
        (start, end, kind), *_ = scanner.by_entropy(f"see {key}, please")
        assert kind in ("entropy_lower", "entropy_upper") and key in f"see {key}, please"[start:end]
    key = "".join(random.Random(7).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=40))
    for ahead in ("https://x.y/hooks/in/", "sample_", "sample_token=", "a/b/c=", "example-"):
        spans = scanner.by_entropy(f"{ahead}{key} end")
        assert any(kind == "entropy_base64" and a <= len(ahead) + 2 and b >= len(ahead) + 38 for a, b, kind in spans), ahead
    for text in ("conference2019proceedings", "abcdefghijklmnop", "1234567890123456789012", "aaaaaaaa11111111aaaa", "ISO9001CERTIFICATION2015"):
        assert scanner.by_entropy(text) == []


def secret_spans_by_hand(text):
    found = []
    for run in re.finditer("[A-Za-z0-9+/_=-]+", text):
        if run.end() - run.start() < 16:
            continue
        cut = "[^=/]+" if re.fullmatch(r"(/?[a-z0-9_.-]+/){2,}[A-Za-z0-9_.-]*", run[0]) else "[^=]+"
        for segment in re.finditer(cut, run[0]):
            if re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|sha(256|384|512)-.*", segment[0]):
                continue
            word = lambda w: " " * len(w[0]) if any(p in w[0].lower() for p in PLACEHOLDERS) else w[0]
            shown = re.sub("[A-Za-z0-9]+", word, segment[0])
            for kind in CLASSES:
                covered = set()
                for i in range(len(shown) - kind.window + 1):
                    piece = shown[i : i + kind.window]
                    entropy = -sum(n / len(piece) * np.log2(n / len(piece)) for n in Counter(piece).values())
                    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(piece, piece[1:]))
                    if re.fullmatch(f"[{kind.characters}]+", piece) and entropy >= kind.bits - 1e-9 and turns >= kind.turns and all(
                        re.search(f"[{need}]", piece) for need in kind.needs
                    ):
                        covered |= set(range(i, i + kind.window + 1))  # windows that touch are one span
                base = run.start() + segment.start()
                edges = sorted(covered)
                while edges:
                    n = next((k for k in range(1, len(edges)) if edges[k] != edges[k - 1] + 1), len(edges))
                    found.append((base + edges[0], base + edges[n - 1], kind.name))
                    edges = edges[n:]
    return sorted(found)


def test_entropy_spans_equal_brute_force():
    rng = random.Random(31)
    scanner = SecretScanner()
    alphabets = ["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcXYZ019+/_-=", "aab12", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    for _ in range(250):
        parts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 70))) for _ in range(rng.randint(1, 4))]
        parts += rng.choices(["sample", "a/b/c/", "x=", "sha256-", " ", "word", "_", "/", "EXAMPLE", "123e4567-e89b-12d3-a456-426614174000"], k=3)
        rng.shuffle(parts)
        text = "".join(parts)
        assert sorted(scanner.by_entropy(text)) == secret_spans_by_hand(text)
    long = "".join(rng.choices(alphabets[1], k=700)) + "a" * 300 + "".join(rng.choices(alphabets[3][:-1], k=500))
    assert sorted(scanner.by_entropy(long)) == secret_spans_by_hand(long)


def test_a_megabyte_of_key_characters_is_scanned_in_seconds():
    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=1_000_000))
    start = time.perf_counter()
    assert sum(b - a for a, b, _ in SecretScanner().by_entropy(text)) > 950_000
    assert time.perf_counter() - start < 10


def test_flat_files_scan_over_block_borders(spark, tmp_path):
    rng = random.Random(5)
    wanted = {}
    for name in "abc":
        docs = [[rng.randrange(1, 50) for _ in range(rng.choice([0, 1, 3, 17, 90]))] for _ in range(40)]
        tail = [7, 8] if name == "b" else []
        flat = [t for d in docs for t in [*d, 99]] + tail
        np.array(flat, dtype="<u2").tofile(tmp_path / f"{name}.bin")
        wanted[name] = [len(d) for d in docs] + [len(tail)] * bool(tail)
    for size in (1, 7, 64, 10_000):
        found = separator_scan(token_blocks(spark, str(tmp_path), block_tokens=size), 99)
        got = defaultdict(list)
        for r in found.orderBy("file", "document").collect():
            got[os.path.basename(r.file)[0]].append(r.n_tokens)
        assert dict(got) == wanted


def test_bloom_filter_has_no_misses(spark):
    keys = mix(np.arange(1, 5001, dtype=np.uint64))
    df = spark.createDataFrame([(int(x),) for x in keys.view(np.int64)], "k long")
    words = bloom(df, "k", bits=1 << 17)
    assert in_bloom(words, keys).all()
    assert in_bloom(words, mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))).mean() < 0.05


def without_repeats(texts, passage):
    """What ``dedup_lines`` gives for texts by id."""
    seen, cleaned = set(), {}
    for doc, text in sorted(texts.items()):
        lines = text.split("\n")
        keep = [True] * len(lines)
        for at in range(len(lines)):
            for size in (1, 2, 3):
                piece = tuple(lines[at : at + size])
                words = " ".join(piece).split()
                if len(piece) < size or not words or not (size == 3 or len(words) > passage or len(lines) == size):
                    continue
                if piece in seen:
                    keep[at : at + size] = [False] * size
                seen.add(piece)
        cleaned[doc] = "\n".join(line for line, kept in zip(lines, keep, strict=True) if kept)
    return cleaned


@given
def test_passages_of_few_lines_and_short_texts_are_found(spark, con):
    def passage(tag, n):
        return " ".join(f"{tag}{i}" for i in range(n))

    made = [
        "short copy", "short copy", "two lines\nof text", "two lines\nof text", "a\nshort copy\nb", passage("w", 51), f"before\n{passage('w', 51)}\nafter",
        f"x\n{passage('u', 30)}\n{passage('v', 21)}\ny", f"p\nq\n{passage('u', 30)}\n{passage('v', 21)}\nr",
        f"c\n{passage('t', 50)}\nd", f"e\n{passage('t', 50)}\nf", "", " ", " ", f"{passage('w', 51)}\nadded",
    ]
    cleaned = without_repeats(dict(enumerate(made)), 50)
    assert [cleaned[i] for i in (1, 3, 4, 6, 8, 10, 13, 14)] == ["", "", made[4], "before\nafter", "p\nq\nr", made[10], " ", "added"]
    for docs in (dict(enumerate(made)), dict(texts(con))):
        frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
        assert {r.doc_id: r.cleaned for r in dedup_lines(frame, passage=50).collect()} == without_repeats(docs, 50)
