import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelscope.defaults import CLUSTERS, SIX_CLUSTERS
from labelscope.operators import balance, clustering, flows
from labelscope.operators.labels import normalize_labels
from labelscope.sources.ontologies import SENTIMENTS

ASPECT_CASES = [
    ("Board diversity", "Governance & Board"),
    ("E", "Unclustered"),
    ("product quality", "Customers & Product Responsibility"),
    ("quality", "Digital & Data Security"),
    ("Biodiversity", "Biodiversity & Environmental Impact"),
    ("gender", "Diversity, Equity & Inclusion"),
    ("Water use", "Water & Waste"),
    ("Legal compliance", "Risk Management & Internal Control"),
    ("", "Unclustered"),
    (None, "Unclustered"),
    ("xyz", "Unclustered"),
]


@pytest.fixture(scope="module")
def aspects(spark):
    return spark.createDataFrame([(a,) for a, _ in ASPECT_CASES for _ in range(2)], "aspect string")


def test_clusters(spark, aspects, rows):
    got = {(r.aspect, r.aspect_cluster) for r in clustering.cluster_aspects(aspects).collect()}
    assert got == set(ASPECT_CASES)
    short = {r.aspect: r.aspect_cluster for r in clustering.cluster_aspects(aspects, clusters=SIX_CLUSTERS).collect()}
    assert short["Legal compliance"] == "Tax & Compliance" and short["Board diversity"] == "Unclustered"
    words = spark.createDataFrame([("Stakeholders",), ("Social",), ("SDG alignment",)], "aspect string")
    folded = {r.aspect: r.aspect_cluster for r in clustering.cluster_aspects(words, casefold_keywords=True).collect()}
    assert folded == {"Stakeholders": "Governance & Board", "Social": "Community & Social Impact",
                      "SDG alignment": "Biodiversity & Environmental Impact"}  # its keyword "E" comes first
    assert {r.aspect_cluster for r in clustering.cluster_aspects(words).collect()} == {"Unclustered"}
    none = clustering.cluster_aspects(spark.range(1))
    assert none.first().aspect_cluster == "Unclustered"
    capital = {"Env": ["E"]}
    one = spark.createDataFrame([("E",)], "aspect string")
    assert clustering.cluster_aspects(one, clusters=capital).first().aspect_cluster == "Unclustered"
    assert clustering.cluster_aspects(one, clusters=capital, casefold_keywords=True).first().aspect_cluster == "Env"


def test_cluster_counts(aspects, rows):
    by_cluster = Counter(c for _, c in ASPECT_CASES for _ in range(2))
    top = [tuple(r) for r in clustering.top_clusters(aspects, 3).orderBy("rank").collect()]
    assert top == [(c, n, i + 1) for i, (c, n) in enumerate(sorted(by_cluster.items(), key=lambda x: (-x[1], x[0]))[:3])]
    mapping = rows(clustering.aspect_cluster_mapping(aspects), "aspect", "aspect_cluster", "count")
    assert {(m[0], m[1], m[2]) for m in mapping} == {(a, c, 2) for a, c in ASPECT_CASES if a is not None}
    assert clustering.aspect_cluster_mapping(aspects, distinct=True).columns == ["aspect", "aspect_cluster"]
    report = [r.line for r in clustering.unclustered_report(aspects).collect()]
    assert report == [" (2)", "E (2)", "xyz (2)"]
    assert clustering.cluster_coverage(aspects).first() == (22, 14, 8, pytest.approx(14 * 100 / 22))


def test_keywords_stay_in_the_jvm(aspects):
    plan = clustering.cluster_aspects(aspects)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("applySchemaToPythonRDD", "") and "Exchange" not in plan


@pytest.fixture(scope="module")
def triples(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        hot = rng.random() < 0.4
        a = "env" if hot else rng.choice(["env", "soc", "zzz"])
        s = "pos" if hot else rng.choice(["pos", "neg", "none"])
        data.append((i * 7, a, s, rng.choice(["pledge", "result", "action", "action", "zz"])))
    for i, t in enumerate(["pledge", "action"]):
        data.append((9000 + i, "gov", "neutral", t))
    df = spark.createDataFrame(data, "row_id long, aspect_category string, sentiment string, tone string").repartition(5)
    return normalize_labels(df)


def local(df):
    return [tuple(r) for r in df.select("row_id", *flows.LABELS).collect()]


def test_minimum_tone(triples):
    groups = defaultdict(Counter)
    for _, a, s, t in local(triples):
        groups[a, s][t] += 1
    got = balance.minimum_tone_distribution(triples, with_ranking=True).collect()
    assert [(r.aspect_category, r.sentiment) for r in got] == sorted(groups)
    for r in got:
        c = groups[r.aspect_category, r.sentiment]
        tone, n = min(c.items(), key=lambda x: (x[1], x[0]))
        assert (r.minimum_tone, r.minimum_amount, r.group_count) == (tone, n, c.total())
        ranked = sorted(c.items(), key=lambda x: (-x[1], x[0]))
        assert r.descending_order == ", ".join(t for t, _ in ranked)
        assert r.data_distribution == ", ".join(str(n) for _, n in ranked)
    table = balance.minimum_tone_distribution(triples)
    total = sum(r.minimum_amount for r in got)
    assert table.columns == ["aspect_category", "sentiment", "minimum_tone", "minimum_amount", "group_count"]
    assert sum(r.minimum_amount for r in balance.combined_minimum_tone(table).collect()) == total
    matrix = balance.minimum_tone_matrix(table, SENTIMENTS.order).collect()
    assert sum(sum(r[c] for c in SENTIMENTS.order) for r in matrix) == total


def graph_by_hand(flow, order):
    """``flow``: list of (a, s, t, n) sorted by label."""
    cells = [[f"Aspect|{a}", f"Sentiment|{s}", f"Tone|{t}"] for a, s, t, _ in flow]
    if order == "first_seen":
        names = list(dict.fromkeys(c for row in cells for c in row))
    else:
        names = []
        for i in range(3):
            totals = Counter()
            for row, f in zip(cells, flow):
                totals[row[i]] += f[3]
            names += sorted(totals, key=lambda k: (-totals[k], k))
    ids = {n: i for i, n in enumerate(names)}
    links = Counter()
    for row, f in zip(cells, flow):
        links[ids[row[0]], ids[row[1]], f[3]] += 1
        links[ids[row[1]], ids[row[2]], f[3]] += 1
    return ids, links


@pytest.mark.parametrize("order", ["total", "first_seen"])
def test_flow_graph(triples, order):
    counted = Counter(r[1:] for r in local(triples))
    flow = sorted((*k, n) for k, n in counted.items())
    ids, links = graph_by_hand(flow, order)
    graph = flows.flow_graph(flows.flow_counts(triples), order=order)
    nodes = graph.nodes.collect()
    assert {f"{n.layer}|{n.name}": n.node_id for n in nodes} == ids
    assert len(nodes) == len(ids) and {n.label for n in nodes} >= {"Aspect: Environmental", "Tone: Action"}
    got = [tuple(r) for r in graph.links.collect()]
    assert Counter(got) == links
    for n in nodes:
        if n.layer == "Sentiment":
            into = sum(v for _, t, v in got if t == n.node_id)
            assert into == sum(v for s, _, v in got if s == n.node_id) > 0
    marginals = {(r.layer, r.name): (r.total, r["rank"]) for r in flows.flow_marginals(flows.flow_counts(triples)).collect()}
    assert marginals["Aspect", "E"][1] == 1


@pytest.mark.parametrize("order", ["total", "first_seen"])
def test_nodes_of_raw_labels_are_numbered_by_range(spark, order):
    """Labels without a bound: no exchange to a single task, ids dense and in order."""
    flow = spark.range(5000).selectExpr(
        "concat('a', id % 1700) AS aspect_category_norm", "concat('s', id % 611) AS sentiment_norm", "concat('t', id * 7 % 5000) AS tone_norm", "1 + id % 5 AS count")
    graph = flows.flow_graph(flow, order=order, ontologies=None)
    for frame in graph:
        assert "SinglePartition" not in frame._jdf.queryExecution().executedPlan().toString()
    found = [tuple(r) for r in graph.nodes.select("node_id", "layer", "name").collect()]
    rows = sorted(tuple(r) for r in flow.collect())
    if order == "total":
        wanted = []
        for i, layer in enumerate(flows.LAYERS):
            totals = Counter()
            for r in rows:
                totals[r[i]] += r[3]
            wanted += [(layer, name) for name in sorted(totals, key=lambda k: (-totals[k], k))]
    else:
        wanted = list(dict.fromkeys((flows.LAYERS[i], r[i]) for r in rows for i in range(3)))
    assert sorted(found) == [(i, *w) for i, w in enumerate(wanted)]
    assert graph.links.count() == 2 * len(rows)


def test_flow_with_a_missing_code_keeps_its_links(spark):
    flow = spark.createDataFrame([("a", None, "t", 2), (None, "s", "t", 1)], "aspect_category_norm string, sentiment_norm string, tone_norm string, count long")
    graph = flows.flow_graph(flow, ontologies=None)
    assert graph.links.count() == 4 and sorted(r.node_id for r in graph.nodes.collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("n", [1, 5, 40, 500])
def test_balanced_sample(triples, n):
    targets = balance.minimum_tone_distribution(triples)
    sizes = {(r.aspect_category, r.sentiment, r.minimum_tone): r.minimum_amount for r in targets.collect()}
    members = defaultdict(set)
    for r, a, s, t in local(triples):
        members[a, s, t].add(r)
    sample = balance.balanced_sample(triples, targets, n)
    again = balance.balanced_sample(triples.repartition(3), targets, n, small_targets=False)
    got = defaultdict(list)
    for r in sample.collect():
        key = (r.target_aspect, r.target_sentiment, r.target_tone)
        assert (r.aspect_category_norm, r.sentiment_norm, r.tone_norm) == key
        got[key].append(r.row_id)
    assert set(got) == set(sizes)
    for key, ids in got.items():
        assert len(ids) == n and set(ids) <= members[key]
        if sizes[key] >= n:
            assert len(set(ids)) == n
    assert Counter(r.row_id for r in again.collect()) == Counter(i for ids in got.values() for i in ids)
    other = balance.balanced_sample(triples, targets, n, seed=7)
    if n == 40:
        assert Counter(r.row_id for r in other.collect()) != Counter(i for ids in got.values() for i in ids)


def test_sample_takes_the_smallest_hashes(triples):
    targets = balance.minimum_tone_distribution(triples)
    place = F.shiftrightunsigned(F.xxhash64(F.lit(42).cast("long"), F.col("row_id")), 1)
    hashes = {r[0]: r[1] for r in triples.select("row_id", place).collect()}
    members = defaultdict(list)
    for r, a, s, t in local(triples):
        members[a, s, t].append(r)
    got = defaultdict(set)
    for r in balance.balanced_sample(triples, targets, 6).collect():
        got[r.target_aspect, r.target_sentiment, r.target_tone].add(r.row_id)
    for key, ids in got.items():
        if len(members[key]) >= 6:
            assert ids == set(sorted(members[key], key=hashes.get)[:6])


def test_sampling_reads_the_table_three_times(triples, spark, tmp_path):
    """Once for the targets, once for the level counts, once for the rows."""
    triples.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    sample = balance.balanced_sample(df, balance.minimum_tone_distribution(df), 3)
    sample.collect()
    final = sample._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 3 and "ReusedExchange" in final
    assert "SortMergeJoin" not in final and "Python" not in final


def test_patterns_find_words_literally(spark):
    from labelscope.functions.text import any_of

    rng = random.Random(11)
    letters = "ab.*\\E[(^$ é😀"
    for _ in range(4):
        words = ["".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(5)]
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(150)]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [r[0] for r in df.select(F.col("t").rlike(any_of(words))).collect()]
        assert got == [any(w in t for w in words) for t in texts]
    assert spark.range(1).select(F.lit("").rlike(any_of(["", "x"]))).first()[0]


def test_clusters_against_brute_force(spark):
    rng = random.Random(12)
    words = [w for v in CLUSTERS.values() for w in v]
    texts = [" ".join(rng.choices([*words, "Zz", "q", "BOARD"], k=rng.randint(0, 3))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "aspect string")
    for table in (CLUSTERS, SIX_CLUSTERS, {"A": [], "B": ["(x", "q"]}, {}):
        def first(t):
            return next((c for c, ws in table.items() if any(w in t.lower() for w in ws)), "Unclustered")

        got = clustering.cluster_aspects(df, clusters=table).collect()
        assert [(r.aspect, r.aspect_cluster) for r in got] == [(t, first(t)) for t in texts]
