"""Registered queries: every operator over the derived tables, each with its SQL where there is one.

A query is ``(spark, folder) -> DataFrame``. Its SQL names the views of
``derived.oracle_views`` and must give the same rows; floats are rounded to six
decimals on both sides.
"""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelscope import defaults
from labelscope.operators import balance, clustering, coverage, distributions, evaluation, filters
from labelscope.operators import flows, grounding, labels, parsing, profiles, rules, scoring
from labelscope.plans.derived import Derived, oracle_views
from labelscope.plans.workflows import rarest_tones
from labelscope.session import shared_path
from labelscope.sources import ontologies, sinks, tables
from labelscope.sources.ontologies import ASPECTS, SENTIMENTS, TONES, Ontology

Query = Callable[[Derived], DataFrame]

MODELS = ["alpha/m1", "alpha/m2", "beta"]
PAGE = "filename, page_number"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(run: Query) -> Query:
        key = name or run.__name__
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return run

    return add


# --- pieces of SQL -----------------------------------------------------------------

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def code_case(column: str, ontology: Ontology) -> str:
    whens = " ".join(f"WHEN {quoted(a)} THEN {quoted(c)}" for a, c in ontology.aliases.items())
    return f"CASE lower(trim({column})) {whens} ELSE 'OTHER' END"


def label_case(column: str, ontology: Ontology) -> str:
    whens = " ".join(f"WHEN {quoted(c)} THEN {quoted(t)}" for c, t in ontology.labels.items())
    return f"CASE {column} {whens} END"


def cluster_case(column: str, clusters: dict[str, list[str]]) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({column}), {quoted(k)})" for k in words) + f" THEN {quoted(name)}"
        for name, words in clusters.items()
    )
    return f"CASE {whens} ELSE 'Unclustered' END"


def order_values(ontology: Ontology) -> str:
    return "(VALUES " + ", ".join(f"({quoted(c)}, {i})" for i, c in enumerate(ontology.order)) + ") AS o(code, ord)"


def _norm(view: str) -> str:
    return f"""SELECT *, {code_case("aspect_category", ASPECTS)} AS aspect_category_norm,
        {code_case("sentiment", SENTIMENTS)} AS sentiment_norm, {code_case("tone", TONES)} AS tone_norm FROM {view}"""


def oracle_sql() -> dict[str, str]:
    views = oracle_views()
    views["nlab"] = _norm("lab")
    views["nord"] = _norm("ordlab")
    views["nparsed"] = _norm("parsed")
    views["tones"] = """
        SELECT a AS aspect_category, s AS sentiment, t AS minimum_tone, n AS minimum_amount, total AS group_count
        FROM (SELECT *, row_number() OVER (PARTITION BY a, s ORDER BY n, t) AS r,
                     CAST(sum(n) OVER (PARTITION BY a, s) AS BIGINT) AS total
              FROM (SELECT aspect_category_norm AS a, sentiment_norm AS s, tone_norm AS t, count(*) AS n
                    FROM nlab GROUP BY ALL) AS c) AS x WHERE r = 1"""
    views["flow"] = """SELECT aspect_category_norm AS a, sentiment_norm AS s, tone_norm AS t, count(*) AS n
        FROM nlab GROUP BY ALL"""
    views["page_first"] = """
        SELECT filename, page_number, markdown_full, cleaned_markdown
        FROM (SELECT filename, page_number, min(row_id) AS row_id FROM ground GROUP BY ALL) AS f
        JOIN ground_raw USING (row_id, filename, page_number)"""
    views["sent_index"] = """
        SELECT filename, page_number, sentence,
               row_number() OVER (PARTITION BY filename, page_number ORDER BY f) AS "index"
        FROM (SELECT filename, page_number, sentence, min(row_id * 1000000 + pos) AS f FROM ground
              WHERE sentence IS NOT NULL GROUP BY ALL) AS x"""
    views["flagged"] = """
        SELECT g.*, coalesce(contains(markdown_full, sentence) OR contains(cleaned_markdown, sentence), FALSE) AS grounded
        FROM ground g LEFT JOIN page_first USING (filename, page_number)"""
    views["aligned"] = """
        SELECT g.sentence, g.row_id AS row_id_gt, p.row_id AS row_id_pred,
               g.aspect_category AS aspect_category_gt, p.aspect_category AS aspect_category_pred,
               g.sentiment AS sentiment_gt, p.sentiment AS sentiment_pred, g.tone AS tone_gt, p.tone AS tone_pred,
               g.confidence AS confidence_gt, p.confidence AS confidence_pred
        FROM (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY row_id) AS k FROM gt) AS g
        JOIN (SELECT *, row_number() OVER (PARTITION BY sentence ORDER BY row_id) AS k FROM pred) AS p
        ON g.sentence = p.sentence AND g.k = p.k"""
    views["profile"] = "SELECT filename, " + ", ".join(
        [f"count(*) FILTER (sentiment_norm = '{c}') AS \"sent_{c}\"" for c in SENTIMENTS.order]
        + [f"count(*) FILTER (tone_norm = '{c}') AS \"tone_{c}\"" for c in TONES.order]
    ) + " FROM nlab GROUP BY filename"
    head = "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in views.items())
    return {name: f"{head}\n{text}" for name, text in SQL.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(run: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: run(Derived(spark, folder))

    return {name: bind(run) for name, run in QUERIES.items()}


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Raw answers -> sentences -> codes -> rarest tone of each aspect and sentiment."""
    return rarest_tones(Derived(spark, folder).sentences.filter("pos IS NOT NULL"))


def six(column: str) -> Column:
    return F.round(column, 6).alias(column)


# --- sources and sinks -------------------------------------------------------------

@query("SELECT row_id, filename, page_number, model, text FROM raw")
def csv_round_trip(d: Derived) -> DataFrame:
    """Raw answers written as CSV and read again, quotes and line breaks included."""
    path = shared_path(d.spark, "answers_csv")
    sinks.write_csv(d.raw, path)
    rows = tables.read_csv_table(d.spark, path)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("row_id", "page_number")})


@query("""SELECT row_id AS order_key, row_number() OVER (ORDER BY row_id) - 1 AS row_id, filename, page_number, model, text FROM raw""")
def annotation_scan(d: Derived) -> DataFrame:
    """The scan with row ids of its own: every row once, ids dense and in the order of the rows as written."""
    path = shared_path(d.spark, "scan_csv")
    sinks.write_csv(d.raw.withColumnRenamed("row_id", "order_key").orderBy("order_key"), path)
    rows = tables.harden_schema(tables.read_annotations(d.spark, path))
    return rows.withColumn("order_key", F.col("order_key").cast("long"))


@query("SELECT 'local' AS tag, count(*) AS rows FROM lab")
def first_available_source(d: Derived) -> DataFrame:
    path = shared_path(d.spark, "labels_csv")
    sinks.write_csv(d.lab.select("aspect_category", "sentiment", "tone"), path)
    broken = "nowhere://no-such-store/labels.csv"  # a file system that cannot be opened
    packed = gzip.compress(b"aspect_category,sentiment,tone\n" + os.urandom(4096).hex().encode())
    hollow = {"empty.csv": b"", "headless.csv": b"\n\n", "cut.csv.gz": packed[: len(packed) // 2]}  # nothing in them can be read
    for name, data in hollow.items():
        sinks.write_bytes(d.spark, f"{path}-hollow/{name}", data)
    candidates = [
        ("uploaded", None), ("remote", path + "-absent"), ("store", broken), *((n, f"{path}-hollow/{n}") for n in hollow), ("local", path)
    ]
    df, _ = tables.read_first_available(d.spark, candidates)
    tables.validate_columns(df, ["aspect_category", "sentiment", "tone"])
    return df.groupBy(F.col("source_tag").alias("tag")).agg(F.count("*").alias("rows"))


@query(f"""
SELECT 'aspect' AS kind, code AS name, count(aspect_category_norm) AS count, {label_case("code", ASPECTS)} AS label
FROM {order_values(ASPECTS)} LEFT JOIN nlab ON aspect_category_norm = code GROUP BY ALL
UNION ALL
SELECT 'sentiment' AS kind, code AS name, count(sentiment_norm) AS count, {label_case("code", SENTIMENTS)} AS label
FROM {order_values(SENTIMENTS)} LEFT JOIN nlab ON sentiment_norm = code GROUP BY ALL
UNION ALL
SELECT 'tone' AS kind, code AS name, count(tone_norm) AS count, {label_case("code", TONES)} AS label
FROM {order_values(TONES)} LEFT JOIN nlab ON tone_norm = code GROUP BY ALL""")
def label_summary_export(d: Derived) -> DataFrame:
    """The summaries as written to JSON records and read again."""
    path = shared_path(d.spark, "summaries")
    kinds = {
        "aspect": ("aspect_category_norm", ASPECTS), "sentiment": ("sentiment_norm", SENTIMENTS), "tone": ("tone_norm", TONES)
    }
    sinks.write_label_summaries(
        {k: distributions.label_summary(d.labelled, c, "name", o) for k, (c, o) in kinds.items()}, path
    )
    found = [
        d.spark.read.schema("name string, count long, label string")
        .json(f"{path}/{k}_summary")
        .select(F.lit(k).alias("kind"), "*")
        for k in kinds
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


_OBJECTS = "'{{\"name\":\"' || code || '\",\"count\":' || n || ',\"label\":\"' || label || '\"}}'"


@query(f"""SELECT '[' || string_agg({_OBJECTS.format()}, ',' ORDER BY ord) || ']' AS document FROM (
SELECT code, ord, count(tone_norm) AS n, {label_case("code", TONES)} AS label
FROM {order_values(TONES)} LEFT JOIN nlab ON tone_norm = code GROUP BY ALL) AS x""")
def label_summary_document(d: Derived) -> DataFrame:
    """A summary as one JSON document."""
    table = distributions.label_distribution(d.labelled, "tone_norm", TONES)
    return sinks.records_document(table.select(F.col("tone_norm").alias("name"), "count", "label", "ord"), "ord")


@query("SELECT sentiment_norm AS code, count(*) AS rows FROM nlab GROUP BY ALL")
def ontology_file(d: Derived) -> DataFrame:
    """Labels normalised with an ontology read from its JSON document."""
    document = {c: {"label": t, "aliases": [*a, None]} for c, (t, a) in defaults.SENTIMENT_ONTOLOGY.items()}
    path = shared_path(d.spark, "ontology")
    text = d.spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1)
    text.write.text(path)
    loaded = ontologies.load_ontology(d.spark, f"{path}/*.txt")
    rows = labels.normalize_labels(d.lab, {"sentiment": loaded})
    return rows.groupBy(F.col("sentiment_norm").alias("code")).agg(F.count("*").alias("rows"))


@query("SELECT sentiment_norm AS code, count(*) AS rows FROM nlab GROUP BY ALL")
def ontology_table(d: Derived) -> DataFrame:
    """The same by a join with the document read as a table."""
    document = {c: {"label": t, "aliases": a} for c, (t, a) in defaults.SENTIMENT_ONTOLOGY.items()}
    path = shared_path(d.spark, "ontology")
    d.spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.text(path)
    rows = labels.normalize_labels(d.lab, {"sentiment": ontologies.ontology_table(d.spark, f"{path}/*.txt")})
    return rows.groupBy(F.col("sentiment_norm").alias("code")).agg(F.count("*").alias("rows"))


@query(f"SELECT aspect_cluster, count(*) AS rows FROM (SELECT {cluster_case('aspect', defaults.SIX_CLUSTERS)} AS aspect_cluster FROM lab) AS x GROUP BY ALL")
def cluster_file(d: Derived) -> DataFrame:
    """Aspects clustered by a table read from its JSON document."""
    path = shared_path(d.spark, "clusters")
    d.spark.createDataFrame([(json.dumps(defaults.SIX_CLUSTERS),)], "value string").coalesce(1).write.text(path)
    rows = clustering.cluster_aspects(d.lab, clusters=ontologies.load_clusters(d.spark, f"{path}/*.txt"))
    return rows.groupBy("aspect_cluster").agg(F.count("*").alias("rows"))


@query("SELECT * FROM ordlab ORDER BY row_id LIMIT 30")
def preview_rows(d: Derived) -> DataFrame:
    return tables.preview(d.ordlab, 30)


# --- parsing -----------------------------------------------------------------------

@query("""SELECT raw.row_id, filename, page_number, model, text, count(p.row_id) AS parsed_objects
FROM raw LEFT JOIN (SELECT row_id FROM parsed WHERE pos IS NOT NULL) AS p ON raw.row_id = p.row_id GROUP BY ALL""")
def parse_report(d: Derived) -> DataFrame:
    return parsing.parse_report(d.raw).withColumn("parsed_objects", F.col("parsed_objects").cast("long"))


@query("""SELECT row_id, pos, filename, page_number, model, sentence, aspect, aspect_category, sentiment, tone,
confidence, CASE WHEN contains(model, '/') THEN split_part(model, '/', 1) ELSE 'unknown' END AS provider FROM parsed""")
def parsed_sentences(d: Derived) -> DataFrame:
    wanted = ["row_id", "pos", "filename", "page_number", "model", "sentence", "aspect", "aspect_category",
              "sentiment", "tone", "confidence", "provider"]
    return parsing.sentence_table(d.sentences, wanted)


@query("""SELECT key, count(*) AS count FROM (SELECT unnest(CASE WHEN mistyped THEN ['meta', 'sentiment', 'confidence']
ELSE ['meta'] END) AS key FROM parsed WHERE pos = 0) AS x GROUP BY key""")
def extra_annotation_keys(d: Derived) -> DataFrame:
    return parsing.extra_keys(d.sentences)


@query("""SELECT 'confidence' AS key, '"high"' AS value, count(*) AS count FROM parsed WHERE mistyped
UNION ALL SELECT 'sentiment', '{"label":"' || o_orderstatus || '"}', count(*) FROM parsed WHERE mistyped GROUP BY o_orderstatus""")
def mistyped_fields(d: Derived) -> DataFrame:
    """Values of known fields that are of another type than the field."""
    return parsing.mistyped_fields(d.sentences)


@query("SELECT count(*) AS records FROM parsed")
def record_count(d: Derived) -> DataFrame:
    return tables.record_count(d.sentences)


@query("""SELECT raw.row_id, model, text, count(p.row_id) AS parsed_objects
FROM raw LEFT JOIN (SELECT row_id FROM parsed WHERE pos IS NOT NULL) AS p ON raw.row_id = p.row_id
WHERE filename = 'doc_7.pdf' AND page_number = 16 GROUP BY ALL""")
def raw_answers_of_page(d: Derived) -> DataFrame:
    page = filters.drill_down(d.raw, filename="doc_7.pdf", page_number="16")
    report = parsing.parse_report(page).drop("filename", "page_number")
    return report.withColumn("parsed_objects", F.col("parsed_objects").cast("long"))


TONES_SQL = "SELECT aspect_category, sentiment, minimum_tone, minimum_amount, group_count FROM "


@query(f"""SELECT a AS aspect_category, s AS sentiment, t AS minimum_tone, n AS minimum_amount, total AS group_count
FROM (SELECT *, row_number() OVER (PARTITION BY a, s ORDER BY n, t) AS r,
             CAST(sum(n) OVER (PARTITION BY a, s) AS BIGINT) AS total
      FROM (SELECT aspect_category_norm AS a, sentiment_norm AS s, tone_norm AS t, count(*) AS n
            FROM nparsed WHERE pos IS NOT NULL GROUP BY ALL) AS c) AS x WHERE r = 1""")
def rarest_tone_of_answers(d: Derived) -> DataFrame:
    """The flagship: from raw answers to the rarest tone of each aspect and sentiment."""
    return rarest_tones(d.sentences.filter("pos IS NOT NULL"))


# --- labels and distributions ------------------------------------------------------

@query(f"""SELECT row_id, aspect_category AS aspect_category_raw, aspect_category_norm, sentiment AS sentiment_raw,
sentiment_norm, tone AS tone_raw, tone_norm, {label_case("aspect_category_norm", ASPECTS)} AS aspect_category_label,
{label_case("sentiment_norm", SENTIMENTS)} AS sentiment_label, {label_case("tone_norm", TONES)} AS tone_label FROM nord""")
def normalized_labels(d: Derived) -> DataFrame:
    rows = labels.with_labels(labels.normalize_labels(d.ordlab, keep_raw=True))
    return rows.drop("aspect_category", "sentiment", "tone")


@query("""SELECT upper(trim(aspect_category)) AS aspect_category_norm, upper(trim(sentiment)) AS sentiment_norm,
count(*) AS count FROM lab GROUP BY ALL""")
def uppercase_labels(d: Derived) -> DataFrame:
    rows = labels.normalize_labels(d.lab, {"aspect_category": None, "sentiment": None})
    return rows.groupBy("aspect_category_norm", "sentiment_norm").agg(F.count("*").alias("count"))


for _column in ("sentiment", "aspect_category"):
    query(
        f"SELECT {_column}, count(*) AS count FROM lab WHERE {_column} IS NOT NULL GROUP BY ALL",
        f"value_counts_{_column}",
    )(lambda d, c=_column: distributions.value_counts(d.lab, c))

for _column, _ontology in labels.ONTOLOGIES.items():
    _code = f"{_column}_norm"
    query(
        f"""SELECT code AS {_code}, count({_code}) AS count, {label_case("code", _ontology)} AS label, ord
        FROM {order_values(_ontology)} LEFT JOIN nlab ON {_code} = code GROUP BY ALL""",
        f"label_distribution_{_column}",
    )(lambda d, c=_code, o=_ontology: distributions.label_distribution(d.labelled, c, o))
    query(
        f"""SELECT {_code}, count(*) AS count, round(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage,
        {label_case(_code, _ontology)} AS label FROM nlab GROUP BY {_code}""",
        f"category_table_{_column}",
    )(lambda d, c=_code, o=_ontology: distributions.category_table(d.labelled, c, o))

_SHARES = """SELECT * FROM (SELECT {c}, count(*) AS count,
round(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage, '❓ Not in ontology' AS label FROM {v} GROUP BY 1) AS x"""


@query(_SHARES.format(c="aspect_category_norm", v="nlab").replace(
    "'❓ Not in ontology'", label_case("aspect_category_norm", ASPECTS))
    + " WHERE aspect_category_norm = 'OTHER' OR percentage < 1.0")
def flagged_categories(d: Derived) -> DataFrame:
    table = distributions.category_table(d.labelled, "aspect_category_norm", ASPECTS)
    return filters.flag_categories(table, "aspect_category_norm")


@query(_SHARES.format(c="upper(trim(sentiment)) AS sentiment_norm", v="lab WHERE sentiment IS NOT NULL")
       + " WHERE sentiment_norm IN ('OTHER', 'NONE', 'UNKNOWN') OR percentage < 1.0")
def flagged_raw_categories(d: Derived) -> DataFrame:
    rows = labels.normalize_labels(d.lab, {"sentiment": None})
    table = distributions.category_table(rows, "sentiment_norm")
    return filters.flag_categories(table, "sentiment_norm", fallback=("OTHER", "NONE", "UNKNOWN"))


for _second, _onto in (("sentiment", SENTIMENTS), ("tone", TONES)):
    query(
        f"""SELECT aspect_category_norm, {_second}_norm, count(*) AS count,
        {label_case("aspect_category_norm", ASPECTS)} AS aspect_label, {label_case(_second + "_norm", _onto)} AS {_second}_label
        FROM nlab GROUP BY ALL""",
        f"crosstab_aspect_{_second}",
    )(lambda d, s=_second, o=_onto: distributions.crosstab_long(
        d.labelled, ("aspect_category_norm", "aspect_label", ASPECTS), (f"{s}_norm", f"{s}_label", o)))
    query(
        f"""SELECT code AS aspect_category_norm, ord, {", ".join(f'm."{t}"' for t in _onto.labels.values())}
        FROM {order_values(ASPECTS)} LEFT JOIN (SELECT aspect_category_norm, {", ".join(
            f"count(*) FILTER ({_second}_norm = {quoted(c)}) AS {chr(34)}{t}{chr(34)}" for c, t in _onto.labels.items())}
        FROM nlab WHERE sentence IS NOT NULL GROUP BY 1) AS m ON aspect_category_norm = code""",
        f"heatmap_aspect_{_second}",
    )(lambda d, s=_second, o=_onto: distributions.crosstab_wide(
        d.labelled, "aspect_category_norm", ASPECTS, f"{s}_norm", o))


@query("""SELECT aspect, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, aspect) AS INT) AS rank
FROM lab WHERE aspect IS NOT NULL GROUP BY aspect ORDER BY count DESC, aspect LIMIT 15""")
def top_aspects(d: Derived) -> DataFrame:
    return distributions.top_values(d.lab, "aspect", 15)


@query("""SELECT coalesce(ontology_uri, 'UNKNOWN') AS ontology_uri, count(*) AS count,
CAST(row_number() OVER (ORDER BY count(*) DESC, coalesce(ontology_uri, 'UNKNOWN')) AS INT) AS rank
FROM lab GROUP BY 1 ORDER BY rank LIMIT 30""")
def top_ontology_uris(d: Derived) -> DataFrame:
    return distributions.top_values(d.lab, "ontology_uri", 30, fill="UNKNOWN")


@query("""SELECT source, token, count(*) AS count
FROM (SELECT source, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]+')) AS token FROM documents) AS x
WHERE token <> '' GROUP BY ALL""")
def token_counts(d: Derived) -> DataFrame:
    return distributions.token_counts(d.documents, "text", ["source"])


# --- filters -----------------------------------------------------------------------

@query("""SELECT filename, page_number, model, sentence, sentiment, tone, confidence FROM lab
WHERE sentiment IN ('negative', 'Positif') AND tone IS NOT NULL AND aspect_category IS NOT NULL
AND confidence BETWEEN 0.25 AND 0.5""")
def filtered_sentences(d: Derived) -> DataFrame:
    selections = {
        "sentiment": ["negative", "Positif"],
        "tone": filters.ANY_VALUE,
        "aspect_category": filters.ANY_VALUE,
        "model": [],
        "materiality": ["high"],
    }
    rows = filters.apply_filters(d.lab, selections, confidence=(0.25, 0.5))
    return rows.select("filename", "page_number", "model", "sentence", "sentiment", "tone", "confidence")


@query("""SELECT sentence, aspect, sentiment, model FROM lab
WHERE filename = 'doc_3.pdf' AND page_number = 11""")
def page_drill_down(d: Derived) -> DataFrame:
    rows = filters.drill_down(d.lab, filename="doc_3.pdf", page_number="11")
    return rows.select("sentence", "aspect", "sentiment", "model")


@query("""SELECT tone_norm, count(*) AS matching FROM nlab
WHERE aspect_category_norm = 'E' AND sentiment_norm = 'NEGATIVE' GROUP BY ALL""")
def waterfall(d: Derived) -> DataFrame:
    rows = filters.waterfall_filter(
        d.labelled, aspect_category_norm="E", sentiment_norm="NEGATIVE", tone_norm=filters.ALL
    )
    return rows.groupBy("tone_norm").agg(F.count("*").alias("matching"))


@query(TONES_SQL + """tones WHERE aspect_category IN ('E', 'S', 'G') AND sentiment IN ('POSITIVE', 'NEGATIVE')
AND minimum_tone IN ('OTHER', 'OUTCOME')""")
def tone_table_filter(d: Derived) -> DataFrame:
    table = balance.minimum_tone_distribution(d.labelled)
    return filters.filter_tone_table(table, ["E", "S", "G"], ["POSITIVE", "NEGATIVE"], ["OTHER", "OUTCOME"])


@query("""SELECT DISTINCT "column", value FROM (
SELECT 'aspect_category' AS "column", aspect_category AS value FROM lab
UNION ALL SELECT 'sentiment', sentiment FROM lab UNION ALL SELECT 'tone', tone FROM lab
UNION ALL SELECT 'filename', filename FROM lab UNION ALL SELECT 'page_number', CAST(page_number AS VARCHAR) FROM lab
) AS x WHERE value IS NOT NULL""")
def filter_options(d: Derived) -> DataFrame:
    return filters.filter_options(d.lab, [*filters.FILTER_COLUMNS, "filename", "page_number"])


@query("SELECT min(confidence) AS lowest, max(confidence) AS highest FROM lab")
def confidence_bounds(d: Derived) -> DataFrame:
    return filters.confidence_bounds(d.lab)


# --- profiles ----------------------------------------------------------------------

_PROFILE = profiles.profile_columns()


@query("SELECT * FROM profile")
def document_profile(d: Derived) -> DataFrame:
    return profiles.document_profile(d.labelled)


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS sentiment, CAST(sum(\"sent_{c}\") AS BIGINT) AS count FROM profile" for c in SENTIMENTS.order))
def sentiment_composition(d: Derived) -> DataFrame:
    return profiles.composition(profiles.document_profile(d.labelled), "sent_", "sentiment")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS tone, CAST(sum(\"tone_{c}\") AS BIGINT) AS count FROM profile" for c in TONES.order))
def tone_composition(d: Derived) -> DataFrame:
    return profiles.composition(profiles.document_profile(d.labelled), "tone_", "tone")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(\"{c}\"), 2) AS mean, round(stddev_samp(\"{c}\"), 2) AS std FROM profile"
    for c in _PROFILE))
def profile_stats(d: Derived) -> DataFrame:
    return profiles.profile_stats(profiles.document_profile(d.labelled))


@query(" UNION ALL ".join(
    f"""SELECT '{a}' AS first, '{b}' AS second, CASE WHEN stddev_samp("{a}") * stddev_samp("{b}") > 0
    THEN round(covar_samp("{a}", "{b}") / (stddev_samp("{a}") * stddev_samp("{b}")), 6) END AS corr FROM profile"""
    for a in _PROFILE for b in _PROFILE))
def profile_correlation(d: Derived) -> DataFrame:
    found = profiles.profile_correlation(profiles.document_profile(d.labelled))
    return found.select("first", "second", six("corr"))


# --- coverage of models ------------------------------------------------------------

@query("SELECT filename, count(DISTINCT model) AS unique_model_count FROM lab GROUP BY 1")
def models_per_document(d: Derived) -> DataFrame:
    return coverage.models_per_document(d.lab)


@query(f"SELECT {PAGE}, count(DISTINCT model) AS unique_model_count FROM ground GROUP BY ALL")
def models_per_page(d: Derived) -> DataFrame:
    return coverage.models_per_page(d.ground)


@query(f"SELECT {PAGE}, string_agg(DISTINCT model, ', ' ORDER BY model) AS models FROM ground GROUP BY ALL")
def models_per_page_list(d: Derived) -> DataFrame:
    return coverage.models_per_page_list(d.ground).drop("model")


@query(f"SELECT {PAGE}, model, count(sentence) AS count FROM ground GROUP BY ALL")
def model_page_counts(d: Derived) -> DataFrame:
    return coverage.model_page_matrix(d.ground)


@query(f"SELECT {PAGE}, " + ", ".join(
    f"count(sentence) FILTER (model = '{m}') AS \"{m}\"" for m in MODELS) + " FROM ground GROUP BY ALL")
def model_page_matrix(d: Derived) -> DataFrame:
    return coverage.model_page_matrix(d.ground, MODELS)


@query("SELECT DISTINCT model FROM ground")
def model_list(d: Derived) -> DataFrame:
    """The names that wide tables get as columns."""
    return d.spark.createDataFrame([(m,) for m in coverage.model_list(d.ground)], "model string")


@query(f"SELECT {PAGE}, " + ", ".join(
    f"count(sentence) FILTER (model = '{m}') AS \"{m}\"" for m in MODELS) + " FROM ground GROUP BY ALL")
def model_page_matrix_found(d: Derived) -> DataFrame:
    """The wide table with the columns that the data name."""
    return coverage.model_page_matrix(d.ground, coverage.model_list(d.ground))


@query("""SELECT DISTINCT "column", value FROM (SELECT unnest(['model', 'provider']) AS "column",
unnest([model, CASE WHEN contains(model, '/') THEN split_part(model, '/', 1) ELSE 'unknown' END]) AS value
FROM raw WHERE filename = 'doc_7.pdf' AND page_number = 16) AS x""")
def page_filter_options(d: Derived) -> DataFrame:
    """The models and providers to choose from on one page."""
    page = parsing.with_provider(filters.drill_down(d.raw, filename="doc_7.pdf", page_number="16"))
    return filters.filter_options(page, ["model", "provider"])


_FIRST = f"""(SELECT {PAGE}, sentence, model, arg_min(sentiment, row_id * 1000000 + pos) AS sentiment FROM ground
WHERE sentiment IS NOT NULL AND sentence IS NOT NULL GROUP BY ALL)"""
# arg_min skips NULL values, so the first row of a provider is found by its number
_FIRST_OF_PROVIDER = f"""(SELECT {PAGE}, sentence, model, sentiment FROM (SELECT *, row_number() OVER (
PARTITION BY {PAGE}, sentence, model ORDER BY row_id * 1000000 + pos) AS r FROM ground
WHERE sentence IS NOT NULL AND model LIKE 'alpha/%') AS q WHERE r = 1 AND sentiment IS NOT NULL)"""


@query(f"SELECT * FROM {_FIRST} AS x")
def model_comparison_long(d: Derived) -> DataFrame:
    return coverage.model_comparison(d.ground)


@query(f"SELECT {PAGE}, sentence, " + ", ".join(
    f"max(sentiment) FILTER (model = '{m}') AS \"{m}\"" for m in MODELS) + f" FROM {_FIRST} AS x GROUP BY ALL")
def model_comparison(d: Derived) -> DataFrame:
    return coverage.model_comparison(d.ground, MODELS)


@query(f"SELECT {PAGE}, sentence, " + ", ".join(
    f"max(sentiment) FILTER (model = '{m}') AS \"{m}\"" for m in MODELS[:2])
    + f" FROM {_FIRST_OF_PROVIDER} AS x GROUP BY ALL")
def provider_comparison(d: Derived) -> DataFrame:
    return coverage.model_comparison(d.ground, MODELS[:2], provider="alpha")


_COMPLETE = """SELECT p.filename, p.page_number, {k} array_to_string(e.m, ',') AS expected, array_to_string(p.m, ',') AS present,
array_to_string(list_sort(list_filter(e.m, lambda x: NOT list_contains(p.m, x))), ',') AS missing,
len(e.m) - len(p.m) AS missing_count, len(p.m) AS present_count, len(e.m) AS total, round(len(p.m) / len(e.m), 6) AS score
FROM (SELECT filename, page_number, {s} list_sort(list(DISTINCT model)) AS m FROM g GROUP BY ALL) AS p
JOIN (SELECT filename, {s} list_sort(list(DISTINCT model)) AS m FROM g GROUP BY ALL) AS e USING (filename {u})"""
_PROVIDER = ", CASE WHEN contains(model, '/') THEN split_part(model, '/', 1) ELSE 'unknown' END AS provider"


def _completeness(d: Derived, by_provider: bool) -> DataFrame:
    found = coverage.model_completeness(d.ground, by_provider=by_provider)
    for c in ("expected", "present", "missing"):
        found = found.withColumn(c, F.concat_ws(",", c))
    for c in ("missing_count", "present_count", "total"):
        found = found.withColumn(c, F.col(c).cast("long"))
    return found.withColumn("score", six("score"))


@query(_COMPLETE.format(k="", s="", u="").replace("FROM g ", "FROM ground "))
def model_completeness(d: Derived) -> DataFrame:
    return _completeness(d, False)


@query(_COMPLETE.format(k="p.provider,", s="provider,", u=", provider").replace(
    "FROM g ", f"FROM (SELECT * {_PROVIDER} FROM ground) AS z "))
def provider_completeness(d: Derived) -> DataFrame:
    return _completeness(d, True)


# --- grounding ---------------------------------------------------------------------

def _pages(d: Derived) -> DataFrame:
    return grounding.page_texts(d.ground_raw)


@query("SELECT * FROM page_first")
def page_texts(d: Derived) -> DataFrame:
    return _pages(d)


@query("""SELECT filename, page_number, markdown_full, cleaned_markdown FROM (
SELECT filename, page_number, min(row_id) AS row_id FROM ground WHERE sentiment = 'negative' GROUP BY ALL) AS f
JOIN ground_raw USING (row_id, filename, page_number)""")
def page_texts_after_filter(d: Derived) -> DataFrame:
    """The first row of a page is that of the filtered sentences."""
    return grounding.page_texts(filters.apply_filters(d.ground, {"sentiment": ["negative"]}), d.ground_raw)


@query(f"SELECT {PAGE}, arg_min(cleaned_markdown, row_id) AS cleaned_markdown FROM ground_raw GROUP BY ALL")
def first_cleaned_text(d: Derived) -> DataFrame:
    return grounding.first_page_text(d.ground_raw)


@query("SELECT * FROM sent_index")
def sentence_index(d: Derived) -> DataFrame:
    return grounding.sentence_index(d.ground)


@query(f"""SELECT {PAGE}, "index", sentence, contains(markdown_full, sentence) AS in_markdown_full,
contains(cleaned_markdown, sentence) AS in_cleaned_markdown,
contains(markdown_full, sentence) OR contains(cleaned_markdown, sentence) AS found_anywhere
FROM sent_index JOIN page_first USING ({PAGE})""")
def sentence_presence(d: Derived) -> DataFrame:
    return grounding.sentence_presence(d.ground, _pages(d))


_AUDIT = f"SELECT {PAGE}, sentence, aspect, sentiment, model"


@query(f"{_AUDIT}, grounded FROM flagged")
def sentence_audit(d: Derived) -> DataFrame:
    return grounding.sentence_audit(d.ground, _pages(d))


@query(f"{_AUDIT} FROM flagged WHERE grounded")
def grounded_sentences(d: Derived) -> DataFrame:
    return grounding.grounded_sentences(grounding.sentence_audit(d.ground, _pages(d)))


@query(f"{_AUDIT} FROM flagged WHERE NOT grounded")
def ungrounded_sentences(d: Derived) -> DataFrame:
    return grounding.ungrounded_sentences(grounding.sentence_audit(d.ground, _pages(d)))


def _count_of(condition: str, name: str) -> str:
    return f'count(DISTINCT sentence) FILTER ({condition}) AS "{name}"'


@query(f"""SELECT {PAGE}, count(DISTINCT model) AS num_llms, count(DISTINCT sentence) AS total_sentences,
{_count_of("grounded", "grounded")}, {_count_of("NOT grounded", "not_grounded")}, {", ".join(
    f'{_count_of(f"grounded AND model = {quoted(m)}", m + "_grounded")}, '
    f'{_count_of(f"NOT grounded AND model = {quoted(m)}", m + "_not_grounded")}' for m in MODELS)}
FROM flagged GROUP BY ALL""")
def grounding_scorecard(d: Derived) -> DataFrame:
    return grounding.grounding_scorecard(d.ground, _pages(d), models=MODELS)


@query(f"""SELECT {PAGE}, model, {_count_of("grounded", "grounded")}, {_count_of("NOT grounded", "not_grounded")}
FROM flagged GROUP BY ALL""")
def grounding_by_model(d: Derived) -> DataFrame:
    return grounding.grounding_scorecard(d.ground, _pages(d), by_model=True)


_TAG = f"{quoted(grounding.OPEN_TAG)} || '[' || s.\"index\" || '] ' || s.sentence || '{grounding.CLOSE_TAG}'"


@query(f"""SELECT {PAGE}, f AS highlighted_markdown_full, c AS highlighted_cleaned_markdown FROM (
WITH RECURSIVE steps AS (
  SELECT {PAGE}, 0 AS i, markdown_full AS f, cleaned_markdown AS c FROM page_first
  UNION ALL
  SELECT t.filename, t.page_number, i + 1, replace(f, s.sentence, {_TAG}), replace(c, s.sentence, {_TAG})
  FROM steps t JOIN sent_index s ON s.filename = t.filename AND s.page_number = t.page_number AND s."index" = i + 1
) SELECT *, row_number() OVER (PARTITION BY {PAGE} ORDER BY i DESC) AS r FROM steps) AS x WHERE r = 1""")
def highlighted_pages(d: Derived) -> DataFrame:
    return grounding.highlight_pages(d.ground, _pages(d))


# --- clusters ----------------------------------------------------------------------

for _name, _table in (("", defaults.CLUSTERS), ("_short", defaults.SIX_CLUSTERS)):
    _case = cluster_case("aspect", _table)
    query(
        f"SELECT aspect, aspect_cluster, count(*) AS count FROM (SELECT aspect, {_case} AS aspect_cluster FROM lab) AS x GROUP BY ALL",
        f"clustered_rows{_name}",
    )(lambda d, t=_table: clustering.cluster_aspects(d.lab, clusters=t)
      .groupBy("aspect", "aspect_cluster").agg(F.count("*").alias("count")))
    query(
        f"""SELECT {_case} AS aspect_cluster, count(*) AS count,
        CAST(row_number() OVER (ORDER BY count(*) DESC, {_case}) AS INT) AS rank FROM lab GROUP BY 1 ORDER BY rank LIMIT 10""",
        f"top_clusters{_name}",
    )(lambda d, t=_table: clustering.top_clusters(d.lab, 10, clusters=t))

_FOLDED = {name: [w.lower() for w in words] for name, words in defaults.CLUSTERS.items()}


@query(f"SELECT aspect, {cluster_case('aspect', _FOLDED)} AS aspect_cluster, count(*) AS count FROM lab GROUP BY ALL")
def clustered_rows_casefold(d: Derived) -> DataFrame:
    rows = clustering.cluster_aspects(d.lab, casefold_keywords=True)
    return rows.groupBy("aspect", "aspect_cluster").agg(F.count("*").alias("count"))


_CLUSTER = cluster_case("aspect", defaults.CLUSTERS)


@query(f"SELECT aspect, {_CLUSTER} AS aspect_cluster, count(*) AS count FROM lab WHERE aspect IS NOT NULL GROUP BY ALL")
def aspect_cluster_mapping(d: Derived) -> DataFrame:
    return clustering.aspect_cluster_mapping(d.lab)


@query(f"SELECT DISTINCT aspect, {_CLUSTER} AS aspect_cluster FROM lab WHERE aspect IS NOT NULL")
def mapping_audit(d: Derived) -> DataFrame:
    return clustering.aspect_cluster_mapping(d.lab, distinct=True)


@query(f"""SELECT aspect, count(*) AS count, aspect || ' (' || count(*) || ')' AS line
FROM lab WHERE aspect IS NOT NULL AND {_CLUSTER} = 'Unclustered' GROUP BY aspect""")
def unclustered_report(d: Derived) -> DataFrame:
    return clustering.unclustered_report(d.lab)


@query(f"""SELECT count(*) AS total, count(*) FILTER (c <> 'Unclustered') AS clustered,
count(*) FILTER (c = 'Unclustered') AS unclustered,
round(count(*) FILTER (c <> 'Unclustered') * 100 / count(*), 6) AS coverage FROM (SELECT {_CLUSTER} AS c FROM lab) AS x""")
def cluster_coverage(d: Derived) -> DataFrame:
    return clustering.cluster_coverage(d.lab).withColumn("coverage", six("coverage"))


# --- flows and balance -------------------------------------------------------------

@query("SELECT a AS aspect_category_norm, s AS sentiment_norm, t AS tone_norm, n AS count FROM flow")
def flow_counts(d: Derived) -> DataFrame:
    return flows.flow_counts(d.labelled)


_LAYERS = """(SELECT 0 AS layer_no, 'Aspect' AS layer, a AS name, CAST(sum(n) AS BIGINT) AS total FROM flow GROUP BY ALL
UNION ALL SELECT 1, 'Sentiment', s, CAST(sum(n) AS BIGINT) FROM flow GROUP BY ALL
UNION ALL SELECT 2, 'Tone', t, CAST(sum(n) AS BIGINT) FROM flow GROUP BY ALL)"""


@query(f"""SELECT layer_no, layer, name, total,
CAST(row_number() OVER (PARTITION BY layer ORDER BY total DESC, name) AS INT) AS rank FROM {_LAYERS} AS x""")
def flow_marginals(d: Derived) -> DataFrame:
    return flows.flow_marginals(flows.flow_counts(d.labelled))


_BY_LAYER = " ".join(
    f"WHEN '{layer}' THEN '{layer}: ' || {label_case('name', o)}"
    for layer, o in zip(flows.LAYERS, (ASPECTS, SENTIMENTS, TONES))
)
_NODES = f"""(SELECT row_number() OVER (ORDER BY layer_no, total DESC, name) - 1 AS node_id, layer, name,
CASE layer {_BY_LAYER} END AS label FROM {_LAYERS} AS x)"""
_LINKS = """SELECT a.node_id AS source, b.node_id AS target, n AS value FROM {f} JOIN {n} AS a ON a.layer = 'Aspect' AND a.name = {a}
JOIN {n} AS b ON b.layer = 'Sentiment' AND b.name = {s}
UNION ALL SELECT a.node_id, b.node_id, n FROM {f} JOIN {n} AS a ON a.layer = 'Sentiment' AND a.name = {s}
JOIN {n} AS b ON b.layer = 'Tone' AND b.name = {t}"""


@query(f"SELECT * FROM {_NODES} AS x")
def flow_graph_nodes(d: Derived) -> DataFrame:
    return flows.flow_graph(flows.flow_counts(d.labelled)).nodes


@query(_LINKS.format(f="flow", n=_NODES, a="a", s="s", t="t"))
def flow_graph_links(d: Derived) -> DataFrame:
    return flows.flow_graph(flows.flow_counts(d.labelled)).links


_MIN_FLOW = """(SELECT aspect_category AS a, sentiment AS s, minimum_tone AS t, minimum_amount AS n,
row_number() OVER (ORDER BY aspect_category, sentiment) AS i FROM tones)"""
_MIN_NODES = f"""(SELECT row_number() OVER (ORDER BY place) - 1 AS node_id, layer, name, layer || ': ' || name AS label FROM (
SELECT layer, name, min(place) AS place FROM (SELECT 'Aspect' AS layer, a AS name, i * 3 AS place FROM {_MIN_FLOW} AS f
UNION ALL SELECT 'Sentiment', s, i * 3 + 1 FROM {_MIN_FLOW} AS f UNION ALL SELECT 'Tone', t, i * 3 + 2 FROM {_MIN_FLOW} AS f
) AS y GROUP BY ALL) AS z)"""


def _minimum_graph(d: Derived) -> flows.FlowGraph:
    table = balance.minimum_tone_distribution(d.labelled)
    keys = ("aspect_category", "sentiment", "minimum_tone")
    return flows.flow_graph(balance.minimum_tone_flow(table), keys, order="first_seen", ontologies=None)


@query(f"SELECT * FROM {_MIN_NODES} AS x")
def minimum_tone_graph_nodes(d: Derived) -> DataFrame:
    return _minimum_graph(d).nodes


@query(_LINKS.format(f=_MIN_FLOW + " AS fl", n=_MIN_NODES, a="a", s="s", t="t"))
def minimum_tone_graph_links(d: Derived) -> DataFrame:
    return _minimum_graph(d).links


@query("SELECT * FROM tones")
def minimum_tone(d: Derived) -> DataFrame:
    return balance.minimum_tone_distribution(d.labelled)


@query("""SELECT tones.*, descending_order, data_distribution FROM tones JOIN (
SELECT a, s, string_agg(t, ', ' ORDER BY n DESC, t) AS descending_order,
string_agg(CAST(n AS VARCHAR), ', ' ORDER BY n DESC, t) AS data_distribution FROM flow GROUP BY ALL) AS r
ON aspect_category = a AND sentiment = s""")
def minimum_tone_ranking(d: Derived) -> DataFrame:
    return balance.minimum_tone_distribution(d.labelled, with_ranking=True)


@query("SELECT minimum_tone, CAST(sum(minimum_amount) AS BIGINT) AS minimum_amount FROM tones GROUP BY 1")
def combined_minimum_tone(d: Derived) -> DataFrame:
    return balance.combined_minimum_tone(balance.minimum_tone_distribution(d.labelled))


@query("""SELECT aspect_category, sentiment, minimum_tone, CAST(sum(minimum_amount) AS BIGINT) AS count
FROM tones GROUP BY ALL""")
def minimum_tone_flow(d: Derived) -> DataFrame:
    return balance.minimum_tone_flow(balance.minimum_tone_distribution(d.labelled))


@query("SELECT aspect_category, " + ", ".join(
    f"CAST(coalesce(sum(minimum_amount) FILTER (sentiment = '{c}'), 0) AS BIGINT) AS \"{c}\"" for c in SENTIMENTS.order)
    + " FROM tones GROUP BY 1")
def minimum_tone_matrix(d: Derived) -> DataFrame:
    return balance.minimum_tone_matrix(balance.minimum_tone_distribution(d.labelled), SENTIMENTS.order)


def md5_draw(*parts: Column) -> Column:
    """A draw any database can repeat: the leading 60 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.col(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


_SAMPLE = 150
_DRAW = "CAST('0x' || substr(md5(concat_ws('|', {})), 1, 15) AS BIGINT)"


@query(f"""SELECT r.row_id, r.aspect_category, r.sentiment, r.tone, r.aspect_category_norm, r.sentiment_norm, r.tone_norm,
ta AS target_aspect, ts AS target_sentiment, tt AS target_tone
FROM (SELECT *, CASE WHEN n >= {_SAMPLE} THEN k ELSE {_DRAW.format("42, ta, ts, tt, k")} % n + 1 END AS pick
      FROM (SELECT a AS ta, s AS ts, t AS tt, n, unnest(range(1, {_SAMPLE + 1})) AS k FROM (
            SELECT *, row_number() OVER (PARTITION BY a, s ORDER BY n, t) AS r FROM (
            SELECT aspect_category_norm AS a, sentiment_norm AS s, tone_norm AS t, count(*) AS n FROM nord GROUP BY ALL) AS c
            ) AS x WHERE r = 1) AS y) AS draws
JOIN (SELECT *, row_number() OVER (PARTITION BY aspect_category_norm, sentiment_norm, tone_norm
             ORDER BY {_DRAW.format("42, row_id")} >> 1, row_id) AS k FROM nord) AS r
ON r.aspect_category_norm = ta AND r.sentiment_norm = ts AND r.tone_norm = tt AND r.k = pick""")
def balanced_sample(d: Derived) -> DataFrame:
    targets = balance.minimum_tone_distribution(d.ordlabelled)
    return balance.balanced_sample(d.ordlabelled, targets, _SAMPLE, draw=md5_draw)


RULES = [
    rules.Rule(take_n=40),
    rules.Rule("E", "NEGATIVE", take_n=25),
    rules.Rule(tone="OUTCOME", take_n=1_000_000),
    rules.Rule("E-S-G", "POSITIVE", "ACTION", 5),
]
_RULES = "(VALUES " + ", ".join(
    f"({i + 1}, {', '.join(map(quoted, r[:3]))}, {r.take_n})" for i, r in enumerate(RULES)
) + ") AS r(rule_id, aspect, sentiment, tone, asked)"
_RULE_TEST = """(r.aspect = '(Any)' OR r.aspect = d.aspect_category_norm)
AND (r.sentiment = '(Any)' OR r.sentiment = d.sentiment_norm) AND (r.tone = '(Any)' OR r.tone = d.tone_norm)"""


@query(f"""SELECT rule_id, r.aspect, r.sentiment, r.tone, count(d.row_id) AS count,
CAST(least(asked, greatest(1, count(d.row_id))) AS BIGINT) AS take_n
FROM {_RULES} LEFT JOIN nord d ON {_RULE_TEST} GROUP BY rule_id, r.aspect, r.sentiment, r.tone, asked""")
def rule_summary(d: Derived) -> DataFrame:
    return rules.rule_summary(d.ordlabelled, RULES)


@query(f"""SELECT rule_id, match_no, row_id, aspect_category_norm, sentiment_norm, tone_norm FROM (
SELECT rule_id, asked, row_id, aspect_category_norm, sentiment_norm, tone_norm,
row_number() OVER (PARTITION BY rule_id ORDER BY row_id) AS match_no FROM {_RULES} JOIN nord d ON {_RULE_TEST}) AS x
WHERE match_no <= asked""")
def rule_matches(d: Derived) -> DataFrame:
    return rules.match_rules(d.ordlabelled, RULES).drop("aspect_category", "sentiment", "tone")


# --- evaluation --------------------------------------------------------------------

@query("""SELECT doc_id, source AS filename, doc_id AS page_number, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents e JOIN labels USING (doc_id) WHERE e.source IS NOT DISTINCT FROM d.source
AND e.doc_id IS NOT DISTINCT FROM d.doc_id)""")
def missing_pages(d: Derived) -> DataFrame:
    """Documents for which there is no label."""
    output = d.table("documents").selectExpr("doc_id", "source AS filename", "doc_id AS page_number", "n_chars")
    return evaluation.find_missing(output, output.join(d.table("labels"), "doc_id"))


@query("SELECT * FROM aligned")
def aligned_sentences(d: Derived) -> DataFrame:
    return evaluation.align_by_sentence(d.gt, d.pred)


@query("""SELECT (SELECT count(*) FROM aligned) AS aligned, (SELECT count(*) FROM gt) AS gt_rows,
(SELECT count(*) FROM pred) AS pred_rows,
round((SELECT count(*) FROM aligned) * 100 / (SELECT count(*) FROM gt), 6) AS coverage_gt,
round((SELECT count(*) FROM aligned) * 100 / (SELECT count(*) FROM pred), 6) AS coverage_pred""")
def alignment_coverage(d: Derived) -> DataFrame:
    found = evaluation.alignment_coverage(d.gt, d.pred)
    return found.select("aligned", "gt_rows", "pred_rows", six("coverage_gt"), six("coverage_pred"))


for _target in evaluation.TARGETS:
    query(
        f"""SELECT sentence, {_target}_gt AS actual, {_target}_pred AS predicted FROM aligned
        WHERE NOT coalesce({_target}_gt = {_target}_pred, FALSE)""",
        f"error_rows_{_target}",
    )(lambda d, t=_target: evaluation.error_rows(evaluation.align_by_sentence(d.gt, d.pred), t))


@query("""SELECT confidence_pred, NOT coalesce(sentiment_gt = sentiment_pred, FALSE) AS is_error FROM aligned""")
def confidence_errors(d: Derived) -> DataFrame:
    return evaluation.confidence_errors(evaluation.align_by_sentence(d.gt, d.pred), "sentiment")


_VALID = "lower(trim({})) NOT IN ('nan', 'none', '', 'null')"


@query(f"""SELECT trim(tone_gt) AS y_true, trim(tone_pred) AS y_pred FROM aligned
WHERE {_VALID.format("tone_gt")} AND {_VALID.format("tone_pred")}""")
def clean_label_pairs(d: Derived) -> DataFrame:
    return evaluation.clean_label_pairs(evaluation.align_by_sentence(d.gt, d.pred), "tone_gt", "tone_pred")


def _metrics_sql(average: str) -> str:
    pairs = " UNION ALL ".join(
        f"""SELECT '{t}' AS target, trim({t}_gt) AS y, trim({t}_pred) AS p, coalesce({_VALID.format(t + "_gt")}
        AND {_VALID.format(t + "_pred")}, FALSE) AS ok FROM aligned""" for t in evaluation.TARGETS)
    weigh = {"weighted": "sum({} * n_true) / sum(n_true)", "macro": "avg({})", "micro": "sum(tp) / sum(n_true)"}[average]
    p, r, f = (weigh.format(x) for x in (
        "CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END", "CASE WHEN n_true > 0 THEN tp / n_true ELSE 0 END",
        "2 * tp / (n_true + n_pred)"))
    return f"""SELECT m.*, dropped_rows FROM (
    SELECT target, round(sum(tp) / sum(n_true), 6) AS accuracy, round({p}, 6) AS precision, round({r}, 6) AS recall,
           round({f}, 6) AS f1
    FROM (SELECT target, label, count(*) FILTER (kind = 't') AS n_true, count(*) FILTER (kind = 'p') AS n_pred,
                 count(*) FILTER (kind = 't' AND y = p) AS tp
          FROM (SELECT target, y AS label, 't' AS kind, y, p FROM ({pairs}) AS a WHERE ok
                UNION ALL SELECT target, p, 'p', y, p FROM ({pairs}) AS b WHERE ok) AS c GROUP BY ALL) AS d
    GROUP BY target) AS m JOIN (SELECT target, count(*) FILTER (NOT ok) AS dropped_rows FROM ({pairs}) AS e GROUP BY 1) AS n
    USING (target)"""


for _average in ("weighted", "macro", "micro"):
    query(_metrics_sql(_average), f"metrics_{_average}")(
        lambda d, a=_average: evaluation.classification_metrics(
            evaluation.align_by_sentence(d.gt, d.pred), average=a
        ).select("target", six("accuracy"), six("precision"), six("recall"), six("f1"), "dropped_rows")
    )


# --- scoring -----------------------------------------------------------------------
# A small word-count scorer stands in for a model; real ones are supplied the same way.

_WORDS = {"sentiment": ["en", "the", "un", "der"], "tone": ["on", "la", "is"]}


def lexicon_scorer():
    def score(texts: list[str]) -> tuple[list[list[float]], list[list[float]]]:
        series = pd.Series(texts)
        heads = [
            (pd.concat([series.str.count(w) for w in words], axis=1) / 8.0).to_numpy().tolist()
            for words in _WORDS.values()
        ]
        return heads[0], heads[1]

    return score


def _logit(word: str) -> str:
    return f"((length(text) - length(replace(text, '{word}', ''))) / {len(word)} / 8.0)"


def _head_sql(head: str, classes: list[str]) -> str:
    logits = [_logit(w) for w in _WORDS[head]]
    top = f"greatest({', '.join(logits)})"
    total = " + ".join(f"exp({x} - {top})" for x in logits)
    best = " ".join(f"WHEN {x} = {top} THEN '{c}'" for x, c in zip(logits, classes))
    scores = ", ".join(f"round(exp({x} - {top}) / ({total}), 6) AS {head}_{i}" for i, x in enumerate(logits))
    return f"CASE {best} END AS {head}, {scores}"


@query(f"""SELECT doc_id, {_head_sql("sentiment", defaults.SENTIMENT_CLASSES)}, {_head_sql("tone", defaults.TONE_CLASSES)}
FROM documents""")
def scored_texts(d: Derived) -> DataFrame:
    texts = d.documents.select("doc_id", "text")
    scored = scoring.score_texts(texts, lexicon_scorer)
    cells = [
        F.round(F.get(f"{head}_scores", i), 6).alias(f"{head}_{i}")
        for head, words in _WORDS.items()
        for i in range(len(words))
    ]
    return scored.select("doc_id", "sentiment", "tone", *cells)


def load_classifier(model_id: str):
    """``count/<word>/<word>`` scores each word by its frequency per character; others fail to load."""
    kind, *words = model_id.split("/")
    if kind != "count":
        raise ValueError(f"no such model: {model_id}")

    def classify(texts: list[str]) -> list[list[tuple[str, float]]]:
        if any(not t.strip() for t in texts):
            raise ValueError("empty text")
        return [[(w, t.count(w) / len(t)) for w in words] for t in texts]

    return classify


CLASSIFIERS = [("small", "count/en/the"), ("large", "count/on/la/is"), ("broken", "absent/model")]


def _scored_sql() -> str:
    parts = []
    for name, model_id in CLASSIFIERS:
        kind, *words = model_id.split("/")
        head = f"SELECT doc_id, '{name}' AS model_name, '{model_id}' AS model_id"
        if kind != "count":
            parts.append(f"{head}, 'LOAD_ERROR' AS label, CAST(NULL AS DOUBLE) AS score, "
                         f"'no such model: {model_id}' AS error FROM documents")
        parts += [
            f"""{head}, '{w}' AS label, round(CAST((length(text) - length(replace(text, '{w}', ''))) / {len(w)}
            / length(text) AS DOUBLE), 6) AS score, CAST(NULL AS VARCHAR) AS error FROM documents"""
            for w in words if kind == "count"
        ]
    return " UNION ALL ".join(parts)


def _model_scores(d: Derived) -> DataFrame:
    texts = d.documents.select("doc_id", "text")
    scores = scoring.score_models(texts, CLASSIFIERS, load_classifier).drop("text")
    return scores.withColumn("score", six("score"))


@query(_scored_sql())
def model_scores(d: Derived) -> DataFrame:
    return _model_scores(d)


@query(f"""SELECT doc_id, model_name, model_id, label, score, error FROM (SELECT *, row_number() OVER (
PARTITION BY doc_id, model_id ORDER BY score DESC, label) AS r FROM ({_scored_sql()}) AS s WHERE score IS NOT NULL) AS x
WHERE r = 1""")
def top_predictions(d: Derived) -> DataFrame:
    return scoring.top_prediction_per_model(_model_scores(d), ("doc_id", "model_id"))
