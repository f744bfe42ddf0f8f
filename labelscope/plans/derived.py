"""Annotation-shaped tables derived from the given parquet tables.

The SQL texts are read by Spark and by the checking database alike; ``$name``
stands for a table. Derived rows are row-wise expressions of the given rows, or
key joins of them: no global window, no gathering, so they grow with the tables.
"""

from __future__ import annotations

import zlib
from functools import cached_property
from string import Template

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelscope.operators.labels import normalize_labels
from labelscope.operators.parsing import parse_annotations, with_provider
from labelscope.session import configure

# Flat labels, one row per line item.
LAB = """
SELECT concat('doc_', CAST(l_suppkey % 20 AS STRING), '.pdf') AS filename,
       l_partkey % 50 AS page_number,
       CASE l_linenumber % 3 WHEN 0 THEN 'alpha/m1' WHEN 1 THEN 'alpha/m2' ELSE 'beta' END AS model,
       p_name AS sentence,
       CASE p_brand WHEN 'Brand#1' THEN NULL WHEN 'Brand#2' THEN concat('Board ', p_name)
            WHEN 'Brand#3' THEN concat(p_name, ' TAX') WHEN 'Brand#4' THEN concat(p_name, ' quality')
            WHEN 'Brand#5' THEN concat(p_name, ' ghg') ELSE p_name END AS aspect,
       CASE p_type WHEN 'STANDARD' THEN 'ENV' WHEN 'ECONOMY' THEN 'ECONOMIC' WHEN 'MEDIUM' THEN 'Soc'
                   WHEN 'SMALL' THEN ' governance ' WHEN 'LARGE' THEN 'E/S' ELSE NULL END AS aspect_category,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'negative' WHEN '2-HIGH' THEN 'NEG' WHEN '3-MEDIUM' THEN 'none'
                   WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Positif' END AS sentiment,
       CASE WHEN l_returnflag = 'A' THEN 'initiative' WHEN l_returnflag = 'N' THEN 'Pledge'
            WHEN l_linestatus = 'O' THEN 'result' ELSE 'neutral' END AS tone,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) / 8 END AS confidence,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE concat('uri/', CAST(l_partkey % 40 AS STRING)) END AS ontology_uri
FROM $lineitem JOIN $part ON l_partkey = p_partkey JOIN $orders ON l_orderkey = o_orderkey
"""

# Flat labels with a unique row id, one row per order.
ORDLAB = """
SELECT o_orderkey AS row_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Env' WHEN '2-HIGH' THEN ' soc' WHEN '3-MEDIUM' THEN 'GOV'
                   WHEN '4-NOT SPECIFIED' THEN 'S-E' ELSE NULL END AS aspect_category,
       CASE o_orderstatus WHEN 'F' THEN 'bad' WHEN 'O' THEN 'none' ELSE 'Good ' END AS sentiment,
       CASE o_custkey % 7 WHEN 0 THEN 'commit' WHEN 1 THEN 'impact' WHEN 2 THEN 'IMPACT' WHEN 3 THEN 'zzz'
                   ELSE 'action' END AS tone
FROM $orders
"""

# Raw model answers, one row per order; the forms vary by order key.
RAW = """
SELECT row_id, filename, page_number, model,
       CASE form
         WHEN 0 THEN concat('Sure:', chr(10), '```json', chr(10), '[', a1, ', ', a2, ']', chr(10), '```')
         WHEN 1 THEN a1
         WHEN 2 THEN concat('[[', a1, '], [7, [', a2, ']], "x"] ')
         WHEN 3 THEN concat('Sure [see below]: [', a1, ']')
         WHEN 4 THEN '[{"sentence": "no aspect here"}]'
         WHEN 5 THEN 'none'
         WHEN 6 THEN concat('{"sentence": "replaced", ', substr(a1, 2))
         WHEN 7 THEN CASE WHEN o_custkey % 3 = 0 THEN a3 ELSE concat(a1, ' y ', a2) END
         END AS text
FROM (
  SELECT o_orderkey AS row_id, o_custkey, o_orderkey % 8 AS form,
         concat('doc_', CAST(o_custkey % 20 AS STRING), '.pdf') AS filename,
         o_orderkey % 50 AS page_number,
         CASE o_orderkey % 3 WHEN 0 THEN 'alpha/m1' WHEN 1 THEN 'alpha/m2' ELSE 'beta' END AS model,
         concat('{"sentence": "order ', CAST(o_orderkey % 97 AS STRING), ' is ', o_orderpriority,
                '", "aspect": "', CASE o_orderpriority WHEN '1-URGENT' THEN 'Board diversity'
                   WHEN '2-HIGH' THEN 'water [recycling]' ELSE 'other matters' END,
                '", "aspect_category": "', CASE o_orderpriority WHEN '1-URGENT' THEN 'ENV' WHEN '2-HIGH' THEN ' soc '
                   WHEN '3-MEDIUM' THEN 'GOV' WHEN '4-NOT SPECIFIED' THEN 'E/S' ELSE '??' END,
                '", "sentiment": ', CASE o_orderstatus WHEN 'F' THEN '"negative"' WHEN 'O' THEN '"POS"' ELSE 'null' END,
                ', "tone": "', CASE o_custkey % 5 WHEN 0 THEN 'initiative' WHEN 1 THEN 'Pledge' WHEN 2 THEN 'result'
                   WHEN 3 THEN 'neutral' ELSE 'zzz' END,
                '", "confidence": ', CAST(CAST(o_orderkey % 8 AS DOUBLE) / 8 AS STRING), ', "meta": {"k": 3}}') AS a1,
         concat('{"sentence": "status ', o_orderstatus, ' of ', CAST(o_custkey % 31 AS STRING),
                '", "aspect": null, "aspect_category": "G", "sentiment": "good", "tone": "impact"}') AS a2,
         concat('{"sentence": "mistyped", "aspect": "x", "sentiment": {"label": "', o_orderstatus,
                '"}, "confidence": "high", "tone": "zzz", "meta": {"k": 3}}') AS a3
  FROM $orders
) AS parts
"""

# What the answers of RAW hold, straight from the orders.
PARSED = """
SELECT row_id, filename, page_number, model, pos, mistyped, o_orderstatus,
       CASE WHEN mistyped THEN 'mistyped' WHEN pos = 0 THEN concat('order ', CAST(row_id % 97 AS STRING), ' is ', o_orderpriority)
            WHEN pos = 1 THEN concat('status ', o_orderstatus, ' of ', CAST(o_custkey % 31 AS STRING)) END AS sentence,
       CASE WHEN mistyped THEN 'x' WHEN pos = 0 THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'Board diversity'
                   WHEN '2-HIGH' THEN 'water [recycling]' ELSE 'other matters' END END AS aspect,
       CASE WHEN mistyped THEN NULL WHEN pos = 0 THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'ENV' WHEN '2-HIGH' THEN ' soc '
                   WHEN '3-MEDIUM' THEN 'GOV' WHEN '4-NOT SPECIFIED' THEN 'E/S' ELSE '??' END
            WHEN pos = 1 THEN 'G' END AS aspect_category,
       CASE WHEN mistyped THEN NULL WHEN pos = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'negative' WHEN 'O' THEN 'POS' END
            WHEN pos = 1 THEN 'good' END AS sentiment,
       CASE WHEN mistyped THEN 'zzz' WHEN pos = 0 THEN CASE o_custkey % 5 WHEN 0 THEN 'initiative' WHEN 1 THEN 'Pledge' WHEN 2 THEN 'result'
                   WHEN 3 THEN 'neutral' ELSE 'zzz' END
            WHEN pos = 1 THEN 'impact' END AS tone,
       CASE WHEN pos = 0 AND NOT mistyped THEN CAST(row_id % 8 AS DOUBLE) / 8 END AS confidence
FROM (
  SELECT o.*, o_orderkey % 8 = 7 AND o_custkey % 3 = 0 AS mistyped, o_orderkey AS row_id, concat('doc_', CAST(o_custkey % 20 AS STRING), '.pdf') AS filename,
         o_orderkey % 50 AS page_number,
         CASE o_orderkey % 3 WHEN 0 THEN 'alpha/m1' WHEN 1 THEN 'alpha/m2' ELSE 'beta' END AS model,
         unnest(CASE WHEN o_orderkey % 8 IN (0, 2) THEN [0, 1] WHEN o_orderkey % 8 IN (1, 6)
                     OR (o_orderkey % 8 = 7 AND o_custkey % 3 = 0) THEN [0] ELSE [NULL] END) AS pos
  FROM orders o
) AS x
"""

# Sentences cut from documents: each whole text in pieces of SENTENCE_CHARS, some of them altered. A document is the
# answer of one model; documents of one source with close ids share a page, whose text is
# that of the first, so few pages have all models.
SENTENCE_CHARS = 90
GROUND = f"""
SELECT doc_id AS row_id, k AS pos, source AS filename, CAST(floor(doc_id / 60) AS BIGINT) AS page_number,
       CASE doc_id % 7 WHEN 0 THEN 'alpha/m2' WHEN 1 THEN 'alpha/m2' WHEN 2 THEN 'beta' ELSE 'alpha/m1' END AS model,
       CASE WHEN k % 4 = 2 AND doc_id % 9 = 0 THEN NULL
            WHEN k % 4 = 3 AND doc_id % 2 = 0 THEN concat(substr(text, CAST(k * {SENTENCE_CHARS} + 1 AS INT), {SENTENCE_CHARS}), '#')
            WHEN k % 32 = 7 THEN substr(text, CAST(k * {SENTENCE_CHARS} + 1 AS INT), 6)
            ELSE substr(text, CAST(k * {SENTENCE_CHARS} + 1 AS INT), {SENTENCE_CHARS}) END AS sentence,
       lang AS aspect,
       CASE (doc_id + k) % 4 WHEN 0 THEN 'positive' WHEN 1 THEN NULL WHEN 2 THEN 'negative' ELSE 'neutral' END AS sentiment
FROM $documents_by_k
"""
# The same over documents that are cut into pieces already, where a piece does not cost another walk through its text.
GROUND_OF_PIECES = GROUND.replace(f"CAST(k * {SENTENCE_CHARS} + 1 AS INT)", "1")
DOCS_TEXT = """
SELECT doc_id AS row_id, source AS filename, CAST(floor(doc_id / 60) AS BIGINT) AS page_number,
       text AS markdown_full, lower(text) AS cleaned_markdown
FROM $documents
"""

GT = """
SELECT d.doc_id AS row_id, text AS sentence, lang AS aspect_category,
       CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS sentiment,
       CASE WHEN d.doc_id % 17 = 0 THEN 'none' ELSE source END AS tone,
       CAST(d.doc_id % 10 AS DOUBLE) / 10 AS confidence
FROM $documents d JOIN $labels l ON d.doc_id = l.doc_id
"""
# Predictions for the same documents; the sentence of some is another one, and some come twice.
PRED = """
SELECT d.doc_id + 1000000000 * copy AS row_id, CASE WHEN d.doc_id % 10 = 3 THEN concat(text, ' !') ELSE text END AS sentence,
       CASE WHEN d.doc_id % 11 = 0 THEN ' en ' ELSE lang END AS aspect_category,
       CASE WHEN toxic = 1 OR n_chars % 5 = 0 THEN 'bad' ELSE 'good' END AS sentiment,
       CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE source END AS tone,
       CAST(d.doc_id % 7 AS DOUBLE) / 7 AS confidence
FROM $documents d JOIN $labels l ON d.doc_id = l.doc_id
JOIN (SELECT 0 AS copy UNION ALL SELECT 1 AS copy) AS copies ON copy = 0 OR d.doc_id % 5 = 1
"""


class Derived:
    """The derived tables over one data folder; nothing runs before it is read."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        names = {}
        for name in Template(text).get_identifiers():
            df = frames[name] if name in frames else self.table(name)
            names[name] = f"labelscope_{name}_{zlib.crc32(self.folder.encode())}"
            df.createOrReplaceTempView(names[name])
        return self.spark.sql(Template(text).substitute(names))

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def lab(self) -> DataFrame:
        return self.sql(LAB)

    @cached_property
    def labelled(self) -> DataFrame:
        return normalize_labels(self.lab)

    @cached_property
    def ordlab(self) -> DataFrame:
        return self.sql(ORDLAB)

    @cached_property
    def ordlabelled(self) -> DataFrame:
        return normalize_labels(self.ordlab)

    @cached_property
    def raw(self) -> DataFrame:
        return self.sql(RAW)

    @cached_property
    def sentences(self) -> DataFrame:
        return with_provider(parse_annotations(self.raw)).drop("text")

    @cached_property
    def ground(self) -> DataFrame:
        pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SENTENCE_CHARS}}}"), F.lit(0))
        # never empty; the outer form cuts each text once, as no filter on the array is put ahead of it
        cut = F.posexplode_outer(F.when(F.col("text") != "", pieces).otherwise(F.array("text"))).alias("k", "text")
        return self.sql(GROUND_OF_PIECES, documents_by_k=self.documents.select("doc_id", "source", "lang", cut))

    @cached_property
    def ground_raw(self) -> DataFrame:
        return self.sql(DOCS_TEXT)

    @cached_property
    def gt(self) -> DataFrame:
        return self.sql(GT)

    @cached_property
    def pred(self) -> DataFrame:
        return self.sql(PRED)


def oracle_views() -> dict[str, str]:
    """The same tables for the checking database, by name."""
    plain = ("documents", "labels", "orders", "part", "lineitem")
    names = {n: n for n in plain}
    names["documents_by_k"] = (
        f"(SELECT d.*, CAST(unnest(range((greatest(coalesce(length(text), 0), 1) - 1) // {SENTENCE_CHARS} + 1)) AS INT) AS k "
        "FROM documents d) AS dk"
    )
    texts = {
        "lab": LAB, "ordlab": ORDLAB, "raw": RAW, "parsed": PARSED, "ground": GROUND,
        "ground_raw": DOCS_TEXT, "gt": GT, "pred": PRED,
    }
    return {name: Template(text).substitute(names) for name, text in texts.items()}
