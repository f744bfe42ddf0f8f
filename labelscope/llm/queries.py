"""Registered queries of this package: one for each operator, over the whole of its table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelscope.llm.content_dedup import content_dedup
from labelscope.llm.decontaminate import decontaminate
from labelscope.llm.line_dedup import dedup_lines, PASSAGE
from labelscope.llm.mixing import mix_sources
from labelscope.llm.neighbours import nearest
from labelscope.llm.ngram_jaccard import ngram_jaccard
from labelscope.llm.phrases import collocations
from labelscope.llm.quality import score_quality
from labelscope.llm.sanitise import sanitise
from labelscope.llm.secret_scan import find_secrets
from labelscope.llm.spelling import spelling_variants
from labelscope.llm.token_scan import token_counts
from labelscope.llm.toxicity import score_toxicity

#: Vocabulary of a public byte-level tokenizer in rank format, and the id that is free in it for ends of documents.
VOCABULARY = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
SEPARATOR = 50256
# Fixed value: how this vocabulary's texts are cut into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(table(spark, folder, "documents"))


@query
def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard(table(spark, folder, "documents"), shingle=3, percent=90)


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"), size=10)


@query
def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


@query
def op5_content_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return content_dedup(table(spark, folder, "documents"))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_token_counts(spark: SparkSession, folder: str, vocabulary_path: str = VOCABULARY) -> DataFrame:
    vocabulary, pattern = tokenizer(vocabulary_path)
    return token_counts(table(spark, folder, "documents"), vocabulary, pattern, separator=SEPARATOR)


def with_sha256_of_cleaned(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("cleaned", F.lit("")).cast("binary"), 256).alias("cleaned_sha256")
    )


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return with_sha256_of_cleaned(dedup_lines(table(spark, folder, "documents")))


@query
def op9_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return with_sha256_of_cleaned(dedup_lines(table(spark, folder, "documents"), passage=PASSAGE))


@query
def op10_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    return sanitise(table(spark, folder, "documents"))


@query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


@query
def op13_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def tokenizer(path: str = VOCABULARY) -> tuple[bytes, str]:
    """The vocabulary, read once by the driver and sent to the tasks, and the pattern that cuts texts into pieces."""
    with open(path, "rb") as file:
        return file.read(), PATTERN


# --- SQL -----------------------------------------------------------------------

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op5_content_dedup"] = f"""
WITH normalised AS (SELECT doc_id, {LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept, sha256(norm) AS text_sha256
FROM normalised WINDOW same AS (PARTITION BY norm)
"""

SQL["op3_decontaminate"] = f"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT 'b', item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), windows AS (
    SELECT DISTINCT id AS item, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS piece
    FROM words, range(1, greatest(len(w) - 10, 0) + 2) AS places(p) WHERE kind = 'b' AND len(w) > 0
), lengths AS (SELECT DISTINCT n FROM windows
), occurrences AS (
    SELECT id, p, n, array_to_string(w[p:p + n - 1], ' ') AS piece
    FROM words, lengths, range(1, greatest(len(w) - n + 2, 1)) AS places(p) WHERE kind = 'd'
), hits AS (SELECT o.id, o.p, o.n, x.item FROM occurrences o JOIN windows x ON o.n = x.n AND o.piece = x.piece
), covered AS (SELECT id, count(DISTINCT q) AS n_hit FROM hits, range(p, p + n) AS places(q) GROUP BY id
), found AS (
    SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR)) AS items
    FROM hits GROUP BY id
)
SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON w.id = c.id LEFT JOIN found f ON w.id = f.id WHERE w.kind = 'd'
"""

SQL["op9_line_dedup"] = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), windows AS (
    SELECT doc_id, p, l[p:p + 2] AS piece FROM texts, range(1, greatest(len(l) - 1, 1)) AS places(p)
    WHERE regexp_matches(array_to_string(l[p:p + 2], ' '), '[^\x20\x09-\x0D]')
), later AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY piece ORDER BY doc_id, p) > 1
), gone AS (SELECT DISTINCT doc_id, q FROM later, range(p, p + 3) AS places(q)
), kept AS (
    SELECT t.doc_id, q, t.l[q] AS line FROM texts t, range(1, len(t.l) + 1) AS places(q)
    WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = t.doc_id AND g.q = places.q)
), joined AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY q) AS cleaned FROM kept GROUP BY doc_id)
SELECT t.doc_id, len(t.l) AS n_lines, len(t.l) - coalesce(n, 0) AS n_removed, sha256(coalesce(cleaned, '')) AS cleaned_sha256
FROM texts t LEFT JOIN joined j ON t.doc_id = j.doc_id
"""

SQL["op4_mix_sources"] = r"""
WITH rows AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, length(text) AS chars FROM documents
), keyed AS (
    SELECT doc_id, source, size,
           -ln((CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5) / CAST(4503599627370496 AS DOUBLE))
           / greatest(coalesce(1 / (1 + abs(CAST(chars AS DOUBLE) / greatest(size, 1) - 6) / 6), 1.0), 0.000001) AS key
    FROM rows
), sources AS (
    SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM rows GROUP BY source
), levels AS (
    SELECT *, CAST(source_size * 3 AS DOUBLE) AS bound,
           row_number() OVER up AS rank,
           (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(source_size * 3) OVER below AS DOUBLE), 0))
           / (CAST(sum(weight) OVER () AS DOUBLE) - coalesce(CAST(sum(weight) OVER below AS DOUBLE), 0)) AS level
    FROM sources
    WINDOW up AS (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source NULLS LAST),
           below AS (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), final AS (SELECT arg_min(level, rank) AS level FROM levels WHERE bound > level * weight
), targets AS (
    SELECT source, source_size, CASE WHEN f.level IS NULL THEN bound ELSE least(bound, f.level * weight) END AS target
    FROM levels LEFT JOIN final f ON true
), planned AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets
), ranked AS (
    SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
           sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id) AS through
    FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (epochs + CASE WHEN rest > 0 AND through - size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""

SQL["op11_collocations"] = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), totals AS (SELECT lang, sum(len(w)) AS total FROM words GROUP BY lang
), counts AS (
    SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase, count(*) AS n
    FROM words, range(1, 6) AS sizes(k), range(1, len(w) + 1) AS places(p) WHERE p + k - 1 <= len(w)
    GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
    SELECT c.lang, c.phrase, c.n AS a, c.k, i AS cut, l.n AS l, r.n AS r, t.total AS n,
           (1000::HUGEINT * c.n * t.total) // (l.n::HUGEINT * r.n) AS score
    FROM counts c, range(1, c.k) AS places(i) JOIN totals t ON t.lang = c.lang
    JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[:i], ' ')
    JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[i + 1:], ' ')
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), kept AS (
    SELECT * FROM lowest x WHERE NOT EXISTS (
        SELECT 1 FROM counts y WHERE y.lang = x.lang AND y.k > x.k AND y.n >= x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""
