"""Raw model answers -> one row per annotated sentence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from labelscope.defaults import ANNOTATION_FIELDS
from labelscope.functions import annotations as ann
from labelscope.functions.text import provider
from labelscope.session import configure


def _with_objects(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Adds ``_objects``: the annotation objects of the answer, NULL if it holds no JSON.

    The steps are projections of their own, so that the block and its parse are
    computed once although several expressions use them.
    """
    configure(df.sparkSession)
    return (
        df.withColumn("_block", ann.json_block(F.col(text)))
        .withColumn("_values", ann.parse_block(F.col("_block")))
        .withColumn("_objects", ann.flatten_nested(ann.single_value(F.col("_values")), F.col("_block")))
        .withColumn("_objects", ann.with_keys(F.col("_objects"), tuple(keys)))
        .drop("_block", "_values")
    )


def parse_annotations(
    df: DataFrame,
    text: str = "text",
    fields: dict[str, str] = ANNOTATION_FIELDS,
    required: Sequence[str] = ("sentence", "aspect"),
) -> DataFrame:
    """One row per annotation; an answer without any keeps one row with NULL annotation columns.

    Input columns stay, ``pos`` numbers the annotations of an answer, keys outside
    ``fields``, and values that do not fit their field, are kept in the VARIANT ``extras``. A field whose name the input
    already uses gets the prefix ``ann_``. No shuffle: the plan is scan, projection,
    generate, projection, and columns nobody reads are pruned from all of it.
    """
    metadata, annotation = df.columns, F.col("_annotation")
    exploded = (
        _with_objects(df, text, required)
        .select(*metadata, F.posexplode_outer("_objects").alias("pos", "_annotation"))
        .withColumn("_typed", ann.typed(annotation, fields))
    )
    parsed, values = [], {}
    for name, kind in fields.items():
        value = F.col(f"_typed.`{name}`")
        if kind == "string":
            value = ann.scalar_text(annotation, name, value)
        values[name] = value
        parsed.append(value.alias(f"ann_{name}" if name in metadata else name))
    extras = ann.other_fields(annotation, values).alias("extras")
    return exploded.select(*metadata, "pos", *parsed, extras)


def parse_report(df: DataFrame, text: str = "text", required: Sequence[str] = ("sentence", "aspect")) -> DataFrame:
    """Each raw answer with the number of annotations found in it."""
    return (
        _with_objects(df, text, required)
        .withColumn("parsed_objects", F.coalesce(F.size("_objects"), F.lit(0)))
        .drop("_objects")
    )


def extra_keys(sentences: DataFrame) -> DataFrame:
    """Keys outside the known fields, with the number of annotations that carry them.

    A known key counts where its value has another type than its field.
    """
    keys = F.explode(F.map_keys(F.col("extras").try_cast("map<string,variant>")))
    return sentences.select(keys.alias("key")).groupBy("key").agg(F.count("*").alias("count"))


def mistyped_fields(sentences: DataFrame, fields: dict[str, str] = ANNOTATION_FIELDS) -> DataFrame:
    """Values of known fields that did not fit their type, as JSON, with the number of annotations."""
    entries = F.explode(F.col("extras").try_cast("map<string,variant>")).alias("key", "value")
    found = sentences.select(entries).filter(F.col("key").isin(list(fields)))
    return found.groupBy("key", F.to_json("value").alias("value")).agg(F.count("*").alias("count"))


def with_provider(df: DataFrame, model: str = "model") -> DataFrame:
    return df.withColumn("provider", provider(F.col(model)))


def sentence_table(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Those of the wanted columns that the table has, in the wanted order."""
    return df.select([c for c in wanted if c in df.columns])
