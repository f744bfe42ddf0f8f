"""Free-text labels -> ontology codes and display labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, MapType, VariantType

from labelscope.defaults import OTHER
from labelscope.functions.text import fold, strip
from labelscope.sources.ontologies import ASPECTS, SENTIMENTS, TONES, Ontology

#: Tasks that the rows of one label are dealt to in a join with a dimension table.
SALTS = 32

ONTOLOGIES = {"aspect_category": ASPECTS, "sentiment": SENTIMENTS, "tone": TONES}


def _hashable(kind: DataType) -> bool:
    return not isinstance(kind, (MapType, VariantType))


def normalize_labels(
    df: DataFrame, ontologies: dict[str, Ontology | DataFrame | None] = ONTOLOGIES, keep_raw: bool = False
) -> DataFrame:
    """Adds ``<column>_norm`` for every given column, and ``<column>_raw`` on request.

    ``None`` in place of an ontology means plain clean-up: trimmed and upper-cased.
    An ``Ontology`` is a literal map inside the projection. A dimension table (``alias_dim``,
    ``ontology_table``) is left joined, and Catalyst decides on the broadcast from its size. Where both
    sides are shuffled, a label that a large share of the rows have, known or not, is dealt to ``SALTS`` tasks, for which the dimension
    is repeated, and rows without a label go to all tasks.
    """
    for column, ontology in ontologies.items():
        norm, value = f"{column}_norm", F.col(column)
        if keep_raw:
            df = df.withColumn(f"{column}_raw", value)
        if ontology is None:
            df = df.withColumn(norm, F.upper(strip(value)))
        elif isinstance(ontology, Ontology):
            df = df.withColumn(norm, ontology.code_of(value))
        else:
            spread = F.xxhash64(*[c for c in df.columns if _hashable(df.schema[c].dataType)])
            dim = ontology.select(
                F.col("alias_key").alias("_key"),
                F.col("canonical").alias(norm),
                F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
            )
            # a missing label matches nothing: it gets a salt beyond those of the dimension, one of many
            own = F.when(F.col("_key").isNotNull(), F.pmod(spread, F.lit(SALTS))).otherwise(SALTS + F.pmod(spread, F.lit(1 << 16)))
            df = (
                df.withColumn("_key", fold(value))
                .withColumn("_salt", own.cast("int"))
                .withColumn("_key", F.coalesce("_key", F.lit("")))
                .join(dim, ["_key", "_salt"], "left")
                .drop("_key", "_salt")
                .withColumn(norm, F.coalesce(norm, F.lit(OTHER)))
            )
    return df


def with_labels(
    df: DataFrame, ontologies: dict[str, Ontology] = ONTOLOGIES, default: Column | None = None
) -> DataFrame:
    """Adds ``<column>_label`` beside each ``<column>_norm``."""
    return df.withColumns(
        {f"{c}_label": o.label_of(F.col(f"{c}_norm"), default) for c, o in ontologies.items()}
    )
