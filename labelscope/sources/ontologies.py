"""Label ontologies and keyword-cluster tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelscope import defaults
from labelscope.defaults import OTHER, WHITE_SPACE
from labelscope.functions.text import fold
from labelscope.sources.local import local_table


@dataclass(frozen=True)
class Ontology:
    """Canonical codes with their labels and a map from folded alias to code."""

    labels: dict[str, str]
    aliases: dict[str, str] = field(repr=False)

    @classmethod
    def of(cls, entries: dict[str, tuple[str, list[str | None]]]) -> Ontology:
        pairs = ((a, code) for code, (_, names) in entries.items() for a in names if a is not None)
        return cls(
            labels={code: label for code, (label, _) in entries.items()},
            aliases={str(a).strip(WHITE_SPACE).lower(): code for a, code in pairs},
        )

    @property
    def order(self) -> list[str]:
        return list(self.labels)

    def code_of(self, value: Column) -> Column:
        """Code of a free-text label; unknown and missing labels give ``OTHER``.

        Most labels are aliases up to their case; only the others are also trimmed,
        which costs more than the rest. An alias has no blanks to trim, so a hit stands.
        """
        codes = _literal_map(self.aliases)
        as_is = F.try_element_at(codes, F.lower(value.cast("string")))
        return F.coalesce(as_is, F.try_element_at(codes, fold(value)), F.lit(OTHER))

    def label_of(self, code: Column, default: Column | None = None) -> Column:
        """Label of a code, by default the code itself where there is none."""
        found = F.try_element_at(_literal_map(self.labels), code)
        return F.coalesce(found, code if default is None else default)


ASPECTS = Ontology.of(defaults.ASPECT_ONTOLOGY)
SENTIMENTS = Ontology.of(defaults.SENTIMENT_ONTOLOGY)
TONES = Ontology.of(defaults.TONE_ONTOLOGY)


def _literal_map(entries: dict[str, str]) -> Column:
    """A map literal: the document is folded into one when the plan is made."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def alias_dim(spark: SparkSession, ontology: Ontology) -> DataFrame:
    """The ontology as a dimension table, for joins and for display."""
    rows = [
        (alias, code, ontology.labels[code], ontology.order.index(code))
        for alias, code in ontology.aliases.items()
    ]
    return local_table(spark, rows, "alias_key string, canonical string, label string, ord int")


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as a row with the column ``d``."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))


def ontology_table(spark: SparkSession, path: str) -> DataFrame:
    """An ontology document as a dimension table (see ``alias_dim``), for joins; it never reaches the driver.

    ``{code: {"label": ..., "aliases": [...]}}``; on a repeated alias the later code wins.
    """
    codes = _document(spark, path, "map<string, struct<label: string, aliases: array<string>>>").select(
        F.posexplode("d").alias("ord", "canonical", "entry")
    )
    code = F.struct("ord", "canonical", F.coalesce("entry.label", "canonical").alias("label")).alias("code")
    aliases = codes.select(F.explode("entry.aliases").alias("alias"), code).withColumn("alias_key", fold(F.col("alias")))
    last = aliases.filter(F.col("alias_key").isNotNull()).groupBy("alias_key").agg(F.max("code").alias("code"))
    return last.select("alias_key", "code.canonical", "code.label", "code.ord")


def _read_document(spark: SparkSession, path: str) -> dict:
    """A JSON document in the driver: for tables that become part of the plan."""
    found = spark.read.text(path, wholetext=True).take(2)
    if len(found) != 1:
        raise ValueError(f"{path}: expected one JSON document")
    return json.loads(found[0].value)


def load_ontology(spark: SparkSession, path: str) -> Ontology:
    """An ontology document as a literal of the plan; for large ones see ``ontology_table``."""
    document = _read_document(spark, path)
    return Ontology.of(
        {code: (meta.get("label", code), meta.get("aliases", [])) for code, meta in document.items()}
    )


def load_clusters(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """``{cluster: [keyword, ...]}``; the order of the document is the priority."""
    return {cluster: list(words) for cluster, words in _read_document(spark, path).items()}
