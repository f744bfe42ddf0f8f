"""Aspect -> sentiment -> tone flow tables and graphs.

Everything here works on the aggregated flow table. Nodes of a graph are numbered by range, so labels
may be raw ones without a bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelscope.functions.text import present
from labelscope.operators.ranking import global_number
from labelscope.sources.ontologies import ASPECTS, SENTIMENTS, TONES, Ontology

LABELS = ("aspect_category_norm", "sentiment_norm", "tone_norm")
LAYERS = ("Aspect", "Sentiment", "Tone")


class FlowGraph(NamedTuple):
    """``nodes(node_id, layer, name, label)`` and ``links(source, target, value)``."""

    nodes: DataFrame
    links: DataFrame


def flow_counts(df: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Rows per (aspect, sentiment, tone)."""
    return df.filter(present(*labels)).groupBy(*labels).agg(F.count("*").alias("count"))


def flow_marginals(flow: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Totals of each code within its layer with the rank in the layer, from one pass over the flow."""
    entries = F.inline(
        F.array(
            *[
                F.struct(F.lit(i).alias("layer_no"), F.lit(name).alias("layer"), F.col(c).alias("name"), "count")
                for i, (c, name) in enumerate(zip(labels, LAYERS))
            ]
        )
    )
    totals = flow.select(entries).groupBy("layer_no", "layer", "name").agg(F.sum("count").alias("total"))
    place = Window.partitionBy("layer").orderBy(F.desc("total"), "name")
    return totals.withColumn("rank", F.row_number().over(place))


def _codes(flow: DataFrame, labels: Sequence[str], value: Column) -> DataFrame:
    """``_layer, _name, _value``: the three codes of each flow row with a value of the row."""
    codes = [F.struct(F.lit(i).alias("_layer"), F.col(c).cast("string").alias("_name")) for i, c in enumerate(labels)]
    return flow.select(value.alias("_value"), F.inline(F.array(*codes)))


def _nodes_by_total(flow: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``_layer, _name, _id``: layers in turn, codes by falling total, then name."""
    totals = _codes(flow, labels, F.col("count")).groupBy("_layer", "_name").agg(F.sum("_value").alias("_total"))
    return global_number(totals, [F.col("_layer"), F.desc("_total"), F.col("_name")], "_id")


def _nodes_by_first_seen(flow: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``_layer, _name, _id``: by first appearance in the sorted table, where the codes of a row are its place."""
    seen = _codes(flow, labels, F.struct(*labels)).groupBy("_layer", "_name").agg(F.min("_value").alias("_first"))
    return global_number(seen, [F.col("_first"), F.col("_layer")], "_id")


def flow_graph(
    flow: DataFrame,
    labels: Sequence[str] = LABELS,
    value: str = "count",
    order: str = "total",
    ontologies: Sequence[Ontology] | None = (ASPECTS, SENTIMENTS, TONES),
) -> FlowGraph:
    """Nodes and links of a flow table.

    ``order="total"`` numbers the nodes layer by layer by falling total,
    ``order="first_seen"`` in the order a row-wise reading of the sorted table
    meets them. Every flow row gives two links, aspect to sentiment and sentiment to
    tone; equal pairs are not merged. Node labels show the ontology label, or the
    code if ``ontologies`` is None.
    """
    flow = flow.select(*labels, F.col(value).alias("count")).filter("count > 0")
    numbered = (_nodes_by_total if order == "total" else _nodes_by_first_seen)(flow, labels)
    placed = flow
    for i, c in enumerate(labels):
        own = numbered.filter(F.col("_layer") == i).select("_name", F.col("_id").alias(f"_id_{i}"))
        placed = placed.join(own, placed[c].cast("string").eqNullSafe(own["_name"])).drop("_name")

    def shown(i: int, code: Column) -> Column:
        return code if ontologies is None else ontologies[i].label_of(code)

    layer, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, name in enumerate(LAYERS):
        own = F.col("_layer") == i
        layer = F.when(own, F.lit(name)).otherwise(layer)
        label = F.when(own, F.concat(F.lit(f"{name}: "), shown(i, F.col("_name")))).otherwise(label)
    link = [
        F.struct(
            F.col(f"_id_{i}").cast("long").alias("source"),
            F.col(f"_id_{i + 1}").cast("long").alias("target"),
            F.col("count").alias("value"),
        )
        for i in range(2)
    ]
    return FlowGraph(
        nodes=numbered.select(
            F.col("_id").cast("long").alias("node_id"), layer.alias("layer"), F.col("_name").alias("name"), label.alias("label")
        ),
        links=placed.select(F.inline(F.array(*link))),
    )
