"""Which models annotated what: coverage, completeness, side-by-side comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from labelscope.functions.text import present, provider as provider_of
from labelscope.operators.ranking import order_columns, packed_order

PAGE = ("filename", "page_number")


def model_list(df: DataFrame, model: str = "model", most: int = 1000) -> list[str]:
    """The sorted model names, for use as pivot columns.

    A wide table has a column per model, so the driver must hold their names: with more than
    ``most`` of them this raises, and the long forms are left.
    """
    names = df.filter(F.col(model).isNotNull()).select(model).distinct().limit(most + 1)
    found = sorted(r[0] for r in names.collect())
    if len(found) > most:
        raise ValueError(f"more than {most} models: use the long form")
    return found


def models_per_document(df: DataFrame, key: str = "filename", model: str = "model") -> DataFrame:
    counts = df.filter(F.col(key).isNotNull()).groupBy(key)
    return counts.agg(F.count_distinct(model).alias("unique_model_count")).orderBy(
        F.desc("unique_model_count"), key
    )


def models_per_page(df: DataFrame, page: Sequence[str] = PAGE, model: str = "model") -> DataFrame:
    rows = df.filter(present(*page)).groupBy(*page)
    return rows.agg(F.count_distinct(model).alias("unique_model_count")).orderBy(*page)


def models_per_page_list(df: DataFrame, page: Sequence[str] = PAGE, model: str = "model") -> DataFrame:
    """The models of each page as an array and as one comma-separated text."""
    models = F.sort_array(F.collect_set(model))
    return (
        df.filter(present(*page))
        .groupBy(*page)
        .agg(models.alias("model"))
        .withColumn("models", F.concat_ws(", ", "model"))
    )


def model_page_matrix(
    df: DataFrame,
    models: Sequence[str] | None = None,
    page: Sequence[str] = PAGE,
    model: str = "model",
    values: str = "sentence",
) -> DataFrame:
    """Annotated sentences per page and model: long, or one column per given model.

    The wide form keeps only the models of its list and fills in 0.
    """
    rows = df.filter(present(*page, model))
    if models is None:
        return rows.groupBy(*page, model).agg(F.count(values).alias("count"))
    return rows.groupBy(*page).pivot(model, list(models)).agg(F.count(values)).na.fill(0, list(models))


def model_comparison(
    df: DataFrame,
    models: Sequence[str] | None = None,
    page: Sequence[str] = PAGE,
    value: str = "sentiment",
    provider: str | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """First ``value`` of each model for each sentence of a page.

    Without ``provider`` the first non-null value counts; with one, only its models
    are compared and the first row counts even if its value is NULL. Sentences with
    no value for any model drop out. Long by default, wide with a list of models. The order columns name a row.

    Sentences are compared by 128-bit digests: only these and the number of the first row are aggregated,
    and value and text of the winning rows are fetched by that number.
    """
    at = order_columns(df, order)
    rows = df.filter(present(*page, "sentence", "model"))
    if provider is None:
        rows = rows.filter(F.col(value).isNotNull())
    else:
        rows = rows.filter(provider_of(F.col("model")) == provider)
    digest = F.unhex(F.md5(F.col("sentence").cast("binary"))).alias("_digest")
    narrow = rows.select(*page, digest, "model", packed_order(df, at).alias("_at"))
    winners = narrow.groupBy(*page, "_digest", "model").agg(F.min("_at").alias("_at"))
    found = rows.select(packed_order(df, at).alias("_at"), value, "sentence")
    if models is None:
        picked = winners.join(found, "_at").filter(F.col(value).isNotNull())
        return picked.select(*page, "sentence", "model", value)
    # a list is bounded by the models; the sentence is fetched once, from the first of its rows
    picked = winners.join(found.select("_at", value), "_at").filter(F.col(value).isNotNull())
    lists = picked.groupBy(*page, "_digest").agg(
        F.collect_list(F.struct("model", F.col(value).alias("value"))).alias("_values"), F.min("_at").alias("_at")
    )
    by_model = F.map_from_entries("_values")
    return lists.join(found.select("_at", "sentence"), "_at").select(
        *page, "sentence", *[F.try_element_at(by_model, F.lit(m)).alias(m) for m in models]
    )


def model_completeness(
    df: DataFrame, page: Sequence[str] = PAGE, model: str = "model", by_provider: bool = False
) -> DataFrame:
    """Expected (whole file), present (this page) and missing models of each page, with the score.

    Both sides are reduced to distinct models first, so what is gathered per page
    and per file is a set of model names, however many rows stand behind it.
    """
    file_keys, page_keys = [page[0]], list(page)
    rows = df.filter(present(*page_keys))
    if by_provider:
        rows = rows.withColumn("provider", provider_of(F.col(model)))
        file_keys, page_keys = [*file_keys, "provider"], [*page_keys, "provider"]
    pairs = rows.select(*page_keys, model).distinct()
    expected = pairs.groupBy(*file_keys).agg(F.sort_array(F.collect_set(model)).alias("expected"))
    on_page = pairs.groupBy(*page_keys).agg(F.sort_array(F.collect_set(model)).alias("present"))
    share = F.try_divide(F.size("present"), F.size("expected"))
    return (
        on_page.join(expected, file_keys)
        .withColumn("missing", F.sort_array(F.array_except("expected", "present")))
        .select(
            *page_keys,
            "expected",
            "present",
            "missing",
            F.size("missing").alias("missing_count"),
            F.size("present").alias("present_count"),
            F.size("expected").alias("total"),
            F.coalesce(share, F.lit(1.0)).alias("score"),
        )
    )
