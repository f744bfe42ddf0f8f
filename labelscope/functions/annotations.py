"""Column expressions that dig annotations out of a raw model answer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the first greedy [...] or {...} block, across lines.
BLOCK_PATTERN = r"(?s)(\[.*\]|\{.*\})"


def json_block(text: Column) -> Column:
    """The JSON-looking block of an answer, '' if there is none."""
    return F.regexp_extract(text, BLOCK_PATTERN, 1)


def parse_block(block: Column) -> Column:
    """``array<variant>`` with every JSON value of the block, NULL if it is not clean JSON.

    Wrapping the block in brackets makes the parser read it to its end: trailing
    text is then an error, and two values in a row show up as two elements.
    """
    return F.try_parse_json(F.concat(F.lit("["), block, F.lit("]"))).cast("array<variant>")


def single_value(values: Column) -> Column:
    """The parsed block if it is exactly one JSON value, else NULL."""
    return F.when(F.size(values) == 1, values)


def flatten_nested(values: Column, block: Column) -> Column:
    """Open nested lists of any depth.

    One round of the fold opens one level. Nesting cannot be deeper than the block
    has opening brackets, so that many rounds are always enough; once a round finds
    nothing to open, those after it pass the list on without a look.
    """
    rounds = F.greatest(F.lit(1), F.length(block) - F.length(F.replace(block, F.lit("["), F.lit(""))))

    def as_list(v: Column) -> Column:
        return v.try_cast("array<variant>")

    def opened(state: Column) -> Column:
        found = F.transform(state["list"], as_list)
        return F.when(
            F.exists(found, lambda v: v.isNotNull()),
            F.struct(
                F.flatten(F.zip_with(state["list"], found, lambda v, inner: F.coalesce(inner, F.array(v)))).alias("list"),
                F.lit(False).alias("done"),
            ),
        ).otherwise(F.struct(state["list"].alias("list"), F.lit(True).alias("done")))

    start = F.struct(values.alias("list"), values.isNull().alias("done"))
    return F.aggregate(
        F.sequence(F.lit(1), rounds), start, lambda state, _: F.when(state["done"], state).otherwise(opened(state))
    )["list"]


def with_keys(values: Column, keys: tuple[str, ...] = ("sentence", "aspect")) -> Column:
    """Objects that carry all the keys; a JSON null counts as present."""

    def keep(v: Column) -> Column:
        present = [F.try_variant_get(v, f"$.{k}", "variant").isNotNull() for k in keys]
        test = present[0]
        for p in present[1:]:
            test = test & p
        return test

    return F.filter(values, keep)


def typed(annotation: Column, fields: dict[str, str]) -> Column:
    """All named fields in one cast; absent ones, and values of another type, are NULL."""
    return annotation.try_cast("struct<" + ", ".join(f"`{n}`: {kind}" for n, kind in fields.items()) + ">")


def scalar_text(annotation: Column, name: str, value: Column) -> Column:
    """A text field as cast, but NULL where the annotation holds an object instead of a label."""
    nested = value.startswith("{") & F.try_variant_get(
        annotation, f"$['{name}']", "map<string,variant>"
    ).isNotNull()
    return F.when(~F.coalesce(nested, F.lit(False)), value)


def other_fields(annotation: Column, fields: dict[str, Column]) -> Column:
    """Everything the typed ``fields`` do not hold, as a VARIANT object.

    That is every other key, and each known key whose value is not null but came out NULL,
    as it has another type than the field. A known key is looked at only where its field is NULL.
    """
    entries = annotation.try_cast("map<string,variant>")
    others = F.map_filter(entries, lambda key, _: ~key.isin(list(fields)))
    missed = []
    for name, value in fields.items():
        own = F.when(value.isNull(), F.try_variant_get(annotation, f"$['{name}']", "variant"))
        missed.append(F.when(own.isNotNull() & ~F.is_variant_null(own), F.struct(F.lit(name).alias("key"), own.alias("value"))))
    return F.to_variant_object(F.map_concat(others, F.map_from_entries(F.array_compact(F.array(*missed)))))
