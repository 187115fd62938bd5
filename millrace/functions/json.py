"""JSON settings: parse, tell broken from missing, keep or drop keys, print."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def parse_object(text: Column) -> Column:
    """A JSON object as map<string,variant>, so that values keep their types; else NULL."""
    return F.from_json(text, "map<string,variant>")


def json_state(text: Column) -> Column:
    """`missing` for NULL, `broken` for invalid JSON, else the kind of value it holds."""
    value = F.try_parse_json(text)
    shape = F.schema_of_variant(value)
    return (
        F.when(text.isNull(), "missing")
        .when(value.isNull(), "broken")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(F.is_variant_null(value), "null")
        .otherwise("scalar")
    )


def keep_keys(settings: Column, keys: Sequence[str], rename: Mapping[str, str] | None = None) -> Column:
    """Only the listed keys of a settings map, renamed where asked."""
    kept = F.map_filter(settings, lambda key, _: key.isin(*keys))
    if not rename:
        return kept
    names = F.create_map(*[F.lit(name) for pair in rename.items() for name in pair])
    return F.transform_keys(kept, lambda key, _: F.coalesce(F.try_element_at(names, key), key))


def drop_keys(settings: Column, keys: Sequence[str]) -> Column:
    """All but the listed keys of a settings map."""
    return F.map_filter(settings, lambda key, _: ~key.isin(*keys))


def dependency_list(value: Column) -> Column:
    """A parsed dependency value as array<string>: JSON null is empty, other than strings NULL."""
    shape = F.schema_of_variant(value)
    items = F.try_variant_get(value, "$", "array<string>")
    strings = shape.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(items, lambda item: item.isNotNull())
    return F.when(shape == "VOID", F.array().cast("array<string>")).when(strings, items)


def parse_dependencies(text: Column) -> Column:
    """A JSON array of strings; NULL text or JSON null is an empty list, anything else NULL."""
    empty = F.array().cast("array<string>")
    return F.when(text.isNull(), empty).otherwise(dependency_list(F.try_parse_json(text)))


def parameters_as_strings(parameters: Column) -> Column:
    """A JSON object of parameters as map<string,string>; numbers and booleans as JSON prints them."""
    return F.coalesce(F.from_json(parameters, "map<string,string>"), F.create_map().cast("map<string,string>"))


def parameters_as_list(parameters: Column) -> Column:
    """Parameters of list-type tasks: an array as it is, an object as its values, else empty."""
    as_map = F.from_json(parameters, "map<string,string>")
    as_list = F.from_json(parameters, "array<string>")
    return F.coalesce(as_list, F.map_values(as_map), F.array().cast("array<string>"))
