"""Keys, templates and command lists, all on built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, functions as F

# The reference of a variable, the command prefixes and the key prefix.
VARIABLE_PATTERN = r"\$\{var\.([a-zA-Z_][a-zA-Z0-9_]*)\}"
COMMAND_PREFIXES = ("dbt", "edr")
KEY_PREFIX = "task_"


def clean_key(key: Column) -> Column:
    """A key of word characters: runs of anything else become one `_`, none at the ends.

    Keys that began with neither a letter, a digit nor `_` get a prefix, unless nothing is left.
    """
    cleaned = F.btrim(F.regexp_replace(key, "[^a-zA-Z0-9]+", "_"), F.lit("_"))
    odd_start = key.rlike(r"^[^\p{L}\p{N}_]")
    return F.when(odd_start & (cleaned != ""), F.concat(F.lit(KEY_PREFIX), cleaned)).otherwise(cleaned)


def variable_map(variables: Mapping[str, Any] | Column) -> Column:
    """Variables as a map column; a map column is passed through."""
    if isinstance(variables, Column):
        return variables
    if not variables:
        return F.create_map().cast("map<string,string>")
    pairs = [F.lit(x) for name, value in variables.items() for x in (name, str(value))]
    return F.create_map(*pairs)


def template_names(text: Column) -> Column:
    """Names of the variables a template refers to, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(VARIABLE_PATTERN), F.lit(1))


def undefined_variables(text: Column, variables: Mapping[str, Any] | Column) -> Column:
    """Referenced names without a value, each once; an empty set of variables checks nothing."""
    values = variable_map(variables)
    missing = F.array_except(template_names(text), F.map_keys(values))
    return F.when(F.size(values) == 0, F.array().cast("array<string>")).otherwise(missing)


def fill_template(text: Column, variables: Mapping[str, Any] | Column) -> Column:
    """The template with every reference replaced; NULL if a name has no value.

    The text is split at its references and put together again with the values in between,
    so values are not scanned again: one that looks like a reference, or completes one with
    the text around it, stays as it is. An empty set of variables leaves the text alone.
    """
    values = variable_map(variables)
    parts = F.zip_with(
        F.split(text, VARIABLE_PATTERN, -1),
        template_names(text),
        lambda piece, name: F.concat(piece, F.when(name.isNull(), "").otherwise(F.try_element_at(values, name))),
    )
    complete = F.forall(parts, lambda part: part.isNotNull())
    return (
        F.when(F.size(values) == 0, text)
        .when(~F.contains(text, F.lit("${var.")), text)
        .when(complete, F.array_join(parts, ""))
    )


def commands_have_prefix(commands: Column, prefixes: tuple[str, ...] = COMMAND_PREFIXES) -> Column:
    """True if every command, once trimmed, starts with one of the prefixes."""
    pattern = "^(" + "|".join(prefixes) + ")"
    return F.forall(commands, lambda command: F.trim(command).rlike(pattern))


def display_name(name: Column, resource_id: Column, prefix: str = "") -> Column:
    """The job's name, or its id when it has none, after a prefix."""
    shown = F.coalesce(name, resource_id.cast("string"))
    return F.concat(F.lit(prefix), shown) if prefix else shown
