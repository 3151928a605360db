"""Fields of submission notes, which come in two shapes.

The older interface stores a content field bare (``"title": "A"``), the newer one
wraps it (``"title": {"value": "A"}``). Both are read from one VARIANT column.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def member(note: Column, *keys: str) -> Column:
    """Nested member as VARIANT; null where the path is absent."""
    path = "$" + "".join(f'["{k}"]' for k in keys)
    return F.try_variant_get(note, path, "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_truthy(value: Column) -> Column:
    """Whether a JSON value counts as given: not null, zero, false or empty."""
    kind = _kind(value)
    return F.coalesce(
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "STRING", F.length(F.try_variant_get(value, "$", "string")) > 0)
        .when(kind.startswith("OBJECT<"), kind != "OBJECT<>")
        .otherwise(~F.to_json(value).isin("0", "0.0", "false", "[]")),
        F.lit(False),
    )


def string_of(value: Column) -> Column:
    """The string itself, or the string under ``value``; null for every other type.

    Reading an object as a string would give its JSON text, hence the type check.
    """
    inner = member(value, "value")
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string")).when(
        _kind(inner) == "STRING", F.try_variant_get(inner, "$", "string")
    )


def text_field(content: Column, *keys: str) -> Column:
    """First given key, unwrapped; empty if no key holds a text."""
    chosen = member(content, keys[-1])
    for key in reversed(keys[:-1]):
        candidate = member(content, key)
        chosen = F.when(is_truthy(candidate), candidate).otherwise(chosen)
    return F.coalesce(string_of(chosen), F.lit(""))


def optional_text(content: Column, key: str) -> Column:
    """Text of a field, null when it is absent or not a text."""
    return string_of(member(content, key))


def wrapped_text(content: Column, key: str) -> Column:
    """Like :func:`optional_text`, but an object without ``value`` is a field left empty."""
    given = member(content, key)
    bare_object = _kind(given).startswith("OBJECT<") & member(content, key, "value").isNull()
    return F.coalesce(string_of(given), F.when(bare_object, F.lit("")))


def string_list(content: Column, key: str) -> Column:
    """String elements of a list field, bare or wrapped; an empty list for anything else."""
    bare = F.try_variant_get(member(content, key), "$", "array<variant>")
    wrapped = F.try_variant_get(member(content, key, "value"), "$", "array<variant>")
    strings = F.filter(F.coalesce(bare, wrapped), lambda v: F.coalesce(_kind(v) == "STRING", F.lit(False)))
    return F.coalesce(
        F.transform(strings, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>")
    )
