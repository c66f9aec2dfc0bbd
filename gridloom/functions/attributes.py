"""Typed access to attributes, kept as JSON text in a column. Wrong types raise; a missing key gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERS = ("int", "bigint", "float", "double")


def _path(key: str) -> str:
    return "$" + "".join(f"['{part}']" for part in key.split("."))


def _raw(attributes: Column, key: str) -> Column:
    return F.get_json_object(attributes, _path(key))


def _typed(attributes: Column, key: str, good: Column, value: Column, kind: str) -> Column:
    raw = _raw(attributes, key)
    return F.when(raw.isNull(), F.lit(None)).when(good, value).otherwise(F.raise_error(F.concat(F.lit(f"attribute {key} is not of type {kind}: "), raw)))


def get_boolean(attributes: Column, key: str) -> Column:
    raw = _raw(attributes, key)
    return _typed(attributes, key, raw.isin("true", "false"), raw == "true", "boolean")


def get_number(attributes: Column, key: str, kind: str = "double") -> Column:
    """int, bigint, float or double; any number is narrowed to the type asked for."""
    if kind not in _NUMBERS:
        raise ValueError(f"{kind!r} is no number type")
    value = _raw(attributes, key).try_cast("double")
    return _typed(attributes, key, value.isNotNull(), value.try_cast(kind), kind)


def get_int(attributes: Column, key: str) -> Column:
    return get_number(attributes, key, "int")


def get_float(attributes: Column, key: str) -> Column:
    return get_number(attributes, key, "float")


def get_double(attributes: Column, key: str) -> Column:
    return get_number(attributes, key, "double")


def get_string(attributes: Column, key: str) -> Column:
    return _raw(attributes, key)


def get_attributes(attributes: Column, key: str) -> Column:
    """A nested object, again as JSON text."""
    raw = _raw(attributes, key)
    return _typed(attributes, key, raw.startswith("{"), raw, "object")


def get_list(attributes: Column, key: str) -> Column:
    """Elements as JSON text: strings as they are, all others as written."""
    raw = _raw(attributes, key)
    return _typed(attributes, key, raw.startswith("["), F.from_json(raw, "array<string>"), "list")


def get_array(attributes: Column, key: str, kind: str) -> Column:
    """An array of int, bigint, double, float, boolean or string; an element of another type raises."""
    elements = get_list(attributes, key)
    if kind == "string":
        return elements
    cast = F.transform(elements, lambda x: x.try_cast("double").try_cast(kind) if kind in _NUMBERS else x.try_cast(kind))
    raw = _raw(attributes, key)
    return _typed(attributes, key, ~F.exists(cast, lambda x: x.isNull()), cast, f"array of {kind}")


def set_attribute(attributes: Column, key: str, value: Column) -> Column:
    """With a top-level key set; ``value`` is JSON text."""
    entries = F.from_json(F.coalesce(attributes, F.lit("{}")), "map<string,string>", {"allowUnquotedControlChars": "true"})
    return _object(F.map_concat(F.map_filter(entries, lambda k, _: k != key), F.create_map(F.lit(key), value)), attributes, key)


def delete_attribute(attributes: Column, key: str) -> Column:
    entries = F.from_json(attributes, "map<string,string>")
    return _object(F.map_filter(entries, lambda k, _: k != key), attributes, None)


def _object(entries: Column, attributes: Column, new: str | None) -> Column:
    """JSON text of a map from keys to texts; values that were strings in the old document are quoted again."""

    def pair(k: Column) -> Column:
        v = F.element_at(entries, k)
        plain = v.rlike(r"^(-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null|[\[{].*)$")
        quoted = F.when((k == (new or "")) & F.lit(new is not None), v).when(plain & ~_was_string(attributes, k, v), v).otherwise(F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"')))
        return F.concat(F.lit('"'), k, F.lit('":'), quoted)

    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_keys(entries), pair), ","), F.lit("}"))


def _was_string(attributes: Column, key: Column, value: Column) -> Column:
    return F.instr(F.regexp_replace(F.coalesce(attributes, F.lit("")), r"\s*:\s*", ":"), F.concat(F.lit('"'), key, F.lit('":"'), value, F.lit('"'))) > 0
