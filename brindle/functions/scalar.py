"""Scalar expressions with fixed rules: null on division by zero, truncating integer division, sums that turn to doubles, JSON on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero; null by 0."""
    return F.when(b != 0, F.call_function("div", a, F.nullif(b, F.lit(0))))


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign; null by 0."""
    return F.try_mod(a, b)


def sum_exact(x: Column) -> Column:
    """An exact integer sum, or null where it overflows; sum_promote() gives a double then."""
    return F.try_sum(x)


def sum_promote(x: Column) -> Column:
    """A sum as a double: of the exact integer sum, or of the values as doubles where that overflows."""
    return F.coalesce(F.try_sum(x).cast("double"), F.sum(x.cast("double")))


def xor(a: Column, b: Column) -> Column:
    return (a & ~b) | (~a & b)


def shift_left(a: Column, n: Column) -> Column:
    """Null for shifts outside 0 to 63."""
    return F.when(n.between(0, 63), F.call_function("shiftleft", a.cast("long"), n.cast("int")))


def shift_right(a: Column, n: Column) -> Column:
    return F.when(n.between(0, 63), F.call_function("shiftright", a.cast("long"), n.cast("int")))


def substr(s: Column, start: Column, length: Column) -> Column:
    """One-based; starts under 1 count as 1, lengths under 0 as 0."""
    return F.substring(s, F.greatest(start, F.lit(1)).cast("int"), F.greatest(length, F.lit(0)).cast("int"))


def trim_chars(s: Column, chars: str = " \t\n\r\x0b\f\x85\xa0                　") -> Column:
    """Without leading and trailing characters of a set, by default white space."""
    return F.btrim(s, F.lit(chars))


def code_point(s: Column) -> Column:
    return F.ascii(s)


def from_code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def floor_real(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil_real(x: Column) -> Column:
    return F.ceil(x).cast("double")


def round_away(x: Column, digits: int = 0) -> Column:
    """Halves away from zero; fewer digits than 0 count as 0."""
    return F.round(x, max(digits, 0))


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def factorial(n: Column) -> Column:
    """Raises outside 0 to 20."""
    return F.when(n.between(0, 20), F.factorial(n.cast("int"))).when(n.isNotNull(), F.raise_error(F.lit("factorial out of range")).cast("long"))


def type_name(kind: str) -> str:
    """The storage class of a Spark type: integer, real, text, blob or null."""
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return "integer"
    if kind in ("float", "double") or kind.startswith("decimal"):
        return "real"
    return {"binary": "blob", "void": "null"}.get(kind, "text")


def date_field(field: str, x: Column) -> Column:
    """YEAR to SECOND of a timestamp, as an integer; other fields are null."""
    made = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}.get(field.upper())
    return made(x).cast("long") if made else F.lit(None).cast("long")


def hex_value(x: Column, kind: str) -> Column:
    """Hex digits of a blob or an integer; null for a text, whose bytes are no value of its own."""
    return F.lit(None).cast("string") if type_name(kind) == "text" else F.hex(x)


def power_int(a: Column, b: Column) -> Column:
    """An integer to an integer power, as an integer where that is exact, else null; power() gives the real."""
    made = F.pow(a.cast("double"), b.cast("double"))
    return F.when((b >= 0) & (F.abs(made) <= float(1 << 53)), made.cast("long"))


def epoch_field(field: str, seconds: Column) -> Column:
    """date_field of seconds since 1970, in UTC."""
    return date_field(field, F.timestamp_seconds(seconds))


def at_time_zone(x: Column, zone: str) -> Column:
    """The wall clock of a zone at a UTC time."""
    return F.from_utc_timestamp(x, zone)


# --- JSON on text


def _at(path: str) -> str:
    return path if path.startswith("$") else f"$.{path}"


def _found(doc: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(doc), _at(path), "variant")


def _kind(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(kind == "BOOLEAN", "BOOLEAN").when(kind == "VOID", "NULL").when(kind == "BIGINT", "INTEGER").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "DOUBLE").when(kind == "STRING", "STRING")
    )


def json_extract(doc: Column, path: str) -> Column:
    """The value at a path ($.a.b[0], or a bare key) as text; true is 1, false is 0, null is null."""
    found = F.get_json_object(doc, _at(path))
    kind = _kind(_found(doc, path))
    return F.when(kind == "BOOLEAN", F.when(found == "true", "1").otherwise("0")).when(kind != "NULL", found)


def json_valid(doc: Column) -> Column:
    return F.try_parse_json(doc).isNotNull().cast("int")


def json_type(doc: Column) -> Column:
    """OBJECT, ARRAY, BOOLEAN, NULL, INTEGER, DOUBLE or STRING; null for a null or what is no JSON."""
    return _kind(F.try_parse_json(doc))


def json_length(doc: Column, path: str = "$") -> Column:
    """Keys of the object at a path, items of an array, 1 for another value; null where there is none, or for what is no JSON."""
    value = _found(doc, path)
    kind, text = _kind(value), F.to_json(value)
    return F.when(kind == "OBJECT", F.size(F.json_object_keys(text))).when(kind == "ARRAY", F.json_array_length(text)).when(kind.isNotNull(), 1)


def json_keys(doc: Column) -> Column:
    return F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>"))


def json_contains(doc: Column, value: str, path: str = "$") -> Column:
    """Whether the array at a path has an item, or the text of an object there has the value in it."""
    found = _found(doc, path)
    kind, text = _kind(found), F.to_json(found)
    return F.when(kind == "ARRAY", F.array_contains(F.from_json(text, "array<string>"), value)).when(kind == "OBJECT", text.contains(value)).when(kind.isNotNull(), F.get_json_object(doc, _at(path)) == value).cast("int")


def _fields(doc: Column) -> Column:
    """An object's fields with their types."""
    return F.from_json(doc, "map<string,variant>")


def json_remove(doc: Column, *keys: str) -> Column:
    return F.to_json(F.map_filter(_fields(doc), lambda k, _: ~k.isin(*keys)))


def json_set(doc: Column, key: str, value: Column) -> Column:
    """With a key set, there or not; other values keep their types and nesting."""
    made = F.variant_get(F.parse_json(F.to_json(F.struct(value.alias("v")))), "$.v", "variant")
    return F.to_json(F.map_concat(F.map_filter(_fields(doc), lambda k, _: k != key), F.create_map(F.lit(key), made)))


def json_insert(doc: Column, key: str, value: Column) -> Column:
    return F.when(F.map_contains_key(_fields(doc), F.lit(key)), doc).otherwise(json_set(doc, key, value))


def json_replace(doc: Column, key: str, value: Column) -> Column:
    return F.when(F.map_contains_key(_fields(doc), F.lit(key)), json_set(doc, key, value)).otherwise(doc)


def json_quote(s: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(s)), r"^\[(.*)\]$", "$1")


def json_unquote(s: Column) -> Column:
    return F.when(s.rlike('^".*"$'), F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), F.lit(0))).otherwise(s)
