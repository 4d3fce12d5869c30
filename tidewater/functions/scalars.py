"""Scalar helpers H1-H16 as built-in Column expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_bucket(d) -> Column:
    """H1: ``YYYY-MM`` bucket of a date."""
    return F.date_format(_c(d), "yyyy-MM")


def quarter_label(d) -> Column:
    """H2: ``YYYY-Qn`` label; uses quarter() instead of integer division."""
    return F.concat(F.year(_c(d)).cast("string"), F.lit("-Q"), F.quarter(_c(d)).cast("string"))


def nullif_zero(x) -> Column:
    """H5: NULL instead of a zero denominator."""
    return F.nullif(_c(x), F.lit(0))


def rate_pct(numerator, denominator, scale: int = 1) -> Column:
    """``round(100 * num / den, scale)`` as DOUBLE, NULL on a zero denominator."""
    num = (_c(numerator) * 100).cast("double")
    return F.round(num / nullif_zero(_c(denominator)).cast("double"), scale)


def mean_of_decimal(x) -> Column:
    """Exact decimal sum turned into a DOUBLE mean (aggregate expression)."""
    return F.sum(_c(x)).cast("double") / F.count(_c(x))


def clean_reference(x) -> Column:
    """H8: the string without any white space at its ends, empty -> NULL. Caller gates on JSON string type."""
    return F.nullif(F.regexp_replace(_c(x), r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", ""), F.lit(""))


def parse_quantity(x, strip_dollar: bool = False) -> Column:
    """H9: drop thousands commas (and ``$``), take the first token, parse; NULL on failure."""
    pattern = "[,$]" if strip_dollar else ","
    cleaned = F.trim(F.regexp_replace(_c(x).cast("string"), pattern, ""))
    first = F.split(cleaned, r"\s+").getItem(0)
    # a cast alone would also take type suffixes and hexadecimal numbers
    return F.when(first.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), first.try_cast("double"))


def loose_equal(a, b) -> Column:
    """Case- and space-insensitive equality."""
    return F.lower(F.trim(_c(a))) == F.lower(F.trim(_c(b)))


def loose_contains(haystack, needle) -> Column:
    """Case-insensitive containment."""
    return F.contains(F.lower(_c(haystack)), F.lower(_c(needle)))


def cut_with_ellipsis(x, n: int) -> Column:
    """First ``n`` characters plus ``...`` when longer."""
    return F.when(F.length(_c(x)) > n, F.concat(F.substring(_c(x), 1, n), F.lit("..."))).otherwise(_c(x))


def to_number(x) -> Column:
    """Number or 0.0."""
    return F.coalesce(_c(x).cast("string").try_cast("double"), F.lit(0.0))


def clamp01(x) -> Column:
    """Clamp into [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(x)))


def business_key(prefix: str, year, key, width: int = 6) -> Column:
    """Zero-padded key like ``SHP-YYYY-NNNNNN`` (never truncates)."""
    return F.format_string(f"{prefix}-%d-%0{width}d", _c(year), _c(key))


def bound(value, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def python_type(schema: Column) -> Column:
    """Python type name of a JSON value from its variant schema string."""
    return (F.when(schema.startswith("OBJECT"), "dict").when(schema.startswith("ARRAY"), "list")
            .when(schema == "STRING", "str").when(schema == "BOOLEAN", "bool")
            .when(schema == "BIGINT", "int").when(schema == "VOID", "NoneType").otherwise("float"))


def complete_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing more, else null.

    Spark's parser stops where a value ends. The text is parsed once, as the
    first item of an array whose second is the text's own hash: text that goes
    on after its value, or closes the array, leaves another second item.
    """
    return bound(text, _complete_json)


def _complete_json(text: Column) -> Column:
    mark = F.xxhash64(text)
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    return bound(listed, lambda v: F.when(F.try_variant_get(v, "$[1]", "bigint") == mark, F.variant_get(v, "$[0]", "variant")))


def float_text(x) -> Column:
    """A double as Python prints it: plain digits from 1e-4 up to 1e16, an
    exponent of two digits and more outside."""
    text = _c(x).cast("string")
    size = F.abs(_c(x))
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    power = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(-?)(\d)$", "E$10$2")
    power = F.regexp_replace(F.regexp_replace(power, r"E-", "e-"), r"E", "e+")
    return (F.when(~F.contains(text, F.lit("E")), text)
            .when((size >= 1e-4) & (size < 1e16), plain).otherwise(power))
