"""JSON and text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plantpulse.functions.columns import as_col


def json_valid(c) -> Column:
    """True for exactly one JSON value. The parser ignores what follows a value, so the text is put
    in front of a marker inside an array and inside an object: only a single value lets both markers
    be found."""
    c = as_col(c)
    listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit(",7]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit(',"end":7}')))
    return F.coalesce(
        (F.try_variant_get(listed, "$[1]", "int") == 7) & (F.try_variant_get(named, "$.end", "int") == 7), F.lit(False))


def json_object(c) -> Column:
    return json_valid(c) & F.coalesce(F.ltrim(as_col(c)).startswith("{"), F.lit(False))


def json_array(c) -> Column:
    return json_valid(c) & F.coalesce(F.ltrim(as_col(c)).startswith("["), F.lit(False))


def capitalised(c) -> Column:
    """First letter upper case, the others lower case."""
    c = as_col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def digits_only_time(c) -> Column:
    """Time text without colons, blanks and dashes, as export file names carry it."""
    return F.regexp_replace(as_col(c), r"[:\s-]", "")


def topic_of(sensor_type) -> Column:
    """Topic of a sensor type; blank types share the general topic."""
    kind = as_col(sensor_type)
    suffix = F.when(F.coalesce(F.length(kind), F.lit(0)) == 0, F.lit("general")).otherwise(F.lower(kind))
    return F.concat(F.lit("sensor-data-"), suffix)
