"""Strict JSON gate and canonical JSON, on variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlake import fixed_values as fv
from sessionlake.functions.text import js_trim

_MARK = "~end-of-row~"


# The parser's own limits on one string (20 million characters) and one number
# (1000 digits) are lifted for the few lines that may need it.
_WIDE = {"maxStringLen": str(2**31 - 1), "maxNumLen": str(2**31 - 1), "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_PARSER_STRING_CHARS = 20_000_000
_PARSER_NUMBER = "[0-9.]{999}"


def _wide_json(text: Column) -> Column:
    return F.from_json(text, "variant", _WIDE)


def _may_be_wide(text: Column) -> Column:
    return (F.length(text) > _PARSER_STRING_CHARS) | F.rlike(text, F.lit(_PARSER_NUMBER))


def _pair(trimmed: Column, parse=F.try_parse_json) -> Column:
    """The text parsed as first element of an array that ends with a marker.

    The parser stops after the first value and would accept trailing junk.  In
    the array the marker is the second element only when the text is one
    complete value (and does not hold the marker itself).
    """
    return parse(F.concat(F.lit("["), trimmed, F.lit(f',"{_MARK}"]')))


def _first(value: Column) -> Column:
    # Looked up by path: casting to an array would copy every element.
    return F.try_variant_get(value, "$[0]", "variant")


def _complete(pair: Column) -> Column:
    return F.coalesce(F.try_variant_get(pair, "$[1]", "string"), F.lit("")) == _MARK


def _marked_value(trimmed: Column, parse=F.try_parse_json) -> Column:
    """Value of a text that holds the marker: it must parse inside an array and
    inside an object, which between them leave room for one value only."""
    in_array = parse(F.concat(F.lit("["), trimmed, F.lit("]")))
    in_object = parse(F.concat(F.lit('{"v":'), trimmed, F.lit("}")))
    return F.when(in_object.isNotNull(), _first(in_array))


def _value(trimmed: Column, parse) -> Column:
    pair = _pair(trimmed, parse)
    return F.when(F.contains(trimmed, F.lit(_MARK)), _marked_value(trimmed, parse)).when(_complete(pair), _first(pair))


def checked_json(trimmed: Column) -> Column:
    """The value as a variant when the text is exactly one JSON value, else null."""
    return F.coalesce(_value(trimmed, F.try_parse_json), F.when(_may_be_wide(trimmed), _value(trimmed, _wide_json)))


def parse_lines(frame: DataFrame, raw: str = "raw", with_row: bool = True) -> DataFrame:
    """Adds ``status`` (ok, blank, parse, oversized-line) and the parsed ``row``.

    The text is parsed once; lines that fail and hold a very long string or
    number are parsed again without the parser's limits on those.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    # Nearly every line is an object and needs no trimming.
    bare = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))
    trimmed = F.when(bare, text).otherwise(js_trim(text))
    marked = F.contains(text, F.lit(_MARK))
    parsed = evaluate_once(frame, _pair=F.when(~marked, _pair(trimmed)))
    pair = F.col("_pair")
    good = F.when(marked, _marked_value(trimmed).isNotNull()).otherwise(_complete(pair))
    # Reached by lines that are not good only.
    wide = F.when(_may_be_wide(text), _value(trimmed, _wide_json))
    status = (
        F.when(good, "ok")
        .when(trimmed == "", "blank")
        .when(wide.isNotNull(), "ok")
        .when(F.octet_length(text) > fv.MAX_ROW_BYTES, "oversized-line")
        .otherwise("parse")
    )
    if not with_row:
        return evaluate_once(parsed, status=status).drop("_pair")
    near = F.when(marked, _marked_value(trimmed)).when(_complete(pair), _first(pair))
    return evaluate_once(parsed, status=status, row=F.coalesce(near, wide)).drop("_pair")


def field(value: Column, path: str, kind: str = "string") -> Column:
    """Typed field of a variant; null when absent or of another type."""
    return F.try_variant_get(value, path, kind)


def text_field(value: Column, path: str) -> Column:
    """String field, with the empty string read as absent."""
    found = field(value, path)
    return F.when(found != "", found)


def canonical(value: Column) -> Column:
    """JSON text with keys sorted at every level; null for an absent value."""
    return F.to_json(value)


def quoted(text: Column) -> Column:
    """JSON string literal of a text, ``null`` for null."""
    return F.coalesce(F.to_json(text.cast("variant")), F.lit("null"))


def canonical_text(json_text: Column) -> Column:
    """Canonical form of JSON given as text (null when it is not JSON)."""
    return canonical(checked_json(js_trim(json_text)))


def with_fields(json_text: Column, fields: dict[str, Column]) -> Column:
    """The object with these string fields set, all others as they were; a null
    field is left alone, and what is no object comes back as it is."""
    entries = checked_json(js_trim(json_text)).try_cast("map<string,variant>")
    new = F.create_map(*[c for name, value in fields.items() for c in (F.lit(name), value.cast("variant"))])
    new = F.map_filter(new, lambda _, v: v.isNotNull())
    merged = F.map_concat(F.map_filter(entries, lambda k, _: ~F.map_contains_key(new, k)), new)
    return F.when(entries.isNotNull(), F.to_json(F.to_variant_object(merged))).otherwise(json_text)


def evaluate_once(frame: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row.

    Later filters and projections would otherwise be merged with the
    definitions and parse the same text again for every use.  A generator over
    one struct is a boundary the optimizer does not move expressions across.
    """
    struct = F.struct(*[c.alias(n) for n, c in columns.items()])
    return frame.select("*", F.inline(F.array(struct)))
