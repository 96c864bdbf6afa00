"""Lists, link maps and JSON-valued fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.base import ColumnLike, col, first, let, starts_http, strip

_NO_STRINGS = "array<string>"


def no_strings() -> Column:
    return F.array().cast(_NO_STRINGS)


def or_empty(c: ColumnLike) -> Column:
    """Missing list becomes an empty list."""
    return F.coalesce(col(c), no_strings())


def clean_features(c: ColumnLike) -> Column:
    """Trimmed, non-blank, distinct, in first-seen order."""
    trimmed = F.transform(or_empty(c), strip)
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def clean_social_links(c: ColumnLike) -> Column:
    """Absolute links without share links, distinct, in first-seen order."""
    keep = F.filter(or_empty(c), lambda x: ~F.contains(x, F.lit("intent/tweet")) & starts_http(x))
    return F.array_distinct(keep)


def http_only(c: ColumnLike) -> Column:
    return F.filter(or_empty(c), starts_http)


def join_list(c: ColumnLike, separator: str = "|") -> Column:
    """List as one text. The separator is not escaped inside items."""
    return F.array_join(or_empty(c), separator)


def link_map_text(c: ColumnLike, separator: str = "|") -> Column:
    """``key: url`` for each http link of a map, joined."""
    entries = F.filter(F.map_entries(col(c)), lambda e: F.startswith(e["value"], F.lit("http")))
    pairs = F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.coalesce(F.array_join(pairs, separator), F.lit(""))


def nth_http(n: int, *fields: ColumnLike) -> Column:
    """The n-th http address among ordered fields, else the empty string."""
    found = F.filter(F.array(*[col(f) for f in fields]), lambda u: F.startswith(u, F.lit("http")))
    return F.coalesce(F.try_element_at(found, F.lit(n)), F.lit(""))


def _json_starts(text: Column, mark: str) -> Column:
    return F.startswith(F.ltrim(text), F.lit(mark))


def links_from_json(c: ColumnLike) -> Column:
    """A field that is either a JSON list or a JSON object, as one struct.

    ``as_list`` or ``as_map`` is filled, the other is NULL; ``as_text`` is the
    http links of either form, joined.
    """

    def split(text: Column) -> Column:
        as_list = F.when(_json_starts(text, "["), F.from_json(text, _NO_STRINGS))
        as_map = F.when(_json_starts(text, "{"), F.from_json(text, "map<string,string>"))
        listed = F.array_join(F.filter(as_list, lambda u: F.startswith(u, F.lit("http"))), "|")
        as_text = F.when(as_map.isNotNull(), link_map_text(as_map)).otherwise(F.coalesce(listed, F.lit("")))
        return F.struct(as_list.alias("as_list"), as_map.alias("as_map"), as_text.alias("as_text"))

    return let(col(c).cast("string"), split)


def parse_reply(c: ColumnLike, schema: str) -> Column:
    """One record out of a JSON reply: the object, or the first of a list.

    Text that is not JSON gives NULL.
    """

    def parse(text: Column) -> Column:
        good = F.try_parse_json(text).isNotNull()
        one = F.when(good & _json_starts(text, "{"), F.from_json(text, schema))
        many = F.when(good & _json_starts(text, "["), F.from_json(text, f"array<struct<{schema}>>"))
        return F.coalesce(one, first(many))

    return let(col(c), parse)
