"""Text cleaning and normalisation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.base import WS, ColumnLike, col, starts_http, strip

# Fixed value: characters the display form does not keep.
_NOT_DISPLAYED = r"[^\p{L}\p{N}_ .,!?()-]"


def match_text(c: ColumnLike) -> Column:
    """Lower case, ASCII letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def display_text(c: ColumnLike) -> Column:
    """One space per white-space run, unusual characters removed.

    Spaces are not collapsed again after the removal, so ``a & b`` keeps two.
    """
    spaced = F.regexp_replace(F.coalesce(col(c), F.lit("")), f"{WS}+", " ")
    return F.trim(F.regexp_replace(spaced, _NOT_DISPLAYED, ""))


def description_text(c: ColumnLike) -> Column:
    """Drop the question headings and everything from the FAQ on."""
    text = F.coalesce(col(c), F.lit(""))
    text = F.regexp_replace(text, r"(?d)What is .+?\?", "")
    text = F.regexp_replace(text, r"(?d)How to use .+?\?", "")
    text = F.regexp_replace(text, r"(?s)FAQ from.*", "")
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def without_qa_markers(c: ColumnLike) -> Column:
    """Remove ``Q1 A1`` counters and retitle the FAQ line."""
    text = F.regexp_replace(col(c), rf"{WS}+Q\p{{Nd}}+{WS}+A\p{{Nd}}+{WS}+", " ")
    return F.regexp_replace(text, r"(?d)FAQ from.*?\n", "\nFrequently Asked Questions:\n")


def email_address(c: ColumnLike, placeholder: str) -> Column:
    """Trimmed lower-case address, or the empty string when it is not one."""
    address = F.lower(strip(c))
    usable = (
        (address != placeholder)
        & F.contains(address, F.lit("@"))
        & F.contains(address, F.lit("."))
    )
    return F.when(usable, address).otherwise("")


def slug(c: ColumnLike) -> Column:
    """File-name form: letters, digits, ``-`` and ``_``, spaces as ``_``."""
    kept = F.trim(F.regexp_replace(col(c), r"[^\p{L}\p{N} _-]", ""))
    return F.lower(F.translate(kept, " ", "_"))


def collapse_once(c: ColumnLike) -> Column:
    """Newlines to spaces, then one pass of two spaces to one."""
    return strip(F.replace(F.translate(col(c), "\n", " "), F.lit("  "), F.lit(" ")))


def preview(c: ColumnLike, length: int) -> Column:
    """First ``length`` characters, for log lines."""
    return F.left(col(c), F.lit(length))


def linked(c: ColumnLike, pattern: str) -> Column:
    """First match of ``pattern`` as an absolute link, else the empty string.

    Group 1 is used when the pattern has one, and ``https://`` is put before a
    match without scheme.
    """
    group = 1 if re.search(r"(?<!\\)\((?!\?)", pattern) else 0
    found = F.regexp_extract(F.coalesce(col(c), F.lit("")), f"(?iu){pattern}", group)
    return (
        F.when(found == "", "")
        .when(starts_http(found), found)
        .otherwise(F.concat(F.lit("https://"), found))
    )
