"""Split a long description into its named parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.base import NOT_WS_OR_QUOTE, WS, ColumnLike, col, starts_http
from shelfmark.functions.text import display_text

# Where each part starts and ends, and how lists are split.
_SHORT = rf"(?isu)what is .+?{WS}+(.*?)(?:how to use|$)"
_HOW_TO = rf"(?isu)how to use .+?{WS}+(.*?)(?:Core Features|$)"
_FEATURES = rf"(?isu)Core Features{WS}*(.*?)(?:Use Cases|FAQ|Support Email|$)"
_USE_CASES = rf"(?isu)Use Cases{WS}*(.*?)(?:FAQ|Support Email|$)"
_FEATURE_BREAK = rf"{WS}{{2,}}|\p{{Nd}}+\."
_USE_CASE_BREAK = rf"#\p{{Nd}}+|{WS}{{2,}}"

# Profile links are rebuilt from host + slug.
PROFILE_LINKS = {
    "discord": (rf"discord(?:\.gg|app\.com)/({NOT_WS_OR_QUOTE}+)", "discord.gg"),
    "facebook": (rf"facebook\.com/({NOT_WS_OR_QUOTE}+)", "facebook.com"),
    "twitter": (rf"twitter\.com/({NOT_WS_OR_QUOTE}+)", "twitter.com"),
    "linkedin": (rf"linkedin\.com/(?:company/)?({NOT_WS_OR_QUOTE}+)", "linkedin.com"),
    "youtube": (rf"youtube\.com/(?:@)?({NOT_WS_OR_QUOTE}+)", "youtube.com"),
    "instagram": (rf"instagram\.com/({NOT_WS_OR_QUOTE}+)", "instagram.com"),
}
# These links are written out in full.
WHOLE_LINKS = {
    "login": rf"Login Link:{WS}*(https?://{NOT_WS_OR_QUOTE}+)",
    "signup": rf"Sign up Link:{WS}*(https?://{NOT_WS_OR_QUOTE}+)",
    "contact": rf"contact us page{WS}*\((https?://[^)]+)\)",
}


def _group1(c: ColumnLike, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), pattern, 1)


def _items(text: Column, separator: str) -> Column:
    parts = F.transform(F.split(text, separator, -1), display_text)
    return F.filter(parts, lambda part: part != "")


def short_description(c: ColumnLike) -> Column:
    return display_text(_group1(c, _SHORT))


def how_to_use(c: ColumnLike) -> Column:
    return display_text(_group1(c, _HOW_TO))


def features(c: ColumnLike) -> Column:
    return _items(_group1(c, _FEATURES), _FEATURE_BREAK)


def use_cases(c: ColumnLike) -> Column:
    return _items(_group1(c, _USE_CASES), _USE_CASE_BREAK)


def profile_link(c: ColumnLike, platform: str) -> Column:
    """Profile address, or the empty string; a captured full address is kept."""
    pattern, host = PROFILE_LINKS[platform]
    found = _group1(c, f"(?iu){pattern}")
    return (
        F.when(found == "", "")
        .when(starts_http(found), found)
        .otherwise(F.concat(F.lit(f"https://{host}/"), found))
    )


def whole_link(c: ColumnLike, kind: str) -> Column:
    return _group1(c, f"(?iu){WHOLE_LINKS[kind]}")


def link_columns(c: ColumnLike) -> dict[str, Column]:
    """All nine links by name."""
    links = {name: profile_link(c, name) for name in PROFILE_LINKS}
    links.update({name: whole_link(c, name) for name in WHOLE_LINKS})
    return links
