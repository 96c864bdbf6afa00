"""Addresses: cleaning, resolving and naming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.base import ColumnLike, col, let, starts_http, strip
from shelfmark.functions.text import slug


def clean_url(c: ColumnLike, base_url: str, placeholder_image: str) -> Column:
    """Absolute http(s) address, or the empty string.

    ``//host/x`` is tested before ``/x``, so it keeps its own host.
    """

    def resolve(url: Column) -> Column:
        return (
            F.when(url.isNull() | F.contains(url, F.lit(placeholder_image)), "")
            .when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url))
            .when(F.startswith(url, F.lit("/")), F.concat(F.lit(base_url), url))
            .when(starts_http(url), url)
            .otherwise("")
        )

    return let(strip(c), resolve)


def absolute_url(c: ColumnLike, page_url: ColumnLike) -> Column:
    """Resolve ``//x``, ``/x`` and ``./x`` against the host of ``page_url``.

    Other forms are returned unchanged.
    """
    page = col(page_url)
    root = F.concat(
        F.try_parse_url(page, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(page, F.lit("AUTHORITY"))
    )
    link = col(c)
    return (
        F.when(F.startswith(link, F.lit("//")), F.concat(F.lit("https:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("./")), F.concat(root, F.substring(link, F.lit(2), F.length(link))))
        .otherwise(link)
    )


def asset_url(name: ColumnLike, kind: str, asset_base: str) -> Column:
    """Address of the stored screenshot of a listing."""
    return F.concat(F.lit(f"{asset_base}/"), slug(name), F.lit(f"_{kind}.png"))


def base_name(c: ColumnLike) -> Column:
    return F.substring_index(col(c), "/", -1)


def listing_page_url(base_url: ColumnLike, page_no: ColumnLike) -> Column:
    """Address of page n of a listing: the first page has no suffix."""
    base, number = col(base_url), col(page_no)
    return F.when(number > 1, F.concat(base, F.lit("/page/"), number.cast("string"))).otherwise(base)
