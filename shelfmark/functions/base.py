"""Building blocks shared by the Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# The characters Python calls white space, as a regex class that
# reads the same in Java and RE2, and as a list for btrim().
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
NOT_WS_OR_QUOTE = r"[^\"\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
WS_CHARS = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and bind it inside ``body``.

    The optimizer inlines a projected column into the lambda of a higher-order
    function, where it would run once per array element; a lambda variable is
    never inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first(array: Column) -> Column:
    """First element, NULL when the array is empty or NULL."""
    return F.try_element_at(array, F.lit(1))


def each(array: Column) -> Column:
    """Generator with one row per element of a costly array.

    For the inner form of explode Spark infers a filter on the array's size
    and so works the array out a second time. This form gives an extra NULL
    row for an empty array, which the caller filters out.
    """
    return F.explode_outer(array)


def strip(c: ColumnLike) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def non_blank(c: ColumnLike) -> Column:
    """NULL for the empty string, else the value."""
    return F.nullif(col(c), F.lit(""))


def starts_http(c: ColumnLike) -> Column:
    return F.startswith(col(c), F.lit("http://")) | F.startswith(col(c), F.lit("https://"))


def first_filled(*candidates: ColumnLike) -> Column:
    """First candidate that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[non_blank(c) for c in candidates], F.lit(""))
