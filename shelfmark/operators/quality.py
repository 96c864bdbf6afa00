"""Expectations on records: completeness, validity and conformance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.base import starts_http
from shelfmark.schemas import CONFORMED, with_columns_of

# The keys that a complete record has.
REQUIRED_KEYS = ("name", "description", "category")


def is_complete(required: tuple[str, ...] = REQUIRED_KEYS) -> Column:
    """All required fields are present."""
    result = F.lit(True)
    for field in required:
        result = result & F.col(field).isNotNull()
    return result


def is_placeholder(field: str, value: Column, placeholders: dict[str, str]) -> Column:
    """The value is the field's placeholder; other fields' is the empty string."""
    return F.coalesce(value == placeholders.get(field, ""), F.lit(False))


def _number(text: Column) -> Column:
    """Number in a text, NULL when it is none. Suffixes like ``1d`` are none."""
    text = text.cast("string")
    return F.when(~F.rlike(text, F.lit("[dDfF]$")), text.try_cast("double"))


def expectations(rating: str = "rating", links: str = "social_links") -> dict[str, Column]:
    """Named tests of a valid record; ``links`` is a map column."""

    def stated(field: str) -> Column:
        return F.col(field).isNotNull() & (F.col(field) != "N/A")

    def address(field: str) -> Column:
        return F.col(field).isNotNull() & ((F.col(field) == "N/A") | starts_http(field))

    value = F.col(rating)
    email = F.col("support_email")
    return {
        "name": stated("name"),
        "description": stated("description"),
        "rating": value.isNull() | F.coalesce(_number(value).between(0, 5), F.lit(False)),
        "image_url": address("image_url"),
        "pricing_link": address("pricing_link"),
        "social_links": F.coalesce(
            F.map_contains_key(links, "twitter") & F.map_contains_key(links, "linkedin"), F.lit(False)
        ),
        "support_email": email.isNotNull() & ((email == "N/A") | F.contains(email, F.lit("@"))),
    }


def check(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Add ``failed_rules`` and ``valid``."""
    failed = F.filter(
        F.array(*[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in tests.items()]),
        lambda name: name.isNotNull(),
    )
    return df.withColumn("failed_rules", failed).withColumn("valid", F.size("failed_rules") == 0)


def validate(df: DataFrame) -> DataFrame:
    """Records with ``failed_rules`` and ``valid`` under the standard tests."""
    return check(df, expectations())


def conform(df: DataFrame) -> DataFrame:
    """Bring records to the fixed schema: casts, defaults and ``violations``.

    A record without violations is ready to store; the others keep the fields
    that could be read.
    """
    raw = with_columns_of(df, CONFORMED)
    rating = _number(F.col("rating"))
    api = F.col("api_available").cast("string").try_cast("boolean")
    problems = {
        "name": F.col("name").isNull(),
        "description": F.col("description").isNull(),
        "rating": F.col("rating").isNotNull() & (rating.isNull() | ~rating.between(0, 5)),
        "api_available": F.col("api_available").isNotNull() & api.isNull(),
    }
    violations = F.filter(
        F.array(*[F.when(test, name) for name, test in problems.items()]), lambda name: name.isNotNull()
    )
    values = {
        "category": F.coalesce("category", F.lit("Other")),
        "features": F.coalesce("features", F.array().cast("array<string>")),
        "rating": F.coalesce(rating, F.lit(0.0)),
        "api_available": F.coalesce(api, F.lit(False)),
    }
    for field in ("monthly_traffic", "image_url", "twitter_link", "linkedin_link", "support_email",
                  "pricing_link", "pricing_model"):
        values[field] = F.coalesce(field, F.lit("N/A"))
    extra = [c for c in df.columns if c not in CONFORMED]
    return raw.select(
        *extra,
        *[values.get(name, F.col(name)).cast(kind).alias(name) for name, kind in CONFORMED.items()],
        violations.alias("violations"),
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected records of ``validate``."""
    return checked.filter("valid"), checked.filter("not valid")
