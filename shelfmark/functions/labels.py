"""Category labels: domain, aliases and normalisation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.arrays import or_empty
from shelfmark.functions.base import ColumnLike, col, let, strip

OTHER = "Other"

# Categories in tie-break order.
CATEGORIES = (
    "Marketing & Advertising",
    "Social Media Marketing",
    "Content Marketing",
    "Email Marketing",
    "SEO Tools",
    "Analytics & Insights",
    "Marketing Automation",
    "Visual Marketing",
)
DOMAIN = (*CATEGORIES, OTHER)

# Other names in use for each category.
ALIASES = {
    "Digital Advertising": "Marketing & Advertising",
    "PPC Tools": "Marketing & Advertising",
    "Ad Management": "Marketing & Advertising",
    "Display Advertising": "Marketing & Advertising",
    "Social Media Management": "Social Media Marketing",
    "Social Media Analytics": "Social Media Marketing",
    "Social Media Automation": "Social Media Marketing",
    "Social Media Scheduling": "Social Media Marketing",
    "Content Creation": "Content Marketing",
    "Content Writing": "Content Marketing",
    "Blog Writing": "Content Marketing",
    "Copywriting": "Content Marketing",
    "Content Strategy": "Content Marketing",
    "Email Automation": "Email Marketing",
    "Newsletter Tools": "Email Marketing",
    "Email Campaign": "Email Marketing",
    "Email Marketing Platform": "Email Marketing",
    "SEO Software": "SEO Tools",
    "Keyword Research": "SEO Tools",
    "Rank Tracking": "SEO Tools",
    "SEO Analytics": "SEO Tools",
    "Marketing Analytics": "Analytics & Insights",
    "Performance Analytics": "Analytics & Insights",
    "Marketing Metrics": "Analytics & Insights",
    "Data Analytics": "Analytics & Insights",
    "Workflow Automation": "Marketing Automation",
    "CRM Tools": "Marketing Automation",
    "Lead Management": "Marketing Automation",
    "Marketing Workflow": "Marketing Automation",
    "Video Marketing": "Visual Marketing",
    "Image Creation": "Visual Marketing",
    "Design Tools": "Visual Marketing",
    "Visual Content": "Visual Marketing",
}


def standard_names() -> dict[str, str]:
    return {**{name: name for name in DOMAIN}, **ALIASES}


def standard_category(c: ColumnLike, names: dict[str, str] | None = None) -> Column:
    """Standard name of a category or alias; unknown names are ``Other``.

    ``names`` replaces the standard table of names.
    """
    pairs = [F.lit(text) for pair in (names or standard_names()).items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), F.lit(OTHER))


def standard_categories(df: DataFrame, names: DataFrame, category: str = "category") -> DataFrame:
    """``standard_category`` with the names in a table ``alias, category`` of any size.

    An alias listed twice takes the first category by name; NULL stays unknown.
    """
    one = names.groupBy(F.col("alias").alias("_alias")).agg(F.min("category").alias("_standard"))
    found = df.join(one, F.col(category) == F.col("_alias"), "left")
    return found.withColumn(category, F.coalesce("_standard", F.lit(OTHER))).select(*df.columns)


def consolidate(c: ColumnLike, names: dict[str, str] | None = None) -> Column:
    """Standard names of a list of categories, distinct and sorted."""
    known = F.transform(or_empty(c), lambda x: standard_category(x, names))
    return F.sort_array(F.array_distinct(known))


def is_valid_category(c: ColumnLike) -> Column:
    return F.coalesce(col(c).isin(*DOMAIN), F.lit(False))


def normalize_label(c: ColumnLike) -> Column:
    """Trimmed label when it is a category, else ``Other``."""
    return let(strip(c), lambda label: F.when(is_valid_category(label), label).otherwise(OTHER))


# Question put to an external labeller; {domain}, {name}, {description} are filled in.
LABEL_QUESTION = (
    "Pick the one category that fits this listing best.\n"
    "Listing: {name}\nDescription: {description}\n"
    "Categories:\n{domain}\nAnswer with the category name only."
)


def label_prompt(name: ColumnLike, description: ColumnLike, template: str = LABEL_QUESTION,
                 max_chars: int | None = None) -> Column:
    """Question text for an external labelling step.

    The whole description is used unless ``max_chars`` is given.
    """
    text = col(description)
    if max_chars is not None:
        text = F.left(text, F.lit(max_chars))
    slots = {
        "{name}": F.coalesce(col(name), F.lit("")),
        "{description}": F.coalesce(text, F.lit("")),
        "{domain}": F.lit("\n".join(f"- {category}" for category in CATEGORIES)),
    }
    pieces = re.split(r"(\{(?:name|description|domain)\})", template)
    return F.concat(*[slots.get(piece, F.lit(piece)) for piece in pieces])
