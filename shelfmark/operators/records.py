"""Record-level cleaning, formatting and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import arrays, sections, text, urls
from shelfmark.functions.base import first_filled, strip
from shelfmark.functions.labels import OTHER
from shelfmark.operators.rules import RuleSet, category_of
from shelfmark.schemas import CLEANED, FLAT_COLUMNS, FORMATTED, RAW, with_columns_of
from shelfmark.settings import SiteProfile


def clean(df: DataFrame, site: SiteProfile, rules: RuleSet | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` plus the nine kept fields, cleaned; missing categories are
    worked out from name and description.

    ``social_links`` may be an array of links; see arrays.links_from_json for
    records where it is JSON text.
    """
    raw = with_columns_of(df, CLEANED)

    def blanked(field: str) -> Column:
        placeholder = site.placeholders.get(field)
        value = F.col(field)
        return F.when(value == placeholder, "").otherwise(value) if placeholder else value

    staged = raw.select(
        *keep,
        "name",
        text.without_qa_markers("full_description").alias("full_description"),
        text.without_qa_markers("description").alias("description"),
        arrays.or_empty("features").alias("features"),
        arrays.http_only("social_links").alias("social_links"),
        *[blanked(f).alias(f) for f in ("support_email", "pricing_link", "image_url")],
        "category",
    )
    described = F.col("full_description").isNotNull() | F.col("description").isNotNull()
    worked_out = F.when(
        F.col("name").isNotNull() & described,
        category_of("name", first_filled("full_description", "description"), rules),
    ).otherwise(OTHER)
    return staged.withColumn("category", F.coalesce("category", worked_out))


def format_records(df: DataFrame, site: SiteProfile, rules: RuleSet | None = None,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` plus the nested record: sections, links, category."""
    raw = with_columns_of(df, RAW)

    def address(*fields: str) -> Column:
        return urls.clean_url(first_filled(*fields), site.base_url, site.placeholder_image)

    staged = raw.select(
        *keep,
        strip(F.coalesce("name", F.lit(""))).alias("name"),
        first_filled("full_description", "description").alias("_text"),
        address("website").alias("_website"),
        address("pricing_link").alias("_pricing"),
        text.email_address(F.coalesce("support_email", F.lit("")), site.placeholder_email).alias("support_email"),
        address("logo_url").alias("logo_url"),
        address("img_url", "image_url").alias("img_url"),
    )
    link = sections.link_columns("_text")
    parts = staged.select(
        "*",
        sections.short_description("_text").alias("short_description"),
        sections.how_to_use("_text").alias("how_to_use"),
        sections.features("_text").alias("features"),
        sections.use_cases("_text").alias("use_cases"),
        F.struct(
            F.col("_website").alias("website"), *[link[name].alias(name) for name in sections.PROFILE_LINKS]
        ).alias("social_links"),
        F.struct(
            link["login"].alias("login"), link["signup"].alias("signup"), F.col("_pricing").alias("pricing"),
            link["contact"].alias("contact"),
        ).alias("links"),
    )
    named = parts.withColumn("category", category_of("name", "short_description", rules))
    return named.select(*keep, *FORMATTED)


def struct_map(df: DataFrame, field: str) -> Column:
    """A struct of texts as a map, in field order."""
    names = df.schema[field].dataType.names
    return F.create_map(*[c for n in names for c in (F.lit(n), F.col(f"{field}.{n}"))])


def flatten(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` plus the eleven text columns of the export.

    ``social_links`` and ``links`` may be structs, maps, arrays or JSON text.
    """
    raw = with_columns_of(df, RAW)

    def links(field: str) -> Column:
        kind = raw.schema[field].dataType.typeName()
        if kind == "struct":
            return arrays.link_map_text(struct_map(raw, field))
        if kind == "map":
            return arrays.link_map_text(field)
        if kind == "array":
            return arrays.join_list(F.filter(field, lambda u: F.startswith(u, F.lit("http"))))
        return arrays.links_from_json(field)["as_text"]

    logo_fields = ("logo_url", "image_url", "logo", "img_url")
    values = {
        "short_description": first_filled("short_description", "meta_description"),
        "features": arrays.join_list("features"),
        "use_cases": arrays.join_list("use_cases"),
        "social_links": links("social_links"),
        "important_links": links("links"),
        "logo_url": arrays.nth_http(1, *logo_fields),
        "img_url": arrays.nth_http(2, *logo_fields),
    }
    return raw.select(
        *keep, *[(values[c] if c in values else first_filled(c)).alias(c) for c in FLAT_COLUMNS]
    )
