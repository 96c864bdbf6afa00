"""Pages to catalogue records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import extract, logos
from shelfmark.operators.elements import DEFAULT_ATTRS, parse_pages
from shelfmark.operators.rules import RuleSet, category_of
from shelfmark.operators.matching import Page
from shelfmark.schemas import DETAIL
from shelfmark.settings import SiteProfile
from shelfmark.sources.progress import Progress
from shelfmark.streaming.ingest import run_batch


def update(pages: DataFrame, progress: Progress, site: SiteProfile, rules: RuleSet | None = None,
           own_sites: DataFrame | None = None) -> int:
    """Add the pages that are new to the stored catalogue; gives the batch number.

    ``progress`` stores the DETAIL layout. Pages without a detail area are not
    marked as done and are tried again with the next batch.
    """
    return run_batch(pages, progress, lambda new: detail_records(new, site, rules, own_sites, reasons=True))


def detail_records(pages: DataFrame, site: SiteProfile, rules: RuleSet | None = None,
                   own_sites: DataFrame | None = None, reasons: bool = False) -> DataFrame:
    """Full detail records of raw pages.

    With ``reasons`` there is a row for every page, and ``parse_error`` says why one has no record.

    The logo is the best image of the listing's own site when ``own_sites``
    (``url, html``) holds its page, else the best image of the detail area.
    """
    found = extract.details(parse_pages(pages, DEFAULT_ATTRS), site, reasons=reasons)
    shown = logos.best_in_page(F.col("images"), F.col("name"), F.lit(site.base_url), site.image_host)
    if own_sites is None:
        logo = shown
    else:
        # Of a site stored twice the page with the most images counts. Records without a
        # site get a key of their own, so they do not meet in one task.
        images = extract.images(Page())
        pictures = parse_pages(own_sites, DEFAULT_ATTRS, keep=("url",)).groupBy(F.col("url").alias("_site")).agg(
            F.max(F.struct(F.size(images).alias("n"), images.alias("images")))["images"].alias("_site_images")
        )
        site_key = F.coalesce("website", F.concat(F.lit("none:"), F.xxhash64("page_id", "url").cast("string")))
        found = found.join(pictures, site_key == F.col("_site"), "left")
        logo = F.coalesce(logos.best_in_page(F.col("_site_images"), F.col("name"), F.col("website")), shown)
    described = F.when(
        F.col("full_description") != "", category_of(F.col("name"), F.col("full_description"), rules)
    )
    return found.withColumn("logo_url", logo).withColumn("category", described).select(
        *DETAIL, *(["parse_error"] if reasons else []))
