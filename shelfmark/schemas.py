"""Record layouts, as field name to Spark type.

The field names are fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Layout = dict[str, str]

_TEXTS = "array<string>"

PAGES: Layout = {"page_id": "bigint", "url": "string", "html": "string"}

# A record as found on a detail page. ``social_links`` is JSON text: a list in
# fresh records, an object in formatted ones (see arrays.links_from_json).
RAW: Layout = {
    "name": "string", "full_description": "string", "description": "string", "short_description": "string",
    "meta_description": "string", "how_to_use": "string", "features": _TEXTS, "use_cases": _TEXTS,
    "social_links": "string", "links": "string", "support_email": "string", "pricing_link": "string",
    "website": "string", "image_url": "string", "img_url": "string", "logo_url": "string", "logo": "string",
    "category": "string",
}

CLEANED: Layout = {
    "name": "string", "full_description": "string", "description": "string", "features": _TEXTS,
    "social_links": _TEXTS, "support_email": "string", "pricing_link": "string", "image_url": "string",
    "category": "string",
}

FORMATTED: Layout = {
    "name": "string", "short_description": "string", "how_to_use": "string", "features": _TEXTS,
    "use_cases": _TEXTS,
    "social_links": "struct<website:string,discord:string,facebook:string,twitter:string,linkedin:string,"
                    "youtube:string,instagram:string>",
    "links": "struct<login:string,signup:string,pricing:string,contact:string>",
    "support_email": "string", "logo_url": "string", "img_url": "string", "category": "string",
}

# Export layout, in column order.
FLAT_COLUMNS = (
    "name", "category", "short_description", "how_to_use", "features", "use_cases", "social_links",
    "important_links", "support_email", "logo_url", "img_url",
)

CONFORMED: Layout = {
    "name": "string", "description": "string", "category": "string", "features": _TEXTS,
    "monthly_traffic": "string", "rating": "double", "image_url": "string", "twitter_link": "string",
    "linkedin_link": "string", "support_email": "string", "pricing_link": "string", "pricing_model": "string",
    "api_available": "boolean", "last_updated": "string",
}

DETAIL: Layout = {
    "page_id": "bigint", "url": "string", "name": "string", "full_screenshot_url": "string",
    "content_screenshot_url": "string", "features_screenshot_url": "string", "hero_screenshot_url": "string",
    "meta_description": "string", "full_description": "string", "features": _TEXTS, "social_links": _TEXTS,
    "pricing_link": "string", "website": "string", "img_url": "string", "logo_url": "string", "category": "string",
}


def ddl(layout: Layout) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in layout.items())


def with_columns_of(df: DataFrame, layout: Layout) -> DataFrame:
    """Add the columns of ``layout`` that ``df`` lacks, as NULL."""
    missing = {name: F.lit(None).cast(kind) for name, kind in layout.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df
