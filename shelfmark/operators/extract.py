"""Records out of parsed pages. Every function is row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.base import each, first, let, strip
from shelfmark.functions.text import collapse_once
from shelfmark.functions.urls import asset_url
from shelfmark.operators.matching import FALLBACKS, REGISTRY, Page, Sel
from shelfmark.settings import SiteProfile

# Parts of a detail page.
DETAIL_AREA = Sel(classes=("tool-detail-information",))
FEATURE_AREA = Sel(classes=("features-list",))
HERO_AREA = Sel(classes=("tool-header",))
LOGO_AREA = Sel(classes=("tool-logo",))
QA_PAIR = Sel(classes=("qa-pair",), inside=Sel(classes=("faq-section",)))
VISIT_LINK = Sel(tags=("a",), attr="href", op="prefix", value="http",
                 holds=Sel(tags=("div",), classes=("visitWebsite",)))
META_DESCRIPTION = Sel(tags=("meta",), attr="name", op="equals", value="description")
GRID = Sel(tags=("div",), classes=("grid",))
GRID_ITEM = Sel(tags=("div",), child_of=GRID)
CARD = Sel(classes=("tool-item",))
CARD_NAME = Sel(classes=("go-tool-detail-name",))
CARD_NAME_LINK = Sel(tags=("a",), classes=("go-tool-detail-name",))
CARD_TOOL_LINK = Sel(tags=("a",), attr="href", op="prefix", value="/tool/")
IMAGE = Sel(tags=("img",))
ITEM_HEADING = Sel(tags=("h2", "h3", "h4"))
PARAGRAPH = Sel(tags=("p",))
BLOCK = Sel(tags=("div", "article"))

def _link_to(domain: str) -> Sel:
    return Sel(tags=("a",), attr="href", op="contains", value=domain)


def title(page: Page) -> Column:
    return page.first_text(Sel(tags=("title",)))


def social_links(page: Page, domains: tuple[str, ...]) -> Column:
    """Distinct sorted links to the domains, without share links."""
    hrefs = page.attr_values("href", *[_link_to(d) for d in domains])
    kept = F.filter(hrefs, lambda h: (h != "") & ~F.contains(h, F.lit("intent/tweet")))
    return F.sort_array(F.array_distinct(kept))


def platform_links(page: Page, container: Sel | None = None,
                   platforms: tuple[str, ...] = ("twitter", "linkedin")) -> Column:
    """Struct with one link per platform, ``N/A`` when absent.

    With ``container`` only links inside its first match count.
    """

    def links(scope: Column | None) -> Column:
        return F.struct(*[
            F.coalesce(page.first_attr("href", _link_to(f"{p}.com"), scope=scope), F.lit("N/A")).alias(f"{p}_link")
            for p in platforms
        ])

    if container is None:
        return links(None)
    return let(first(page.select(container)), links)


def features(page: Page, scope: Column | None = None) -> Column:
    """Non-blank feature texts; the fallback list when the main one is absent."""
    main = page.select_any(REGISTRY["features"], scope)
    other = page.select_any(FALLBACKS["features"], scope)

    def filled(elements: Column) -> Column:
        return F.transform(F.filter(elements, lambda e: e["ink"] > 0), page.joined)

    return F.when(F.size(main) > 0, filled(main)).otherwise(filled(other))


def dimension(value: Column) -> Column:
    """Pixel size out of an attribute, at least 1."""
    number = F.regexp_extract(F.coalesce(value, F.lit("")), r"^\s*([0-9]+(?:\.[0-9]+)?)", 1)
    return F.greatest(F.coalesce(number.try_cast("double"), F.lit(0.0)), F.lit(1.0))


def images(page: Page, area: Sel | None = None) -> Column:
    """Array of ``pos, src, alt, w, h`` for the images of a page or area."""

    def listed(scope: Column | None) -> Column:
        return F.transform(
            page.select(IMAGE, scope),
            lambda e: F.struct(
                e["pos"].alias("pos"),
                F.try_element_at(e["attrs"], F.lit("src")).alias("src"),
                F.coalesce(F.try_element_at(e["attrs"], F.lit("alt")), F.lit("")).alias("alt"),
                dimension(F.try_element_at(e["attrs"], F.lit("width"))).alias("w"),
                dimension(F.try_element_at(e["attrs"], F.lit("height"))).alias("h"),
            ),
        )

    if area is None:
        return listed(None)
    return let(first(page.select(area)), listed)


def details(parsed: DataFrame, site: SiteProfile, keep: tuple[str, ...] = ("page_id", "url"),
            reasons: bool = False) -> DataFrame:
    """One detail record per page that has a detail area; with ``reasons`` the other pages too, with ``parse_error``."""
    page = Page()
    shown = parsed.withColumn("_area", first(page.select(DETAIL_AREA)))
    if reasons:
        none = F.when(F.size("elements") == 0, "no page").when(F.col("_area").isNull(), "no detail area")
        shown = shown.withColumn("parse_error", F.coalesce("parse_error", none))
        keep = (*keep, "parse_error")
    else:
        shown = shown.filter(F.col("_area").isNotNull())
    named = shown.withColumn("name", page.first_text(Sel(tags=("h1",))))

    def shot(kind: str, part: Sel | None) -> Column:
        present = F.lit(True) if part is None else F.size(page.select(part)) > 0
        return F.when(F.col("name").isNotNull() & present, asset_url("name", kind, site.asset_url))

    shots = {"full": None, "content": DETAIL_AREA, "features": FEATURE_AREA, "hero": HERO_AREA}
    record = named.select(
        *keep,
        "name",
        *[shot(kind, part).alias(f"{kind}_screenshot_url") for kind, part in shots.items()],
        page.first_attr("content", META_DESCRIPTION).alias("meta_description"),
        collapse_once(page.text(F.col("_area"))).alias("full_description"),
        page.texts(*REGISTRY["features"]).alias("features"),
        social_links(page, ("twitter.com", "linkedin.com", "facebook.com", "instagram.com")).alias("social_links"),
        page.first_attr("href", *REGISTRY["pricing_link"]).alias("pricing_link"),
        page.first_attr("href", VISIT_LINK).alias("website"),
        images(page, DETAIL_AREA).alias("images"),
    )
    return record.withColumn("img_url", F.coalesce("content_screenshot_url", "full_screenshot_url"))


def faq(page: Page) -> Column:
    """Question and answer pairs; both parts must be there."""
    pairs = F.transform(
        page.select(QA_PAIR),
        lambda pair: F.struct(
            page.first_text(Sel(classes=("question",)), scope=pair).alias("question"),
            page.first_text(Sel(classes=("answer",)), scope=pair).alias("answer"),
        ),
    )
    return F.filter(pairs, lambda p: p["question"].isNotNull() & p["answer"].isNotNull())


def article_details(parsed: DataFrame, site: SiteProfile, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The detail record in its second form, with usage text and FAQ."""
    page = Page()
    in_area = Sel(tags=("p",), inside=DETAIL_AREA)
    usage = Sel(tags=("p",), after=Sel(text="How to use"))
    src = page.first_attr("src", Sel(tags=("img",), inside=LOGO_AREA))
    return parsed.filter(F.size(page.select(DETAIL_AREA)) > 0).select(
        *keep,
        page.text(first(page.select(Sel(tags=("h1",))))).alias("name"),
        page.first_text(in_area).alias("description"),
        page.first_text(usage).alias("how_to_use"),
        page.texts(*REGISTRY["features"]).alias("features"),
        social_links(page, ("twitter.com", "linkedin.com")).alias("social_links"),
        F.when((src != "") & ~F.endswith(src, F.lit(site.placeholder_image)), src).alias("image_url"),
        faq(page).alias("faq"),
    )


def _ranked(parsed: DataFrame, records: Column, keep: tuple[str, ...]) -> DataFrame:
    """One row per record of the array, numbered from 1 within the page."""
    numbered = F.transform(records, lambda r, i: F.struct((i + 1).alias("ordinal"), r.alias("record")))
    return parsed.select(*keep, each(numbered).alias("_r")).filter("_r IS NOT NULL").select(
        *keep, "_r.ordinal", "_r.record.*"
    )


def first_per_name(records: Column) -> Column:
    """Keep the first record of each name inside one page, by sorting twice."""
    ordered = F.array_sort(F.transform(records, lambda r, i: F.struct(r["name"].alias("name"), i.alias("at"), r.alias("r"))))

    def keep(by_name: Column) -> Column:
        firsts = F.filter(by_name, lambda x, i: (i == 0) | ~x["name"].eqNullSafe(F.get(by_name, i - 1)["name"]))
        return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["at"].alias("at"), x["r"].alias("r")))), lambda x: x["r"])

    return let(ordered, keep)


def cards(parsed: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Card records; a card without name or description is dropped."""
    page = Page()

    def record(card: Column) -> Column:
        link = page.first_attr("href", Sel(tags=("a",), attr="href"), scope=card)
        return F.struct(
            page.first_filled_text(*REGISTRY["name"], scope=card).alias("name"),
            page.first_filled_text(*REGISTRY["description"], scope=card).alias("description"),
            F.when(F.startswith(link, F.lit("http")), link).otherwise(strip(link)).alias("link"),
            strip(page.first_attr("src", *REGISTRY["image_url"], scope=card)).alias("image_url"),
        )

    found = F.transform(page.select_any(REGISTRY["tool_card"]), record)
    complete = F.filter(found, lambda r: r["name"].isNotNull() & r["description"].isNotNull())
    return _ranked(parsed, complete, keep)


def _listing(name: Column, description: Column, link: Column, site: SiteProfile) -> Column:
    """A base record with the constants a listing page does not show."""
    return F.struct(
        name.alias("name"),
        description.alias("description"),
        F.lit(site.grid_category).alias("category"),
        F.lit("N/A").alias("monthly_traffic"),
        F.lit(0.0).alias("rating"),
        F.lit("N/A").alias("image_url"),
        F.concat(F.lit(site.base_url), link).alias("pricing_link"),
        F.array().cast("array<string>").alias("social_links"),
        F.lit("N/A").alias("support_email"),
    )


def _paragraph(page: Page, scope: Column) -> Column:
    found = let(first(page.select(PARAGRAPH, scope)), lambda p: F.when(p.isNotNull(), page.joined(p)))
    return F.coalesce(found, F.lit("N/A"))


def grid_records(page: Page, site: SiteProfile) -> Column:
    """Records of the grid items with a heading and a listing link."""

    def record(item: Column) -> Column:
        heading = let(first(page.select(ITEM_HEADING, item)), lambda h: F.when(h.isNotNull(), page.joined(h)))
        link = page.first_attr("href", _link_to(site.listing_path), scope=item)
        return _listing(heading, _paragraph(page, item), link, site)

    return _usable(F.transform(page.select(GRID_ITEM), record))


def anchor_records(page: Page, site: SiteProfile) -> Column:
    """Records of listing links, described by the block around them."""

    def record(link: Column, blocks: Column) -> Column:
        return let(
            page.nearest(link, blocks),
            lambda block: F.when(
                block.isNotNull(),
                _listing(page.joined(link), block["paragraph"], F.try_element_at(link["attrs"], F.lit("href")), site),
            ),
        )

    links = page.select(_link_to(site.listing_path))
    # A block's paragraph is looked up once, not for every link in it.
    described = F.transform(page.select(BLOCK), lambda b: F.struct(
        b["pos"].alias("pos"), b["last_pos"].alias("last_pos"), _paragraph(page, b).alias("paragraph")))
    return _usable(let(described, lambda blocks: F.transform(links, lambda link: record(link, blocks))))


def _usable(records: Column) -> Column:
    named = F.filter(
        records, lambda r: r["name"].isNotNull() & (r["name"] != "") & r["pricing_link"].isNotNull()
    )
    return first_per_name(named)


def listings(parsed: DataFrame, site: SiteProfile, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Listing records: from the grid, and from links where there is no grid."""
    page = Page()

    def choose(grid: Column) -> Column:
        return F.when(F.size(grid) > 0, grid).otherwise(anchor_records(page, site))

    return _ranked(parsed, let(grid_records(page, site), choose), keep)


def tool_urls(parsed: DataFrame, site: SiteProfile) -> DataFrame:
    """Distinct absolute addresses of the detail pages named by cards."""
    page = Page()
    hrefs = F.transform(page.select(CARD), lambda card: page.first_attr("href", CARD_NAME_LINK, scope=card))
    links = F.filter(hrefs, lambda h: h != "")
    return parsed.select(each(links).alias("href")).filter("href IS NOT NULL").select(
        F.concat(F.lit(site.base_url), "href").alias("url")
    ).distinct()


def named_cards(parsed: DataFrame, site: SiteProfile, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Name and detail address of the cards that have both."""
    page = Page()

    def record(card: Column) -> Column:
        return F.struct(
            F.when(F.size(page.select(CARD_NAME, card)) > 0, page.first_text(CARD_NAME, scope=card)).alias("name"),
            F.concat(F.lit(site.base_url), page.first_attr("href", CARD_TOOL_LINK, scope=card)).alias("tool_url"),
        )

    found = F.filter(
        F.transform(page.select(CARD), record), lambda r: r["name"].isNotNull() & r["tool_url"].isNotNull()
    )
    return _ranked(parsed, found, keep)


def has_no_results(page: Page, site: SiteProfile) -> Column:
    """True for a listing page without grid items or with the marker text."""
    marker = Sel(text=site.no_results_text)
    return (F.size(page.select(GRID_ITEM)) == 0) | (F.size(page.select(marker)) > 0)


def fields_by(parsed: DataFrame, registry: dict[str, tuple[Sel, ...]],
              keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Text of the first match of each field, ``N/A`` when absent."""
    page = Page()
    return parsed.select(*keep, *[page.text_or(sels).alias(field) for field, sels in registry.items()])


def registry_fields(parsed: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Each registered field with its fallback, ``N/A`` when absent: the text, or the address of images and links."""
    page = Page()
    texts = ("tool_card", "name", "description", "category", "monthly_traffic", "rating", "pricing_model", "api_info")
    addresses = {"image_url": "src", **dict.fromkeys(
        ("pricing_link", "twitter_link", "facebook_link", "linkedin_link", "instagram_link", "support_email"), "href")}

    def address(field: str, attr: str) -> Column:
        return F.coalesce(page.first_attr(attr, *REGISTRY.get(field, ()), *FALLBACKS.get(field, ())), F.lit("N/A"))

    return parsed.select(
        *keep,
        *[page.text_or(REGISTRY[field], FALLBACKS.get(field, ())).alias(field) for field in texts],
        *[address(field, attr).alias(field) for field, attr in addresses.items()],
        features(page).alias("features"),
    )


def content_text(parsed: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Page text without script, style, iframe and noscript subtrees."""
    return parsed.select(*keep, F.array_join("runs", "").alias("content"))


def links(parsed: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per link of a page, in page order."""
    page = Page()
    found = F.transform(
        page.select(Sel(tags=("a",), attr="href")),
        lambda e: F.struct(F.try_element_at(e["attrs"], F.lit("href")).alias("href"), page.trimmed(e).alias("label")),
    )
    return _ranked(parsed, found, keep)
