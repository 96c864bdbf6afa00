"""The registered queries: every operator on the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import arrays, labels, sections, text, urls
from shelfmark.functions.base import first_filled, strip
from shelfmark.operators import extract, logos, merge, quality, records, rules, summary
from shelfmark.operators.elements import explode_elements, parse_pages, register_html_elements
from shelfmark.operators.matching import Page, Sel, selectors_from
from shelfmark.plans import inputs
from shelfmark.plans.catalogue import detail_records
from shelfmark.schemas import FLAT_COLUMNS
from shelfmark.settings import SiteProfile
from shelfmark.sources.keys import KeyIndex
from shelfmark.sources.progress import Progress, Retries
from shelfmark.sources.summaries import Summaries
from shelfmark.sources import writers
from shelfmark.sources.readers import listing_pages, read_html_files, read_records
from shelfmark.streaming.ingest import distinct_pages, run_batch, shared_folder, start_stream

SITE = SiteProfile()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _items(csv: str) -> Column:
    return F.split(csv, ";")


def _sorted_text(array: Column) -> Column:
    return F.array_join(F.sort_array(array), "|")


# -- text ------------------------------------------------------------------
@query
def clean_match_text(spark, sf_dir):
    docs = inputs.wide_table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.match_text("text").alias("match_text"))


@query
def clean_display_text(spark, sf_dir):
    docs = inputs.wide_table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.display_text("text").alias("display_text"))


@query
def clean_description(spark, sf_dir):
    tools = inputs.wide_listings(spark, sf_dir)
    docs = inputs.wide_table(spark, sf_dir, "documents")
    both = tools.select(F.col("tool_id").alias("id"), F.lit("listing").alias("kind"), F.col("full_description").alias("raw"))
    both = both.union(docs.select("doc_id", F.lit("document"), "text"))
    return both.select("id", "kind", text.description_text("raw").alias("description"))


@query
def strip_qa_markers(spark, sf_dir):
    raw = F.concat(F.replace(F.col("full_description"), F.lit(" end "), F.lit(" end\n")), F.lit(" Q3 A3 tail"))
    return inputs.listings(spark, sf_dir).select("tool_id", text.without_qa_markers(raw).alias("description"))


@query
def clean_email(spark, sf_dir):
    email = F.coalesce("support_email", F.lit(""))
    return inputs.listings(spark, sf_dir).select(
        "tool_id", text.email_address(email, SITE.placeholder_email).alias("email"),
        text.email_address(email, "a@b.co").alias("email_without_placeholder"),
    )


@query
def clean_url(spark, sf_dir):
    return inputs.listings(spark, sf_dir).select(
        "tool_id", urls.clean_url("image_url", SITE.base_url, SITE.placeholder_image).alias("image_url"),
        urls.clean_url("pricing_link", SITE.base_url, SITE.placeholder_image).alias("pricing_link"),
    )


@query
def slugify(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.slug("text").alias("slug"))


@query
def asset_names(spark, sf_dir):
    address = urls.asset_url(F.concat("name", F.lit(" / "), F.col("tool_id")), "full", SITE.asset_url)
    return inputs.listings(spark, sf_dir).select("tool_id", address.alias("asset_url")).withColumn(
        "file_name", urls.base_name("asset_url")
    )


@query
def collapse_once(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    spread = F.replace(F.col("text"), F.lit(". "), F.lit(".   \n "))
    return docs.select("doc_id", text.collapse_once(spread).alias("text"))


@query
def strip_text(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    padded = F.concat(F.lit(" \t  "), F.col("text"), F.lit("  \r\n　"))
    return docs.select("doc_id", strip(padded).alias("text"))


@query
def absolute_urls(spark, sf_dir):
    page = F.concat(F.lit("https://h"), F.col("tool_id"), F.lit(".example.com:8080/p/q?x=1"))
    images = inputs.images(spark, sf_dir)
    dotted = F.when(F.col("pos") == 2, F.concat(F.lit("./"), F.col("alt"), F.lit(".png"))).otherwise(F.col("src"))
    return images.select("tool_id", "pos", urls.absolute_url(dotted, page).alias("src"))


@query
def extract_first_link(spark, sf_dir):
    return inputs.listings(spark, sf_dir).select(
        "tool_id",
        text.linked("full_description", r"www\.linkedin\.com/company/[a-z0-9]+").alias("whole_match"),
        text.linked("full_description", r"login link: (https://[^ ]+)").alias("group_match"),
        text.linked("full_description", r"mastodon\.social/([^ ]+)").alias("no_match"),
    )


@query
def label_prompts(spark, sf_dir):
    return inputs.listings(spark, sf_dir).select(
        "tool_id", labels.label_prompt("name", "full_description").alias("prompt")
    )


# -- sections --------------------------------------------------------------
@query
def sections_text(spark, sf_dir):
    return inputs.wide_listings(spark, sf_dir).select(
        "tool_id",
        sections.short_description("full_description").alias("short_description"),
        sections.how_to_use("full_description").alias("how_to_use"),
    )


@query
def sections_features(spark, sf_dir):
    items = sections.features("full_description")
    return inputs.wide_listings(spark, sf_dir).select("tool_id", F.array_join(items, "|").alias("features"))


@query
def sections_use_cases(spark, sf_dir):
    items = sections.use_cases("full_description")
    return inputs.wide_listings(spark, sf_dir).select("tool_id", F.array_join(items, "|").alias("use_cases"))


@query
def section_links(spark, sf_dir):
    extra = F.concat(
        F.col("full_description"),
        F.lit(" DISCORD.GG/d"), F.col("tool_id"), F.lit(" facebook.com/f\" youtube.com/@y Instagram.com/i/"),
        F.when(F.col("tool_id") % 2 == 0, F.lit(" Sign up Link:https://app.example.com/up")).otherwise(""),
    )
    tools = inputs.wide_listings(spark, sf_dir).select("tool_id", extra.alias("raw"))
    return tools.select(
        "tool_id", *[link.alias(f"{name}_link") for name, link in sections.link_columns("raw").items()]
    )


# -- classification --------------------------------------------------------
DEFAULT = rules.RuleSet.default()


@query
def classify_default_rules(spark, sf_dir):
    return inputs.wide_listings(spark, sf_dir).select(
        "tool_id", rules.category_of("name", "full_description", DEFAULT).alias("category")
    )


@query
def classify_documents(spark, sf_dir):
    found = rules.verdict("source", "text", DEFAULT)
    docs = inputs.wide_table(spark, sf_dir, "documents").select("doc_id", found.alias("v"))
    return docs.select("doc_id", "v.category", "v.score")


@query
def classify_custom_rules(spark, sf_dir):
    docs = inputs.wide_table(spark, sf_dir, "documents")
    return rules.classify(docs, "doc_id", "source", "text", inputs.test_rules(spark), "none")


@query
def classify_by_rule_join(spark, sf_dir):
    docs = inputs.wide_table(spark, sf_dir, "documents")
    return rules.best_by_join(docs, "doc_id", "source", "text", inputs.test_rules(spark), "none")


@query
def scores_by_rule_join(spark, sf_dir):
    docs = inputs.wide_table(spark, sf_dir, "documents")
    return rules.category_scores_by_join(docs, "doc_id", "source", "text", inputs.test_rules(spark))


@query
def classify_scores(spark, sf_dir):
    return rules.category_scores(inputs.wide_listings(spark, sf_dir), "tool_id", "name", "full_description", DEFAULT)


@query
def classify_explain(spark, sf_dir):
    return rules.explain_matches(inputs.wide_listings(spark, sf_dir), "tool_id", "name", "full_description", DEFAULT)


# -- lists, maps, labels ---------------------------------------------------
@query
def clean_features(spark, sf_dir):
    return inputs.listings(spark, sf_dir).select(
        "tool_id", F.array_join(arrays.clean_features(_items("features_csv")), "|").alias("features")
    )


@query
def clean_social_links(spark, sf_dir):
    return inputs.listings(spark, sf_dir).select(
        "tool_id", _sorted_text(arrays.clean_social_links(_items("links_csv"))).alias("links")
    )


@query
def consolidate_categories(spark, sf_dir):
    return inputs.listings(spark, sf_dir).select(
        "tool_id", F.array_join(labels.consolidate(_items("categories_csv")), "|").alias("categories")
    )


@query
def normalize_label(spark, sf_dir):
    answer = F.concat(F.lit("\t"), F.element_at(_items("categories_csv"), -1), F.lit(" \n"))
    chosen = F.when(F.col("tool_id") % 3 == 0, F.lit(" Visual Marketing ")).otherwise(answer)
    return inputs.listings(spark, sf_dir).select("tool_id", labels.normalize_label(chosen).alias("label"))


@query
def link_map_to_text(spark, sf_dir):
    links = F.create_map(
        F.lit("site"), F.concat(F.lit("http://s.example/"), F.col("tool_id")),
        F.lit("mail"), F.lit("mailto:z"), F.lit("image"), F.col("image_url"), F.lit("price"), F.col("pricing_link"),
    )
    return inputs.listings(spark, sf_dir).select("tool_id", arrays.link_map_text(links).alias("links"))


@query
def polymorphic_links(spark, sf_dir):
    links = arrays.links_from_json("links_json")
    return inputs.listings(spark, sf_dir).select(
        "tool_id", links["as_text"].alias("links"), links["as_map"].isNotNull().alias("is_map"),
        links["as_list"].isNotNull().alias("is_list"),
    )


@query
def first_http_urls(spark, sf_dir):
    fields = ("image_url", "pricing_link", "support_email")
    return inputs.listings(spark, sf_dir).select(
        "tool_id", arrays.nth_http(1, *fields).alias("first_url"), arrays.nth_http(2, *fields).alias("second_url")
    )


@query
def join_feature_list(spark, sf_dir):
    some = F.when(F.col("tool_id") % 7 != 0, _items("features_csv"))
    return inputs.listings(spark, sf_dir).select("tool_id", arrays.join_list(some).alias("features"))


@query
def parse_replies(spark, sf_dir):
    reply = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), F.col("props"), F.lit(", {\"k\": -1}]")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("oops "), F.col("props")))
        .when(F.col("event_id") % 4 == 2, F.lit("[]"))
        .otherwise(F.concat(F.lit(" "), F.col("props")))
    )
    events = inputs.table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    return events.select("event_id", arrays.parse_reply("reply", "k bigint")["k"].alias("k"))


# -- records ---------------------------------------------------------------
def _raw_listings(spark, sf_dir) -> DataFrame:
    return inputs.wide_listings(spark, sf_dir).select(
        "tool_id", "name", "full_description", "support_email", "pricing_link", "image_url", "rating",
        _items("features_csv").alias("features"), _items("links_csv").alias("social_links"),
    )


@query
def clean_records(spark, sf_dir):
    raw = _raw_listings(spark, sf_dir).withColumn(
        "category", F.when(F.col("tool_id") % 2 == 0, "Given")
    ).withColumn("name", F.when(F.col("tool_id") % 11 != 0, F.col("name")))
    cleaned = records.clean(raw, SITE, DEFAULT, keep=("tool_id",))
    return cleaned.withColumns({
        "features": F.array_join("features", "|"), "social_links": F.array_join("social_links", "|"),
    })


@query
def format_records(spark, sf_dir):
    raw = inputs.wide_listings(spark, sf_dir).select(
        "tool_id", F.concat(F.lit(" "), "name", F.lit("\t")).alias("name"), "full_description", "support_email",
        "pricing_link", "image_url", F.when(F.col("tool_id") % 2 == 0, F.col("image_url")).alias("img_url"),
        F.lit("/logo.png").alias("logo_url"),
    )
    shaped = records.format_records(raw, SITE, DEFAULT, keep=("tool_id",))
    return shaped.select(
        "tool_id", "name", "short_description", "how_to_use", F.array_join("features", "|").alias("features"),
        F.array_join("use_cases", "|").alias("use_cases"),
        F.col("social_links.website").alias("website"), F.col("social_links.twitter").alias("twitter"),
        F.col("social_links.linkedin").alias("linkedin"), F.col("links.login").alias("login"),
        F.col("links.pricing").alias("pricing"), F.col("links.contact").alias("contact"),
        "support_email", "logo_url", "img_url", "category",
    )


def _flat(spark, sf_dir) -> DataFrame:
    raw = _raw_listings(spark, sf_dir).drop("rating").withColumn("logo_url", F.lit("https://cdn.example.com/logo.png"))
    return records.flatten(records.format_records(raw, SITE, DEFAULT, keep=("tool_id",)), keep=("tool_id",))


@query
def flatten_records(spark, sf_dir):
    return _flat(spark, sf_dir)


@query
def coalesce_fields(spark, sf_dir):
    return inputs.listings(spark, sf_dir).select(
        "tool_id", first_filled("image_url", "support_email").alias("image_or_email"),
        first_filled("pricing_link", "rating").alias("pricing_or_rating"),
    )


@query
def column_profile(spark, sf_dir):
    return summary.column_profile(_flat(spark, sf_dir), *FLAT_COLUMNS)


# -- quality ---------------------------------------------------------------
@query
def complete_records(spark, sf_dir):
    return inputs.listings(spark, sf_dir).select(
        "tool_id", quality.is_complete(("name", "support_email", "pricing_link")).alias("complete")
    )


@query
def placeholder_values(spark, sf_dir):
    marks = {"image_url": "/img/a.png"}
    return inputs.listings(spark, sf_dir).select(
        "tool_id", quality.is_placeholder("image_url", F.col("image_url"), marks).alias("image_is_placeholder"),
        quality.is_placeholder("rating", F.col("rating"), marks).alias("rating_is_placeholder"),
    )


def _candidates(spark, sf_dir) -> DataFrame:
    linked = F.create_map(F.lit("twitter"), F.lit("N/A"), F.lit("linkedin"), F.lit("x"))
    partial = F.create_map(F.lit("twitter"), F.lit("N/A"))
    return inputs.listings(spark, sf_dir).select(
        "tool_id", F.when(F.col("tool_id") % 19 != 0, F.col("name")).alias("name"),
        F.when(F.col("tool_id") % 23 == 0, "N/A").otherwise("").alias("description"),
        "rating", "image_url", "pricing_link", "support_email",
        F.when(F.col("tool_id") % 29 != 0, linked).otherwise(partial).alias("social_links"),
    )


@query
def validate_records(spark, sf_dir):
    return quality.validate(_candidates(spark, sf_dir)).select(
        "tool_id", F.array_join("failed_rules", "|").alias("failed_rules"), "valid"
    )


@query
def valid_and_rejected(spark, sf_dir):
    good, bad = quality.split_valid(quality.validate(_candidates(spark, sf_dir)))
    return good.select("tool_id", F.lit("valid").alias("state")).union(bad.select("tool_id", F.lit("rejected")))


@query
def conform_records(spark, sf_dir):
    raw = inputs.listings(spark, sf_dir).select(
        "tool_id", F.when(F.col("tool_id") % 19 != 0, F.col("name")).alias("name"),
        F.col("full_description").alias("description"), "rating", "image_url", "pricing_link", "support_email",
        F.when(F.col("tool_id") % 3 == 0, "true").when(F.col("tool_id") % 3 == 1, "maybe").alias("api_available"),
    )
    return quality.conform(raw).withColumns({
        "features": F.array_join("features", "|"), "violations": F.array_join("violations", "|"),
    })


@query
def valid_categories(spark, sf_dir):
    names = inputs.listings(spark, sf_dir).select(F.explode(_items("categories_csv")).alias("category")).distinct()
    domain = spark.createDataFrame([(c,) for c in labels.DOMAIN], "category string")
    return names.union(domain).distinct().select("category", labels.is_valid_category("category").alias("valid"))


# -- summaries -------------------------------------------------------------
def _categorised(spark, sf_dir) -> DataFrame:
    category = rules.category_of("name", sections.short_description("full_description"), DEFAULT)
    return inputs.wide_listings(spark, sf_dir).select(
        "tool_id", "name", F.when(F.col("tool_id") % 10 != 3, category).alias("category")
    )


@query
def category_counts(spark, sf_dir):
    return summary.category_counts(_categorised(spark, sf_dir))


@query
def tools_by_category(spark, sf_dir):
    return summary.by_category(_categorised(spark, sf_dir)).select("category", "tool_id", "name", "n_in_category")


@query
def category_summary(spark, sf_dir):
    return summary.category_summary(_categorised(spark, sf_dir))


def _frontier(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pages = inputs.table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.union(pages.filter("url LIKE '%?%'")), pages.filter("url LIKE 'https:%'")


@query
def run_metrics(spark, sf_dir):
    return summary.run_metrics(*_frontier(spark, sf_dir))


@query
def distinct_names(spark, sf_dir):
    return inputs.listings(spark, sf_dir).select("name").distinct()


# -- joins and set operations ----------------------------------------------
@query
def frontier_minus_processed(spark, sf_dir):
    return merge.remaining(*_frontier(spark, sf_dir))


@query
def mark_processed(spark, sf_dir):
    frontier, processed = _frontier(spark, sf_dir)
    return merge.mark_processed(processed, frontier.filter("url LIKE '%#%'"))


@query
def dedup_first_by_name(spark, sf_dir):
    return merge.first_by(inputs.listings(spark, sf_dir), "name", "tool_id").select("name", "tool_id", "full_description")


@query
def unseen_names(spark, sf_dir):
    tools = inputs.listings(spark, sf_dir).select("tool_id", "name", "rating")
    return merge.unseen(tools, tools.filter("rating = 'bad'"), "name", "tool_id").select("name", "tool_id")


@query
def first_k_per_name(spark, sf_dir):
    tools = inputs.listings(spark, sf_dir).select("tool_id", "name")
    return merge.first_k(tools, "name", 5, "tool_id").select("name", "tool_id")


@query
def overlay_enrichment(spark, sf_dir):
    tools = inputs.listings(spark, sf_dir)
    base = tools.select("tool_id", F.col("full_description").alias("description"), F.lit("Base").alias("category"))
    enriched = tools.filter("pricing_link IS NOT NULL").select(
        "tool_id", F.when(F.col("support_email").isNotNull(), F.upper("full_description")).alias("description"),
        F.lit("New").alias("category"),
    )
    return merge.overlay(base, enriched, "tool_id", ["description", "category"])


@query
def fallback_source(spark, sf_dir):
    pages = inputs.table(spark, sf_dir, "pages").select("page_id", "url")
    primary = pages.filter("url LIKE 'https:%'").withColumn("method", F.lit("A"))
    return merge.fallback_source(primary, pages.withColumn("method", F.lit("B")), "page_id")


@query
def append_records(spark, sf_dir):
    tools = inputs.listings(spark, sf_dir)
    return merge.append(
        tools.filter("rating <> 'bad'").select("tool_id", "name"), tools.filter("rating = 'bad'").select("tool_id", "rating")
    )


@query
def listing_page_sequence(spark, sf_dir):
    per_nation = inputs.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.ceil(F.count("*") / 20).cast("int").alias("n_pages")
    )
    bases = per_nation.withColumn("base_url", F.concat(F.lit("https://directory.example.com/nation/"), F.col("c_nationkey")))
    return listing_pages(bases).select("c_nationkey", "page_no", "url")


# -- files written and read again ------------------------------------------
def _folder(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, f"shelfmark-{name}-{uuid.uuid4().hex}")


@query
def json_round_trip(spark, sf_dir):
    shaped, path = format_records(spark, sf_dir), _folder(spark, "json")
    writers.write_json(shaped, path)
    return spark.read.schema(shaped.schema).json(path)


@query
def csv_round_trip(spark, sf_dir):
    flat, path = _flat(spark, sf_dir), _folder(spark, "csv")
    writers.write_csv(flat, path)
    back = spark.read.schema(flat.schema).options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    return back.na.fill("")


@query
def category_folders(spark, sf_dir):
    path = _folder(spark, "folders")
    writers.write_by_category(_categorised(spark, sf_dir), path)
    return summary.category_counts(spark.read.parquet(path))


@query
def sorted_json_keys(spark, sf_dir):
    tools = writers.sorted_fields(inputs.listings(spark, sf_dir).select("tool_id", "name", "rating"))
    return tools.select("tool_id", F.to_json(F.struct(*tools.columns)).alias("record"))


@query
def text_preview(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", text.preview("text", 80).alias("preview"))


@query
def html_files(spark, sf_dir):
    folders = writers.write_html_files(inputs.table(spark, sf_dir, "pages"), _folder(spark, "html"))
    pages = read_html_files(spark, folders).withColumn(
        "page_id", F.regexp_extract("url", "page_id=([0-9]+)", 1).cast("bigint"))
    return parse_pages(pages).select("page_id", extract.title(Page()).alias("title"))


@query
def aliases_by_table(spark, sf_dir):
    names = spark.createDataFrame(list(labels.standard_names().items()), "alias string, category string")
    return labels.standard_categories(
        inputs.listings(spark, sf_dir).select("tool_id", F.explode(_items("categories_csv")).alias("category")), names)


# -- pages -----------------------------------------------------------------
def _parsed(spark, sf_dir) -> DataFrame:
    return parse_pages(inputs.wide_table(spark, sf_dir, "pages"))


@query
def page_title(spark, sf_dir):
    page = Page()
    return _parsed(spark, sf_dir).select(
        "page_id", extract.title(page).alias("title"), page.first_text(Sel(tags=("h1",))).alias("heading")
    )


@query
def page_links(spark, sf_dir):
    found = extract.links(_parsed(spark, sf_dir))
    return found.select(
        "page_id", "ordinal", "href", "label", urls.absolute_url("href", "url").alias("absolute_href")
    )


@query
def page_paragraphs(spark, sf_dir):
    page = Page()
    found = F.transform(page.select(Sel(tags=("p",), inside=Sel(tags=("article",)))), page.text)
    return _parsed(spark, sf_dir).select("page_id", F.posexplode(found).alias("ordinal", "text"))


@query
def strip_non_content(spark, sf_dir):
    return extract.content_text(_parsed(spark, sf_dir)).select("page_id", "content")


@query
def page_tag_counts(spark, sf_dir):
    rows = explode_elements(_parsed(spark, sf_dir), "page_id")
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query
def page_elements_by_sql(spark, sf_dir):
    register_html_elements(spark)
    return spark.sql(
        "SELECT p.page_id, e.text FROM {pages} p, LATERAL html_elements(p.html) e WHERE e.tag = 'h1'",
        pages=inputs.table(spark, sf_dir, "pages").select("page_id", "html"),
    )


def _detail(spark, sf_dir) -> DataFrame:
    return parse_pages(inputs.detail_pages(spark, sf_dir))


def _lists(spark, sf_dir) -> DataFrame:
    return parse_pages(inputs.list_pages(spark, sf_dir))


@query
def page_details(spark, sf_dir):
    found = extract.details(_detail(spark, sf_dir), SITE)
    return found.drop("url", "images").withColumns({
        "features": F.array_join("features", "|"), "social_links": F.array_join("social_links", "|"),
    })


@query
def page_details_with_faq(spark, sf_dir):
    found = extract.article_details(_detail(spark, sf_dir), SITE)
    faq = F.array_join(F.transform("faq", lambda f: F.concat(f["question"], F.lit("="), f["answer"])), "|")
    return found.drop("url").withColumns({
        "features": F.array_join("features", "|"), "social_links": F.array_join("social_links", "|"), "faq": faq,
    })


@query
def heading_sibling_text(spark, sf_dir):
    usage = Sel(tags=("p",), after=Sel(text="How to use"))
    return _detail(spark, sf_dir).select("page_id", Page().first_text(usage).alias("how_to_use"))


@query
def page_images(spark, sf_dir):
    found = _detail(spark, sf_dir).select("page_id", F.posexplode(extract.images(Page())).alias("ordinal", "i"))
    return found.select("page_id", "ordinal", "i.src", "i.alt", "i.w", "i.h")


@query
def social_links_by_domain(spark, sf_dir):
    links = extract.social_links(Page(), ("twitter.com", "linkedin.com", "facebook.com", "instagram.com"))
    return _detail(spark, sf_dir).select("page_id", F.array_join(links, "|").alias("social_links"))


@query
def platform_links(spark, sf_dir):
    page = Page()
    return _detail(spark, sf_dir).select(
        "page_id", extract.platform_links(page).alias("all"),
        extract.platform_links(page, Sel(classes=("tool-header",))).alias("header"),
    ).select("page_id", "all.*", F.col("header.twitter_link").alias("header_twitter_link"))


@query
def catalogue_records(spark, sf_dir):
    pages = inputs.detail_pages(spark, sf_dir)
    own = inputs.own_sites(spark, sf_dir)
    return detail_records(pages, SITE, DEFAULT, own).withColumns({
        "features": F.array_join("features", "|"), "social_links": F.array_join("social_links", "|"),
    })


@query
def card_records(spark, sf_dir):
    return extract.cards(_lists(spark, sf_dir)).drop("url")


@query
def card_urls(spark, sf_dir):
    return extract.tool_urls(_lists(spark, sf_dir), SITE)


@query
def named_cards(spark, sf_dir):
    return extract.named_cards(_lists(spark, sf_dir), SITE).drop("url")


@query
def first_cards_per_page(spark, sf_dir):
    return extract.cards(_lists(spark, sf_dir)).filter("ordinal <= 1").select("page_id", "ordinal", "name")


@query
def listing_records(spark, sf_dir):
    return extract.listings(_lists(spark, sf_dir), SITE).select(
        "page_id", "ordinal", "name", "description", "category", "rating", "image_url", "pricing_link", "support_email"
    )


@query
def pages_without_results(spark, sf_dir):
    return _lists(spark, sf_dir).select("page_id", extract.has_no_results(Page(), SITE).alias("no_results"))


@query
def registry_fields(spark, sf_dir):
    return extract.registry_fields(_lists(spark, sf_dir)).drop("url").withColumn("features", F.array_join("features", "|"))


@query
def fields_by_selector_table(spark, sf_dir):
    """Fields whose selectors are rows of a table; two of a field are tried by priority."""
    table = spark.createDataFrame([
        ("title", 1, "title", None, None), ("lead", 1, None, "no-such-class", None), ("lead", 2, "h1 h2", None, None),
        ("notice", 1, "div", "ad", None), ("first_entry", 1, "a", None, "li"), ("price", 1, "span", "price", None),
    ], "field string, priority int, tag string, class_name string, parent_tag string")
    parsed = parse_pages(inputs.table(spark, sf_dir, "pages"))
    return extract.fields_by(parsed, selectors_from(table)).drop("url")


# -- logos -----------------------------------------------------------------
def _external(spark, sf_dir) -> DataFrame:
    return logos.candidates(inputs.images(spark, sf_dir), "tool_id", F.lit("https://shop.example.com/x"))


def _directory(spark, sf_dir) -> DataFrame:
    return logos.candidates(inputs.images(spark, sf_dir), "tool_id", F.lit(SITE.base_url), "x.example.com")


@query
def logo_candidates(spark, sf_dir):
    return _external(spark, sf_dir)


@query
def logo_candidates_directory(spark, sf_dir):
    return _directory(spark, sf_dir)


@query
def best_logo(spark, sf_dir):
    return logos.best(_external(spark, sf_dir), "tool_id")


@query
def logo_with_fallback(spark, sf_dir):
    tools = inputs.listings(spark, sf_dir).select("tool_id")
    return logos.with_fallback(tools, _external(spark, sf_dir), _directory(spark, sf_dir), "tool_id")


# -- incremental -----------------------------------------------------------
def _titles(pages: DataFrame) -> DataFrame:
    """Work of the incremental queries; a page without a title fails."""
    return parse_pages(pages).select("page_id", "url", extract.title(Page()).alias("name")).filter("name IS NOT NULL")


_STORED = {"page_id": "bigint", "url": "string", "name": "string"}


def _progress(spark: SparkSession) -> Progress:
    return Progress(spark, shared_folder(spark, f"shelfmark-{uuid.uuid4().hex}"), _STORED)


@query
def incremental_batch(spark, sf_dir):
    pages = inputs.table(spark, sf_dir, "pages")
    progress = _progress(spark)
    run_batch(pages.filter("url LIKE 'https:%'"), progress, _titles)
    run_batch(pages, progress, _titles)
    return progress.results().select("page_id", "url", "name", "batch_id")


def _broken_first(spark, sf_dir) -> Progress:
    """A first batch in which every third page came empty and some have no address, and a second with all whole."""
    pages = inputs.table(spark, sf_dir, "pages").withColumn("url", F.expr("CASE WHEN page_id % 7 <> 0 THEN url END"))
    progress = _progress(spark)
    run_batch(pages.withColumn("html", F.expr("CASE WHEN page_id % 3 <> 0 THEN html END")), progress, _titles)
    return progress


@query
def rejected_pages(spark, sf_dir):
    return _broken_first(spark, sf_dir).rejected("batch").select("page_id", "url", "reason", "attempts")


@query
def retried_pages(spark, sf_dir):
    progress = _broken_first(spark, sf_dir)
    run_batch(inputs.table(spark, sf_dir, "pages").withColumn("url", F.expr("CASE WHEN page_id % 7 <> 0 THEN url END")),
              progress, _titles)
    return progress.results().select("page_id", "url", "name", "batch_id")


@query
def stream_results(spark, sf_dir):
    progress = _progress(spark)
    # The table may be one file or a folder of files; the name ends there.
    arriving = f"{sf_dir}/pages.parquet*"
    checkpoint = shared_folder(spark, f"shelfmark-stream-{uuid.uuid4().hex}")
    start_stream(spark, arriving, progress, _titles, checkpoint).awaitTermination()
    return progress.results().select("page_id", "url", "name")


def _arrivals(spark, sf_dir, portions: int) -> tuple[list[DataFrame], str]:
    """The pages table in portions that arrive one after the other, and the folder they arrive in."""
    pages = inputs.table(spark, sf_dir, "pages")
    return [pages.filter(F.pmod("page_id", F.lit(portions)) == i) for i in range(portions)], _folder(spark, "arriving")


@query
def compacted_stream(spark, sf_dir):
    """Batches of a stream, compacted and indexed, then more batches of the same stream."""
    progress, checkpoint = _progress(spark), _folder(spark, "stream")
    portions, folder = _arrivals(spark, sf_dir, 4)
    for i, portion in enumerate(portions):
        # The last portion brings back pages of the first.
        rows = portion if i < 3 else portion.unionByName(portions[0])
        rows.write.mode("append").parquet(folder)
        start_stream(spark, folder, progress, _titles, checkpoint).awaitTermination()
        if i == 2:
            progress.compact("stream")
            progress.index()
    return progress.results().select("page_id", "url", "name", "batch_id")


@query
def resumed_stream(spark, sf_dir):
    """A stream whose second batch fails at first and is taken up by the next start."""
    progress, checkpoint = _progress(spark), _folder(spark, "stream")
    portions, folder = _arrivals(spark, sf_dir, 2)
    calls = []

    def shaky(pages: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return _titles(pages)

    for portion in portions:
        portion.write.mode("append").parquet(folder)
        stream = start_stream(spark, folder, progress, shaky, checkpoint)
        try:
            stream.awaitTermination()
        except Exception:
            if len(calls) != 2:
                raise
            start_stream(spark, folder, progress, shaky, checkpoint).awaitTermination()
    return progress.results().select("page_id", "url", "name", "batch_id")


_START = datetime(2024, 1, 1)


def _failing(spark, sf_dir, retries: Retries, at: tuple[int, ...]) -> Progress:
    """A batch of all pages and empty ones at later times; every third page always fails, others of every fifth at first."""
    progress = _progress(spark)
    pages = inputs.table(spark, sf_dir, "pages")
    for n, seconds in enumerate((0, *at)):
        fails = "page_id % 3 = 0 OR page_id % 5 = 1" if n == 0 else "page_id % 3 = 0"

        def work(new: DataFrame, fails: str = fails) -> DataFrame:
            told = F.expr(f"CASE WHEN {fails} THEN 'try ' || cast(page_id % 5 AS string) END")
            return _titles(new).withColumn("parse_error", told)

        run_batch(pages if n == 0 else pages.limit(0), progress, work, retries=retries, now=_START + timedelta(seconds=seconds))
    return progress


@query
def retry_schedule(spark, sf_dir):
    """State of every failed page: tried at once, at 30 seconds (none due) and at 60."""
    progress = _failing(spark, sf_dir, Retries(limit=5, wait_seconds=60), (30, 60))
    due = (F.unix_micros("due") - F.unix_micros(F.lit(_START).cast("timestamp"))) / 1_000_000
    return progress.queue("batch").select(
        "page_id", "url", "reason", "attempts", "state", F.round(due).cast("long").alias("due_after"))


@query
def dead_letters(spark, sf_dir):
    """Pages given up after the second try, with the text that was kept when they came."""
    progress = _failing(spark, sf_dir, Retries(limit=2, wait_seconds=60), (60, 600))
    return progress.dead_letters("batch")


@query
def frontier_by_key_index(spark, sf_dir):
    """Orders of line items that an index of the finished orders does not hold."""
    def address(number: str) -> Column:
        return F.concat(F.lit("https://directory.example.com/order/"), F.col(number)).alias("key")

    index = KeyIndex(spark, _folder(spark, "keys"))
    index.build(inputs.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(address("o_orderkey")))
    return index.unseen(inputs.table(spark, sf_dir, "lineitem").select(address("l_orderkey"))).withColumnRenamed("key", "url")


@query
def stream_distinct_pages(spark, sf_dir):
    """First visits to an address within two days, over four files with a restart after each.

    A visit is the day's first of a user and kind of event. The last file also brings the visits of the
    first again, far behind the watermark.
    """
    events = inputs.table(spark, sf_dir, "events")
    url = F.concat_ws("/", F.lit("https://directory.example.com"), "event_type", "user_id")
    part = F.expr("cast(datediff(ts, date'2024-01-01') div 8 AS int)")
    visits = events.select(url.alias("url"), part.alias("part"), F.col("ts").cast("timestamp").alias("ts")).groupBy("url", "part").agg(F.min("ts").alias("seen_at"))
    folder, checkpoint, out = _folder(spark, "visits"), _folder(spark, "visits-state"), _folder(spark, "distinct")
    for part in range(4):
        # The time of a late visit is that of the first part; the column says when it came.
        rows = visits.filter(F.col("part") == part)
        if part == 3:
            rows = rows.unionByName(visits.filter("part = 0"))
        rows.select("url", "seen_at", F.lit(part).alias("came")).coalesce(1).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema("url string, seen_at timestamp, came int").parquet(folder)
        (distinct_pages(arriving, "seen_at", "2 days").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("url string, seen_at timestamp, came int").parquet(out).select("url", "came")


@query
def records_from_json(spark, sf_dir):
    """Records written one per line and as one array, each read by the reader for its form."""
    shown = inputs.listings(spark, sf_dir).select(
        "name", "full_description", "support_email", "image_url", F.col("links_json").alias("social_links"))
    lines, array = _folder(spark, "lines"), _folder(spark, "array")
    writers.write_json(shown, lines)
    # As exports have it: a file is one array. Such a file cannot be split, so each has 5,000 records at most.
    numbered = inputs.listings(spark, sf_dir).select(
        F.expr("tool_id div 5000").alias("file"), F.to_json(F.struct(*[
            c.alias(n) for n, c in zip(shown.columns, (F.col("name"), F.col("full_description"), F.col("support_email"),
                                                       F.col("image_url"), F.col("links_json")), strict=True)])).alias("r"))
    numbered.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value")).write.partitionBy(
        "file").text(array)
    both = [read_records(spark, path, array_file=one).select(shown.columns).withColumn("form", F.lit(name))
            for path, one, name in ((lines, False, "lines"), (array, True, "array"))]
    return both[0].unionByName(both[1])


@query
def empty_write(spark, sf_dir):
    """Whether each form of output had rows: for all listings, and for those of a size no part has."""
    parts = inputs.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.coalesce("p_type", F.lit("")).alias("category"))
    sizes = inputs.table(spark, sf_dir, "part").select("p_partkey").filter("p_size < 0")
    rows = []
    for name, write in (("json", writers.write_json), ("csv", writers.write_csv), ("folders", writers.write_by_category)):
        for kept, df in (("all", parts), ("none", parts.join(sizes, "p_partkey", "left_semi"))):
            path = _folder(spark, name)
            told = write(df, path)
            back = spark.read.schema("p_partkey bigint").json(path) if name == "json" else (
                spark.read.schema("p_partkey bigint").option("header", True).csv(path) if name == "csv"
                else spark.read.schema("p_partkey bigint").parquet(path))
            rows.append(back.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("form"), F.lit(kept).alias("kept"), F.lit(told).alias("had_rows"), "n_rows"))
    return merge.append(*rows)


@query
def enriched_listings(spark, sf_dir):
    """Listings under the latest good reply that had come before their page was seen.

    Line items serve as the log of replies: objects, lists, text that is no reply, and objects without a
    name; some come after the page, some twice on one day.
    """
    listings = inputs.listings(spark, sf_dir).select("tool_id", "name", "rating").withColumn(
        "seen_on", F.expr("date_add(date'1995-01-01', cast(tool_id % 1000 AS int))"))
    one = F.concat(F.lit('{"name": "N'), F.col("l_orderkey"), F.lit('", "rating": "'), F.col("l_linenumber"), F.lit('"}'))
    reply = (F.when(F.col("l_linenumber") % 4 == 0, one).when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("["), one, F.lit("]")))
             .when(F.col("l_linenumber") % 4 == 2, F.lit("sorry, no data")).otherwise(F.lit('{"rating": "0"}')))
    replies = inputs.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("tool_id"), F.col("l_shipdate").cast("date").alias("came_on"), "l_orderkey", "l_linenumber", reply.alias("reply"))
    met = merge.enriched(listings, replies, "tool_id", "seen_on", "came_on", "name string, rating string", "l_orderkey", "l_linenumber")
    return met.select("tool_id", "name", "rating", "enriched", quality.is_complete(("name", "rating")).alias("complete"))


def _summed(spark, sf_dir) -> Summaries:
    """Four batches of categorised listings, the second one repeated, and the first two summed in between."""
    records = _categorised(spark, sf_dir)
    kept = Summaries(spark, _folder(spark, "summaries"), ("name", "category"))
    for n in (0, 1, 1, 2, 3):
        kept.add(records.filter(F.pmod(F.xxhash64("name"), F.lit(4)) == n), "batch", n)
        if n == 2:
            kept.compact()
    return kept


@query
def summary_after_batches(spark, sf_dir):
    return _summed(spark, sf_dir).category_summary()
