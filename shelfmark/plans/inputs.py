"""Inputs of the registered queries, derived from the given tables.

``LISTINGS_SQL`` and ``IMAGES_SQL`` read the same in Spark and in DuckDB. The
page builders turn each ``part`` row into mark-up with the faults found in
real pages: unclosed tags, upper-case names, unquoted attributes, scripts that
hold tags, comments and entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


LISTINGS_SQL = """
SELECT p_partkey AS tool_id,
  p_name AS name,
  'What is ' || p_name || '? A ' ||
  CASE CAST(p_partkey % 9 AS INT)
    WHEN 0 THEN 'google ads and ppc helper' WHEN 1 THEN 'social media management hub'
    WHEN 2 THEN 'copywriting and blog writing aid' WHEN 3 THEN 'newsletter and drip campaign sender'
    WHEN 4 THEN 'keyword research and site audit kit' WHEN 5 THEN 'dashboard for attribution & kpi'
    WHEN 6 THEN 'workflow automation with crm integration' WHEN 7 THEN 'video editing suite'
    ELSE 'plain bolt' END ||
  '. How to use ' || p_name || '? Sign up as ' || p_brand || ', then start. ' ||
  'Core Features 1. Fast ' || lower(p_type) || ' 2. Size ' || CAST(p_size AS VARCHAR(10)) || '  Simple setup ' ||
  'Use Cases #1 Plan work #2 Share results ' ||
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'FAQ from ' || p_name || ' Q1 A1 Q2 A2 end ' END ||
  'https://twitter.com/t' || CAST(p_partkey AS VARCHAR(20)) ||
  ' https://www.linkedin.com/company/c' || CAST(p_partkey AS VARCHAR(20)) ||
  ' Login Link: https://app.example.com/login/' || CAST(p_partkey AS VARCHAR(20)) ||
  ' contact us page(https://app.example.com/contact)' AS full_description,
  CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN ' Help@Example.COM ' WHEN 1 THEN 'N/A'
    WHEN 2 THEN 'not-an-email' WHEN 3 THEN NULL ELSE 'a@b.co' END AS support_email,
  CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN '/img/a.png' WHEN 1 THEN '//cdn.example.com/a.png'
    WHEN 2 THEN 'https://cdn.example.com/a.png' WHEN 3 THEN 'ftp://x/a.png'
    WHEN 4 THEN '' ELSE 'N/A' END AS image_url,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'https://example.com/pricing' END AS pricing_link,
  CASE WHEN p_partkey % 13 = 0 THEN '7.5' WHEN p_partkey % 17 = 0 THEN 'bad'
    ELSE CAST(p_size % 6 AS VARCHAR(10)) END AS rating,
  CASE WHEN p_partkey % 7 = 0 THEN '; dup ;dup; ' ELSE 'fast;' || lower(p_type) || ';fast' END AS features_csv,
  'https://twitter.com/intent/tweet;http://fb.example/x;mailto:z;http://fb.example/x' AS links_csv,
  CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'PPC Tools;SEO Tools;Rank Tracking' WHEN 1 THEN 'Unknown'
    WHEN 2 THEN 'Design Tools;Visual Content' ELSE 'Email Marketing;CRM Tools' END AS categories_csv,
  CASE CAST(p_partkey % 5 AS INT)
    WHEN 0 THEN '["https://twitter.com/t' || CAST(p_partkey AS VARCHAR(20)) || '","mailto:z"]'
    WHEN 1 THEN '{{"twitter":"https://twitter.com/t' || CAST(p_partkey AS VARCHAR(20)) || '","linkedin":"none"}}'
    WHEN 2 THEN '{{"twitter":"https://x.example/a","linkedin":"http://x.example/b"}}'
    WHEN 3 THEN 'plain text' ELSE NULL END AS links_json
FROM {part}
"""

# Four images per part; {four} yields pos 0 to 3 for each row.
IMAGES_SQL = """
SELECT p_partkey AS tool_id, pos, p_name AS name,
  CASE pos WHEN 0 THEN '/static/logo.png' WHEN 1 THEN '//cdn.example.com/brand.svg'
    WHEN 2 THEN 'data:image/png;base64,AA' ELSE 'https://x.example.com/' || replace(p_name, ' ', '-') || '.png' END AS src,
  CASE WHEN (p_partkey + pos) % 3 = 0 THEN p_name ELSE '' END AS alt,
  CAST((p_partkey * 7 + pos * 31) % 300 AS DOUBLE) AS w,
  CAST((p_partkey * 5 + pos * 29) % 300 AS DOUBLE) AS h
FROM (SELECT p_partkey, p_name, {four} AS pos FROM {part})
"""

TEST_RULES = """
english 0: the 3, and 3, of 2, with 1
german 1: der 3, und 3, von 2, sich 1
french 2: le 3, et 3, des 2, les 1
spanish 3: los 3, del 3, el 2, que 1
"""


def test_rule_rows() -> list[tuple[str, int, str, int]]:
    rows = []
    for line in TEST_RULES.strip().splitlines():
        head, words = line.split(": ")
        category, order = head.split()
        for word in words.split(", "):
            keyword, weight = word.split()
            rows.append((category, int(order), keyword, int(weight)))
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tasks for a given table that is a single small file and so would be one task.
SMALL_FILE_TASKS = 8


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is long per row.

    The given tables are single files of one row group, which Spark cannot
    split. A table of several files is taken as it is.
    """
    rows = table(spark, sf_dir, name)
    return rows.repartition(SMALL_FILE_TASKS) if len(rows.inputFiles()) == 1 else rows


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LISTINGS_SQL, part=table(spark, sf_dir, "part"))


def wide_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LISTINGS_SQL, part=wide_table(spark, sf_dir, "part"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = IMAGES_SQL.replace("{four}", "explode(array(0, 1, 2, 3))")
    return spark.sql(query, part=table(spark, sf_dir, "part"))


def test_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(test_rule_rows(), "category string, cat_order int, keyword string, weight int")


_DETAIL_PAGE = """
SELECT p_partkey AS page_id, 'https://directory.example.com/tool/' || p_partkey AS url,
  '<!doctype html><HTML><head><meta charset=utf-8><title>' || p_name || ' | Shelf</title>'
  || '<meta name="description" content="' || p_name || ' &amp; ' || p_brand || '">'
  || '<style>p{{margin:0}}</style><script>var t="</div><h1>no</h1>";</script></head><body><!-- <h1>x</h1> -->'
  || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '<div class="tool-header">' END
  || '<h1> ' || p_name || ' <b>' || p_brand || '</b> </h1>'
  || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '</div>' END
  || CASE WHEN p_partkey % 10 = 9 THEN '<div class="other">' ELSE '<div class="tool-detail-information wide">' END
  || '<p>A ' || lower(p_type) || ' item.<br>Second\nline<p>Size ' || p_size || ' &mdash; video editing</p>'
  || '<h2>How to use</h2><p>Sign up as ' || p_brand || '</p>'
  || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE
       '<ul class="features-list"><li>Fast ' || lower(p_type) || '<li> <li>Size ' || p_size || '</ul>' END
  || '<div class=tool-logo><img src="/img/p' || p_partkey || '.png" alt="' || p_name || ' ' || p_brand
  || ' logo" width="' || (20 + p_partkey % 50) || '" height=40></div>'
  || '<img SRC="https://assets.example.com/x' || p_partkey || '.png" alt="The ' || p_name || ' ' || p_brand
  || ' view" width=200px height="180"/>'
  || '<img src="data:image/png;base64,AA" alt="logo" width=64 height=64>'
  || '<script>document.write("<p>bad</p>")</script><noscript><p>none</p></noscript></div>'
  || '<div class="faq-section"><div class="qa-pair"><p class="question">Is it ' || p_size
  || '?<p class="answer"> Yes </p></div><div class="qa-pair"><p class="question">Alone</p></div></div>'
  || '<a href="https://twitter.com/t' || p_partkey || '">tw</a>'
  || '<a href="https://twitter.com/intent/tweet?x=1">share</a>'
  || "<a href='https://www.linkedin.com/company/c" || p_partkey || "'>li</a>"
  || '<a href="https://twitter.com/t' || p_partkey || '">again</a>'
  || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '<a href="/pricing/' || p_partkey || '">Plans</a>' END
  || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE
       '<a href="https://site' || p_partkey || '.example.org/"><div class="visitWebsite">Visit</div></a>' END
  || '<footer>&copy; shelf' AS html
FROM {part}
"""

_LIST_PAGE = """
SELECT p_partkey AS page_id, 'https://directory.example.com/list/' || p_partkey AS url,
  '<html><body><nav><a href="/">Home</a></nav>'
  || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '<div class="grid g-' || p_size || '">'
     || '<div><h3>' || p_name || ' one</h3><p>about <b>' || p_type || '</b> <p>more</p><a href="/ai-tools/' || p_partkey || '-1">go</a></div>'
     || '<div><h2>' || p_name || ' one</h2><a href="/ai-tools/' || p_partkey || '-dup">again</a></div>'
     || '<div><h4> ' || p_brand || ' <i>two</i></h4><a href="/x">no</a><a href="/ai-tools/' || p_partkey || '-2?a=1&amp;b=2">go</a></div>'
     || '<div><p>no heading</p><a href="/ai-tools/' || p_partkey || '-3">go</a></div>'
     || '<div><h3>no link ' || p_size || '</h3></div></div>' END
  || CASE WHEN p_partkey % 5 <> 0 THEN '' ELSE
       '<article><section><a href="/ai-tools/a' || p_partkey || '"> Tool <b>' || p_size || '</b></a></section><p>desc ' || p_name
       || '</p></article><a href="/ai-tools/orphan">Orphan</a><div><a href="/ai-tools/e"> </a></div>' END
  || '<section>'
  || '<div class="tool-item card"><a class="go-tool-detail-name" href="/tool/' || p_partkey || '"><h4> ' || p_name || ' </h4></a>'
  || '<p class="tool-description"> </p><p class="tool-description long">Text ' || p_type || '</p><img src=" /i' || p_size || '.png "></div>'
  || '<div class="tool-item"><a class="go-tool-detail-name" href="/tool/' || p_partkey || '">' || p_brand || '</a>'
  || '<a href="https://o.example/x">o</a></div>'
  || '<div class="tool-item"><div class="card-title">' || p_brand || '</div><p class="description">' || p_size || ' units</p>'
  || '<a class="go-tool-detail-name" href="/tool/size-' || p_size || '"></a></div>'
  || '</section>'
  || CASE WHEN p_partkey % 7 = 0 THEN '<h2> No Results Found </h2>' ELSE '' END
  || CASE WHEN p_partkey % 2 = 0 THEN '<div><span>Monthly Visits</span><span> ' || p_size || 'K</span></div>' ELSE '' END
  || CASE WHEN p_partkey % 3 = 0 THEN '<i class="rating-value">' || (p_size % 6) || '</i>'
          ELSE '<span class="x group-hover:text-purple-1300">' || (p_size % 5) || '</span>' END
  || '<ul class="my-features"><li>Fast <b>' || p_type || '</b></li><li> </li></ul><a href="/category/c">Cat ' || p_size || '</a>'
  || '</body></html>' AS html
FROM {part}
"""


# The listings' own sites; those of even size show a usable logo.
_OWN_SITE = """
SELECT 'https://site' || p_partkey || '.example.org/' AS url,
  '<img src=x.png>' || CASE WHEN p_size % 2 = 0
    THEN '<img src="/brand' || p_partkey || '.svg" alt=Brand width=50 height=50>' ELSE '' END AS html
FROM {part}
"""


def own_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each listing's own site."""
    return spark.sql(_OWN_SITE, part=wide_table(spark, sf_dir, "part"))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detail page per part."""
    return spark.sql(_DETAIL_PAGE, part=wide_table(spark, sf_dir, "part"))


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing page per part."""
    return spark.sql(_LIST_PAGE, part=wide_table(spark, sf_dir, "part"))
