"""The registered queries in plain SQL for another engine."""

from __future__ import annotations

from shelfmark.functions.base import WS, WS_CHARS
from shelfmark.functions.labels import CATEGORIES, DOMAIN, LABEL_QUESTION, OTHER, ALIASES
from shelfmark.functions.sections import PROFILE_LINKS, WHOLE_LINKS
from shelfmark.operators.rules import CONTEXT_STEMS, DOCUMENT_STEMS, RuleSet
from shelfmark.plans import inputs
from shelfmark.settings import SiteProfile

SITE = SiteProfile()


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# -- expressions -----------------------------------------------------------
def strip(x: str) -> str:
    return f"trim({x}, {_q(WS_CHARS)})"


def match_text(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def display_text(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'), "
        r"'[^\p{L}\p{N}_ .,!?()-]', '', 'g'))"
    )


def description_text(x: str) -> str:
    cut = f"regexp_replace(coalesce({x}, ''), 'What is .+?\\?', '', 'g')"
    cut = f"regexp_replace({cut}, 'How to use .+?\\?', '', 'g')"
    cut = f"regexp_replace({cut}, '(?s)FAQ from.*', '')"
    return f"trim(regexp_replace({cut}, '{WS}+', ' ', 'g'))"


def without_qa(x: str) -> str:
    text = rf"regexp_replace({x}, '{WS}+Q\p{{Nd}}+{WS}+A\p{{Nd}}+{WS}+', ' ', 'g')"
    return rf"regexp_replace({text}, 'FAQ from.*?\n', chr(10) || 'Frequently Asked Questions:' || chr(10), 'g')"


def email(x: str, placeholder: str) -> str:
    e = f"lower({strip(x)})"
    return f"CASE WHEN {e} <> '{placeholder}' AND contains({e}, '@') AND contains({e}, '.') THEN {e} ELSE '' END"


def http(x: str) -> str:
    return f"(starts_with({x}, 'http://') OR starts_with({x}, 'https://'))"


def clean_url(x: str) -> str:
    u = strip(x)
    return (
        f"CASE WHEN {u} IS NULL OR contains({u}, '{SITE.placeholder_image}') THEN '' "
        f"WHEN starts_with({u}, '//') THEN 'https:' || {u} "
        f"WHEN starts_with({u}, '/') THEN '{SITE.base_url}' || {u} "
        f"WHEN {http(u)} THEN {u} ELSE '' END"
    )


def slug(x: str) -> str:
    return rf"lower(replace(trim(regexp_replace({x}, '[^\p{{L}}\p{{N}} _-]', '', 'g')), ' ', '_'))"


def collapse_once(x: str) -> str:
    return strip(f"replace(replace({x}, chr(10), ' '), '  ', ' ')")


def section(x: str, pattern: str) -> str:
    return f"regexp_extract({x}, {_q('(?is)' + pattern)}, 1)"


SHORT = rf"what is .+?{WS}+(.*?)(?:how to use|$)"
HOW_TO = rf"how to use .+?{WS}+(.*?)(?:Core Features|$)"
FEATURES = rf"Core Features{WS}*(.*?)(?:Use Cases|FAQ|Support Email|$)"
USE_CASES = rf"Use Cases{WS}*(.*?)(?:FAQ|Support Email|$)"


def items(text: str, separator: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(string_split_regex({text}, {_q(separator)}), "
        f"lambda i: {display_text('i')}), lambda i: i <> ''), '|')"
    )


def features(x: str) -> str:
    return items(section(x, FEATURES), rf"{WS}{{2,}}|\p{{Nd}}+\.")


def use_cases(x: str) -> str:
    return items(section(x, USE_CASES), rf"#\p{{Nd}}+|{WS}{{2,}}")


def links(x: str) -> dict[str, str]:
    result = {}
    for name, (pattern, host) in PROFILE_LINKS.items():
        found = section(x, pattern)
        result[name] = (
            f"CASE WHEN {found} = '' THEN '' WHEN {http(found)} THEN {found} ELSE 'https://{host}/' || {found} END"
        )
    for name, pattern in WHOLE_LINKS.items():
        result[name] = section(x, pattern)
    return result


def filled(*fields: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({f}, '')" for f in fields) + ", '')"


# -- sources ---------------------------------------------------------------
LISTINGS = inputs.LISTINGS_SQL.format(part="part")
IMAGES = inputs.IMAGES_SQL.format(part="part", four="unnest([0, 1, 2, 3])")


def on_listings(select: str, rest: str = "") -> str:
    return f"WITH l AS ({LISTINGS}) SELECT {select} FROM l {rest}"


# -- classification --------------------------------------------------------
def default_rule_values() -> str:
    return ", ".join(
        f"({_q(r.category)}, {r.cat_order}, {_q(r.keyword)}, '{r.kind}', {r.weight})" for r in RuleSet.default().rules
    )


def test_rule_values() -> str:
    return ", ".join(
        f"({_q(c)}, {o}, {_q(k)}, 'keyword', {float(w)})" for c, o, k, w in inputs.test_rule_rows()
    )


def any_of(x: str, stems: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{s}')" for s in stems) + ")"


def scoring(source: str, rules: str, context: bool = True) -> str:
    """CTEs ``hits``, ``scores`` and ``verdict`` for rows ``key, name, descr``."""
    bonus = " + ".join(f"2.0 * contains(c, '{s}')::INT" for s in CONTEXT_STEMS) if context else "0.0"
    return f"""
    src AS ({source}),
    cleaned AS (SELECT key, {match_text("coalesce(name, '')")} AS n, {match_text("coalesce(descr, '')")} AS d FROM src),
    t AS (SELECT key, n, d, n || ' ' || d AS c, ' ' || n || ' ' || d || ' ' AS p FROM cleaned),
    b AS (SELECT key, c, CAST({bonus} AS DOUBLE) AS bonus FROM t),
    r(category, cat_order, keyword, kind, weight) AS (VALUES {rules}),
    points AS (SELECT key, category, cat_order, keyword, kind, CAST(weight AS DOUBLE) AS weight,
      CAST(CASE WHEN kind <> 'keyword' THEN CASE WHEN contains(c, keyword) THEN weight ELSE 0 END
           WHEN contains(p, ' ' || keyword || ' ') THEN 2 * weight
           WHEN contains(n, keyword) THEN 1.5 * weight
           WHEN contains(d, keyword) THEN weight ELSE 0 END AS DOUBLE) AS score FROM t, r),
    hits AS (SELECT * FROM points WHERE score > 0),
    scores AS (SELECT key, category, cat_order, sum(score) + any_value(bonus) AS score
      FROM points JOIN b USING (key) GROUP BY key, category, cat_order),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, cat_order) AS rn FROM scores)
    """


def verdict(documents: bool = True, default: str = CATEGORIES[0]) -> str:
    low = f"WHEN score > 0 AND {any_of('c', DOCUMENT_STEMS)} THEN 'Content Marketing'" if documents else ""
    return f"""
    verdict AS (SELECT key, score, CASE WHEN score >= 3 THEN category {low} ELSE {_q(default)} END AS category
      FROM ranked JOIN b USING (key) WHERE rn = 1)
    """


def classified(source: str, rules: str | None = None) -> str:
    return scoring(source, rules or default_rule_values()) + "," + verdict()


RAW_LISTINGS = f"SELECT tool_id AS key, name, full_description AS descr FROM ({LISTINGS})"
CATEGORISED = f"SELECT tool_id AS key, name, {display_text(section('full_description', SHORT))} AS descr FROM ({LISTINGS})"
DOCUMENTS = "SELECT doc_id AS key, source AS name, text AS descr FROM documents"
SUMMARISED = (
    f"WITH {classified(CATEGORISED)}, c2 AS (SELECT src.key AS tool_id, name, "
    f"CASE WHEN src.key % 10 <> 3 THEN category ELSE '{OTHER}' END AS category FROM src JOIN verdict USING (key)) "
)

# -- pages -----------------------------------------------------------------


def decoded(x: str) -> str:
    """Entities that occur in the pages, each decoded once."""
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        x = f"replace({x}, '{name}', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def untagged(x: str) -> str:
    return decoded(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


def page_root(url: str) -> str:
    return f"regexp_extract({url}, '^([a-z]+://[^/?#]+)', 1)"


HAS_AREA = "p_partkey % 10 <> 9"
H1 = "p_name || ' ' || p_brand"
DETAIL_TEXT = (
    "'A ' || lower(p_type) || ' item.Second lineSize ' || p_size || ' — video editingHow to useSign up as ' || p_brand"
    " || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Fast ' || lower(p_type) || ' Size ' || p_size END"
)
SOCIAL = "'https://twitter.com/t' || p_partkey || '|https://www.linkedin.com/company/c' || p_partkey"
# "twitter" sorts before "www" behind the common "https://".
FEATURE_TEXT = "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Fast ' || lower(p_type) || '|Size ' || p_size END"


def shot(kind: str) -> str:
    return f"'{SITE.asset_url}/' || {slug(H1)} || '_{kind}.png'"


_W1 = "(20 + p_partkey % 50)"
# On the pages built from parts the image on the image host always wins: it
# names the listing and its brand (8 + 5 + 3), the other one gets 8 at most.
DIRECTORY_LOGO = f"'https://assets.example.com/x' || p_partkey || '.png'"


def listing_cte() -> str:
    grid = "p_partkey % 5 <> 0"
    return f"""
    SELECT p_partkey AS page_id, 1 AS ordinal, p_name || ' one' AS name, 'about' || p_type AS description,
      '/ai-tools/' || p_partkey || '-1' AS link FROM part WHERE {grid}
    UNION ALL SELECT p_partkey, 2, p_brand || 'two', 'N/A', '/ai-tools/' || p_partkey || '-2?a=1&b=2' FROM part WHERE {grid}
    UNION ALL SELECT p_partkey, 1, 'Tool' || p_size, 'desc ' || p_name, '/ai-tools/a' || p_partkey FROM part WHERE NOT ({grid})
    """


def cards_cte() -> str:
    return """
    SELECT p_partkey AS page_id, 1 AS ordinal, p_name AS name, 'Text ' || p_type AS description,
      '/tool/' || p_partkey AS link, '/i' || p_size || '.png' AS image_url FROM part
    UNION ALL SELECT p_partkey, 2, p_brand, p_size || ' units', '/tool/size-' || p_size, NULL FROM part
    """


# -- logos -----------------------------------------------------------------
def candidates(directory: bool) -> str:
    root = SITE.base_url if directory else "https://shop.example.com"
    words = "(" + " OR ".join(f"contains(lower(src), '{w}') OR contains(lower(alt), '{w}')" for w in ("logo", "brand", "icon")) + ")"
    square, fits = "w / h BETWEEN 0.8 AND 1.2", "least(w, h) BETWEEN 32 AND 200"
    if directory:
        score = (
            f"CASE WHEN greatest(w, h) < 32 THEN 0 ELSE "
            f"CASE WHEN contains(lower(alt), lower(name)) AND contains(src, 'x.example.com') THEN 8 ELSE 0 END + "
            f"CASE WHEN {words} THEN 5 ELSE 0 END + CASE WHEN {square} AND {fits} THEN 3 ELSE 0 END END"
        )
    else:
        score = (
            f"CASE WHEN {words} THEN 5 ELSE 0 END + "
            "CASE WHEN contains(lower(alt), lower(name)) OR contains(lower(src), lower(name)) THEN 8 ELSE 0 END + "
            f"CASE WHEN {square} THEN 3 ELSE 0 END + CASE WHEN {fits} THEN 2 ELSE 0 END"
        )
    return f"""
    SELECT tool_id, pos, src AS url, CAST(score AS INT) AS score, w, h FROM (
      SELECT *, {score} AS score FROM (
        SELECT tool_id, pos, name, alt, greatest(w, 1.0) AS w, greatest(h, 1.0) AS h,
          CASE WHEN starts_with(src, '//') THEN 'https:' || src WHEN starts_with(src, '/') THEN '{root}' || src ELSE src END AS src
        FROM ({IMAGES}) WHERE src <> '' AND NOT starts_with(src, 'data:image/')))
    WHERE score > 5
    """


def best(directory: bool) -> str:
    return f"""
    SELECT tool_id, url AS logo_url, score AS logo_score FROM (
      SELECT *, row_number() OVER (PARTITION BY tool_id ORDER BY score DESC, abs(w - h), pos) AS rn
      FROM ({candidates(directory)})) WHERE rn = 1
    """


# -- records ---------------------------------------------------------------
def formatted() -> str:
    """CTE body with the formatted fields of every listing."""
    link = links("full_description")
    return f"""
    SELECT tool_id, {strip("name")} AS name, {display_text(section('full_description', SHORT))} AS short_description,
      {display_text(section('full_description', HOW_TO))} AS how_to_use, {features('full_description')} AS features,
      {use_cases('full_description')} AS use_cases, '' AS website,
      {", ".join(f"{sql} AS {name}" for name, sql in link.items())},
      {clean_url("coalesce(pricing_link, '')")} AS pricing, {email("coalesce(support_email, '')", SITE.placeholder_email)} AS support_email,
      {clean_url("coalesce(image_url, '')")} AS image_url
    FROM ({LISTINGS})
    """


def link_text(pairs: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"CASE WHEN starts_with({url}, 'http') THEN '{name}: ' || {url} END" for name, url in pairs)
    return f"concat_ws('|', {parts})"


FLAT = f"""
SELECT tool_id, name, verdict.category, short_description, how_to_use, features, use_cases,
  {link_text([(n, n) for n in ("website", *PROFILE_LINKS)])} AS social_links,
  {link_text([(n, n) for n in ("login", "signup", "pricing", "contact")])} AS important_links,
  support_email, 'https://cdn.example.com/logo.png' AS logo_url, CASE WHEN starts_with(image_url, 'http') THEN image_url ELSE '' END AS img_url
FROM f JOIN verdict ON verdict.key = f.tool_id
"""
FLAT_CTES = f"WITH {classified(CATEGORISED)}, f AS ({formatted()}), flat AS ({FLAT})"
FLAT_NAMES = (
    "name", "category", "short_description", "how_to_use", "features", "use_cases", "social_links", "important_links",
    "support_email", "logo_url", "img_url",
)


def failed_rules() -> str:
    tests = {
        "name": "name IS NOT NULL",
        "description": "description <> 'N/A'",
        "rating": "coalesce(TRY_CAST(rating AS DOUBLE) BETWEEN 0 AND 5, false)",
        "image_url": f"(image_url = 'N/A' OR {http('image_url')})",
        "pricing_link": "pricing_link IS NOT NULL",
        "social_links": "tool_id % 29 <> 0",
        "support_email": "support_email IS NOT NULL AND (support_email = 'N/A' OR contains(support_email, '@'))",
    }
    return "concat_ws('|', " + ", ".join(f"CASE WHEN NOT ({t}) THEN '{n}' END" for n, t in tests.items()) + ")"


CANDIDATES = f"""
SELECT tool_id, CASE WHEN tool_id % 19 <> 0 THEN name END AS name,
  CASE WHEN tool_id % 23 = 0 THEN 'N/A' ELSE '' END AS description, rating, image_url, pricing_link, support_email
FROM ({LISTINGS})
"""
HTTPS = "url LIKE 'https:%'"
FRONTIER = "SELECT page_id, url FROM pages UNION ALL SELECT page_id, url FROM pages WHERE url LIKE '%?%'"
ALIAS_VALUES = ", ".join(
    f"({_q(a)}, {_q(c)})" for a, c in [*ALIASES.items(), *[(d, d) for d in DOMAIN]]
)


def _prompt() -> str:
    before, rest = LABEL_QUESTION.split("{name}")
    middle, rest = rest.split("{description}")
    between, after = rest.split("{domain}")
    domain = "\n".join(f"- {c}" for c in CATEGORIES)
    return f"{_q(before)} || name || {_q(middle)} || full_description || {_q(between + domain + after)}"


def oracle_sql() -> dict[str, str]:
    in_titles = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
    body = "regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1)"
    paragraph = "regexp_replace(piece, '(?s)(</p>|</article>).*', '')"
    dotted = "CASE WHEN pos = 2 THEN './' || alt || '.png' ELSE src END"
    host = "'https://h' || tool_id || '.example.com:8080'"
    extra = (
        "full_description || ' DISCORD.GG/d' || tool_id || ' facebook.com/f\" youtube.com/@y Instagram.com/i/' || "
        "CASE WHEN tool_id % 2 = 0 THEN ' Sign up Link:https://app.example.com/up' ELSE '' END"
    )
    scored_listings = f"WITH {scoring(RAW_LISTINGS, default_rule_values())}"
    by_test_rules = scoring(DOCUMENTS, test_rule_values(), context=False)
    custom = (
        f"WITH {by_test_rules}, {verdict(documents=False, default='none')} SELECT key AS doc_id, category FROM verdict"
    )
    profile = ", ".join(f"count(*) FILTER (WHERE length({c}) > 0) AS {c}" for c in FLAT_NAMES)
    title = strip(decoded(in_titles))
    ai = "'https://directory.example.com'"
    dedup_first = f"SELECT name, min(tool_id) AS tool_id FROM ({LISTINGS})"
    twins = {
        # text
        "clean_match_text": f"SELECT doc_id, {match_text('text')} AS match_text FROM documents",
        "clean_display_text": f"SELECT doc_id, {display_text('text')} AS display_text FROM documents",
        "clean_description": f"""
            SELECT id, kind, {description_text('raw')} AS description FROM (
              SELECT tool_id AS id, 'listing' AS kind, full_description AS raw FROM ({LISTINGS})
              UNION ALL SELECT doc_id, 'document', text FROM documents)""",
        "strip_qa_markers": on_listings(
            "tool_id, " + without_qa("(replace(full_description, ' end ', ' end' || chr(10)) || ' Q3 A3 tail')")
            + " AS description"
        ),
        "clean_email": on_listings(
            f"tool_id, {email('coalesce(support_email, ' + _q('') + ')', SITE.placeholder_email)} AS email, "
            f"{email('coalesce(support_email, ' + _q('') + ')', 'a@b.co')} AS email_without_placeholder"
        ),
        "clean_url": on_listings(
            f"tool_id, {clean_url('image_url')} AS image_url, {clean_url('pricing_link')} AS pricing_link"
        ),
        "slugify": f"SELECT doc_id, {slug('text')} AS slug FROM documents",
        "asset_names": on_listings(
            f"tool_id, '{SITE.asset_url}/' || {slug('(name || ' + _q(' / ') + ' || tool_id)')} || '_full.png' AS asset_url, "
            f"{slug('(name || ' + _q(' / ') + ' || tool_id)')} || '_full.png' AS file_name"
        ),
        "collapse_once": "SELECT doc_id, "
            + collapse_once("replace(text, '. ', '.   ' || chr(10) || ' ')") + " AS text FROM documents",
        "strip_text": f"SELECT doc_id, {strip('text')} AS text FROM documents",
        "absolute_urls": f"""
            SELECT tool_id, pos, CASE WHEN starts_with(s, '//') THEN 'https:' || s WHEN starts_with(s, '/') THEN {host} || s
              WHEN starts_with(s, './') THEN {host} || substr(s, 2) ELSE s END AS src
            FROM (SELECT tool_id, pos, {dotted} AS s FROM ({IMAGES}))""",
        "extract_first_link": on_listings(
            "tool_id, 'https://www.linkedin.com/company/c' || tool_id AS whole_match, "
            "'https://app.example.com/login/' || tool_id AS group_match, '' AS no_match"
        ),
        "label_prompts": on_listings(f"tool_id, {_prompt()} AS prompt"),
        # sections
        "sections_text": on_listings(
            f"tool_id, {display_text(section('full_description', SHORT))} AS short_description, "
            f"{display_text(section('full_description', HOW_TO))} AS how_to_use"
        ),
        "sections_features": on_listings(f"tool_id, {features('full_description')} AS features"),
        "sections_use_cases": on_listings(f"tool_id, {use_cases('full_description')} AS use_cases"),
        "section_links": f"WITH x AS (SELECT tool_id, {extra} AS raw FROM ({LISTINGS})) SELECT tool_id, "
            + ", ".join(f"{sql} AS {name}_link" for name, sql in links("raw").items()) + " FROM x",
        # classification
        "classify_default_rules": f"WITH {classified(RAW_LISTINGS)} SELECT key AS tool_id, category FROM verdict",
        "classify_documents": f"WITH {classified(DOCUMENTS)} SELECT key AS doc_id, category, score FROM verdict",
        "classify_custom_rules": custom,
        "classify_by_rule_join": custom,
        "scores_by_rule_join": f"WITH {by_test_rules} SELECT key AS doc_id, category, score FROM scores WHERE score > 0",
        "classify_scores": f"{scored_listings} SELECT key AS tool_id, category, score FROM scores WHERE score > 0",
        "classify_explain": f"{scored_listings} SELECT key AS tool_id, category, keyword, kind, weight, score FROM hits",
        # lists, maps, labels
        "clean_features": on_listings(
            "tool_id, CASE WHEN tool_id % 7 = 0 THEN 'dup' ELSE concat_ws('|', 'fast', nullif(split_part(features_csv, ';', 2), 'fast')) END AS features"
        ),
        "clean_social_links": on_listings(
            "tool_id, array_to_string(list_sort(list_distinct(list_filter(string_split(links_csv, ';'), "
            f"lambda x: NOT contains(x, 'intent/tweet') AND {http('x')}))), '|') AS links"
        ),
        "consolidate_categories": f"""
            WITH l AS ({LISTINGS}), names AS (SELECT tool_id, unnest(string_split(categories_csv, ';')) AS c FROM l),
            m(alias, standard) AS (VALUES {ALIAS_VALUES})
            SELECT tool_id, string_agg(DISTINCT coalesce(standard, 'Other'), '|' ORDER BY coalesce(standard, 'Other')) AS categories
            FROM names LEFT JOIN m ON c = alias GROUP BY tool_id""",
        "normalize_label": on_listings(
            "tool_id, CASE WHEN tool_id % 3 = 0 THEN 'Visual Marketing' "
            f"WHEN string_split(categories_csv, ';')[-1] IN ({', '.join(_q(d) for d in DOMAIN)}) "
            "THEN string_split(categories_csv, ';')[-1] ELSE 'Other' END AS label"
        ),
        "link_map_to_text": on_listings(
            "tool_id, concat_ws('|', 'site: http://s.example/' || tool_id, "
            "CASE WHEN starts_with(image_url, 'http') THEN 'image: ' || image_url END, 'price: ' || pricing_link) AS links"
        ),
        "polymorphic_links": on_listings(
            "tool_id, CASE tool_id % 5 WHEN 0 THEN 'https://twitter.com/t' || tool_id "
            "WHEN 1 THEN 'twitter: https://twitter.com/t' || tool_id "
            "WHEN 2 THEN 'twitter: https://x.example/a|linkedin: http://x.example/b' ELSE '' END AS links, "
            "tool_id % 5 IN (1, 2) AS is_map, tool_id % 5 = 0 AS is_list"
        ),
        "first_http_urls": on_listings(
            "tool_id, coalesce(h[1], '') AS first_url, coalesce(h[2], '') AS second_url",
            ", LATERAL (SELECT list_filter([image_url, pricing_link, support_email], lambda u: starts_with(u, 'http')) AS h)",
        ),
        "join_feature_list": on_listings(
            "tool_id, CASE WHEN tool_id % 7 <> 0 THEN replace(features_csv, ';', '|') ELSE '' END AS features"
        ),
        "parse_replies": """
            SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k
            FROM events""",
        # records
        "clean_records": f"""
            WITH l AS (SELECT *, CASE WHEN tool_id % 11 <> 0 THEN name END AS name2 FROM ({LISTINGS})),
            {classified("SELECT tool_id AS key, name2 AS name, " + without_qa("full_description") + " AS descr FROM l")}
            SELECT tool_id, name2 AS name, {without_qa("full_description")} AS full_description,
              CAST(NULL AS VARCHAR) AS description, replace(features_csv, ';', '|') AS features,
              'http://fb.example/x|http://fb.example/x' AS links_text, support_email, pricing_link, image_url,
              CASE WHEN tool_id % 2 = 0 THEN 'Given' WHEN tool_id % 11 = 0 THEN 'Other' ELSE category END AS category
            FROM l JOIN verdict ON key = tool_id""".replace(
                "'http://fb.example/x|http://fb.example/x' AS links_text",
                "'https://twitter.com/intent/tweet|http://fb.example/x|http://fb.example/x' AS social_links",
            ),
        "format_records": f"""
            WITH {classified(CATEGORISED)}, f AS ({formatted()})
            SELECT tool_id, name, short_description, how_to_use, features, use_cases, website, twitter, linkedin, login, pricing,
              contact, support_email, '{SITE.base_url}/logo.png' AS logo_url, image_url AS img_url, category
            FROM f JOIN verdict ON key = tool_id""",
        "flatten_records": f"{FLAT_CTES} SELECT * FROM flat",
        "coalesce_fields": on_listings(
            f"tool_id, {filled('image_url', 'support_email')} AS image_or_email, {filled('pricing_link', 'rating')} AS pricing_or_rating"
        ),
        "column_profile": f"""
            {FLAT_CTES}, p AS (SELECT count(*) AS n_rows, {profile} FROM flat)
            SELECT column_name, non_empty, n_rows FROM p UNPIVOT (non_empty FOR column_name IN ({', '.join(FLAT_NAMES)}))""",
        # quality
        "complete_records": on_listings(
            "tool_id, name IS NOT NULL AND support_email IS NOT NULL AND pricing_link IS NOT NULL AS complete"
        ),
        "placeholder_values": on_listings(
            "tool_id, image_url = '/img/a.png' AS image_is_placeholder, rating = '' AS rating_is_placeholder"
        ),
        "validate_records": f"""
            WITH v AS (SELECT tool_id, {failed_rules()} AS failed_rules FROM ({CANDIDATES}))
            SELECT tool_id, failed_rules, failed_rules = '' AS valid FROM v""",
        "valid_and_rejected": f"""
            SELECT tool_id, CASE WHEN {failed_rules()} = '' THEN 'valid' ELSE 'rejected' END AS state FROM ({CANDIDATES})""",
        "conform_records": on_listings("""
            tool_id, CASE WHEN tool_id % 19 <> 0 THEN name END AS name, full_description AS description, 'Other' AS category,
            '' AS features, 'N/A' AS monthly_traffic, coalesce(TRY_CAST(rating AS DOUBLE), 0.0) AS rating, image_url,
            'N/A' AS twitter_link, 'N/A' AS linkedin_link, coalesce(support_email, 'N/A') AS support_email,
            coalesce(pricing_link, 'N/A') AS pricing_link, 'N/A' AS pricing_model, tool_id % 3 = 0 AS api_available,
            CAST(NULL AS VARCHAR) AS last_updated,
            concat_ws('|', CASE WHEN tool_id % 19 = 0 THEN 'name' END,
              CASE WHEN NOT coalesce(TRY_CAST(rating AS DOUBLE) BETWEEN 0 AND 5, false) THEN 'rating' END,
              CASE WHEN tool_id % 3 = 1 THEN 'api_available' END) AS violations"""),
        "valid_categories": f"""
            SELECT category, category IN ({', '.join(_q(d) for d in DOMAIN)}) AS valid FROM (
              SELECT unnest(string_split(categories_csv, ';')) AS category FROM ({LISTINGS})
              UNION SELECT unnest([{', '.join(_q(d) for d in DOMAIN)}]))""",
        # summaries
        "category_counts": SUMMARISED + "SELECT category, count(*) AS n_tools FROM c2 GROUP BY category",
        "tools_by_category": SUMMARISED
            + "SELECT category, tool_id, name, count(*) OVER (PARTITION BY category) AS n_in_category FROM c2",
        "category_summary": SUMMARISED + """
            SELECT category, 'category' AS level, CAST(NULL AS VARCHAR) AS name, count(*) AS n_tools FROM c2 GROUP BY category
            UNION ALL SELECT category, 'name', name, count(*) FROM c2 GROUP BY category, name""",
        "run_metrics": f"""
            SELECT count(*) AS n_rows, count(DISTINCT url) AS n_unique,
              count(DISTINCT url) FILTER (WHERE {HTTPS}) AS n_processed,
              count(DISTINCT url) FILTER (WHERE NOT {HTTPS}) AS n_remaining FROM ({FRONTIER})""",
        "distinct_names": on_listings("DISTINCT name"),
        # joins and set operations
        "frontier_minus_processed": f"SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE {HTTPS})",
        "mark_processed": f"SELECT DISTINCT url FROM pages WHERE {HTTPS} OR url LIKE '%#%'",
        "dedup_first_by_name": f"""
            WITH l AS ({LISTINGS}) SELECT name, tool_id, full_description FROM l
            WHERE tool_id IN (SELECT min(tool_id) FROM l GROUP BY name)""",
        "unseen_names": f"""
            {dedup_first} WHERE name NOT IN (SELECT name FROM ({LISTINGS}) WHERE rating = 'bad') GROUP BY name""",
        "first_k_per_name": f"""
            SELECT name, tool_id FROM ({LISTINGS}) QUALIFY row_number() OVER (PARTITION BY name ORDER BY tool_id) <= 5""",
        "overlay_enrichment": on_listings(
            "tool_id, CASE WHEN pricing_link IS NOT NULL AND support_email IS NOT NULL THEN upper(full_description) "
            "ELSE full_description END AS description, "
            "CASE WHEN pricing_link IS NOT NULL THEN 'New' ELSE 'Base' END AS category"
        ),
        "fallback_source": f"SELECT page_id, url, CASE WHEN {HTTPS} THEN 'A' ELSE 'B' END AS method FROM pages",
        "append_records": on_listings(
            "tool_id, CASE WHEN rating <> 'bad' THEN name END AS name, CASE WHEN rating = 'bad' THEN rating END AS rating"
        ),
        "listing_page_sequence": """
            WITH n AS (SELECT c_nationkey, CAST(ceil(count(*) / 20.0) AS INT) AS n_pages FROM customer GROUP BY 1),
            s AS (SELECT c_nationkey, CAST(unnest(range(1, n_pages + 1)) AS INT) AS page_no FROM n)
            SELECT c_nationkey, page_no, 'https://directory.example.com/nation/' || c_nationkey
              || CASE WHEN page_no > 1 THEN '/page/' || page_no ELSE '' END AS url FROM s""",
        # pages
        "page_title": f"""
            SELECT page_id, {title} AS title, {strip(untagged("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS heading FROM pages""",
        "page_links": f"""
            WITH x AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>')) AS a,
              generate_subscripts(regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>'), 1) AS ordinal FROM pages),
            y AS (SELECT page_id, url, CAST(ordinal AS INT) AS ordinal, {decoded("regexp_extract(a, '^<a href=" + chr(34) + "([^" + chr(34) + "]*)', 1)")} AS href,
              {strip(untagged("a"))} AS label FROM x)
            SELECT page_id, ordinal, href, label, CASE WHEN starts_with(href, '//') THEN 'https:' || href
              WHEN starts_with(href, '/') THEN {page_root('url')} || href ELSE href END AS absolute_href FROM y""",
        "page_paragraphs": f"""
            WITH x AS (SELECT page_id, string_split({body}, '<p>')[2:] AS pieces FROM pages),
            y AS (SELECT page_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS ordinal FROM x)
            SELECT page_id, CAST(ordinal AS INT) AS ordinal, {untagged(paragraph)} AS text FROM y""",
        "strip_non_content": f"""
            SELECT page_id, {untagged("regexp_replace(html, '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'g')")} AS content FROM pages""",
        "page_tag_counts": """
            SELECT page_id, tag, count(*) AS n
            FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
            WHERE tag NOT IN ('script', 'style') GROUP BY page_id, tag""",
        "page_elements_by_sql": f"SELECT page_id, {untagged('regexp_extract(html, ' + _q('(?s)<h1>(.*?)</h1>') + ', 1)')} AS text FROM pages",
        "page_details": f"""
            SELECT p_partkey AS page_id, {H1} AS name, {shot('full')} AS full_screenshot_url, {shot('content')} AS content_screenshot_url,
              CASE WHEN p_partkey % 4 <> 0 THEN {shot('features')} END AS features_screenshot_url,
              CASE WHEN p_partkey % 3 <> 0 THEN {shot('hero')} END AS hero_screenshot_url,
              p_name || ' & ' || p_brand AS meta_description, {DETAIL_TEXT} AS full_description, {FEATURE_TEXT} AS features,
              {SOCIAL} AS social_links, CASE WHEN p_partkey % 5 <> 0 THEN '/pricing/' || p_partkey END AS pricing_link,
              CASE WHEN p_partkey % 2 = 1 THEN 'https://site' || p_partkey || '.example.org/' END AS website,
              {shot('content')} AS img_url FROM part WHERE {HAS_AREA}""",
        "page_details_with_faq": f"""
            SELECT p_partkey AS page_id, ' ' || p_name || ' ' || p_brand || ' ' AS name,
              'A ' || lower(p_type) || ' item.Second' || chr(10) || 'line' AS description, 'Sign up as ' || p_brand AS how_to_use,
              {FEATURE_TEXT} AS features, {SOCIAL} AS social_links, '/img/p' || p_partkey || '.png' AS image_url,
              'Is it ' || p_size || '?=Yes' AS faq FROM part WHERE {HAS_AREA}""",
        "heading_sibling_text": "SELECT p_partkey AS page_id, 'Sign up as ' || p_brand AS how_to_use FROM part",
        "page_images": f"""
            SELECT p_partkey AS page_id, 0 AS ordinal, '/img/p' || p_partkey || '.png' AS src, {H1} || ' logo' AS alt,
              CAST({_W1} AS DOUBLE) AS w, 40.0::DOUBLE AS h FROM part
            UNION ALL SELECT p_partkey, 1, {DIRECTORY_LOGO}, 'The ' || {H1} || ' view', 200.0, 180.0 FROM part
            UNION ALL SELECT p_partkey, 2, 'data:image/png;base64,AA', 'logo', 64.0, 64.0 FROM part""",
        "social_links_by_domain": f"SELECT p_partkey AS page_id, {SOCIAL} AS social_links FROM part",
        "platform_links": """
            SELECT p_partkey AS page_id, 'https://twitter.com/t' || p_partkey AS twitter_link,
              'https://www.linkedin.com/company/c' || p_partkey AS linkedin_link, 'N/A' AS header_twitter_link FROM part""",
        "catalogue_records": f"""
            WITH pg AS (SELECT *, p_partkey AS page_id, {H1} AS h1, {DETAIL_TEXT} AS descr FROM part WHERE {HAS_AREA}),
            {classified("SELECT page_id AS key, h1 AS name, descr FROM pg")}
            SELECT page_id, 'https://directory.example.com/tool/' || page_id AS url, h1 AS name,
              CASE WHEN page_id % 2 = 1 THEN 'https://site' || page_id || '.example.org/' END AS website,
              {shot('full')} AS full_screenshot_url, {shot('content')} AS content_screenshot_url, {shot('content')} AS img_url,
              CASE WHEN page_id % 4 <> 0 THEN {shot('features')} END AS features_screenshot_url,
              CASE WHEN page_id % 3 <> 0 THEN {shot('hero')} END AS hero_screenshot_url,
              p_name || ' & ' || p_brand AS meta_description, pg.descr AS full_description, {FEATURE_TEXT} AS features,
              {SOCIAL} AS social_links, CASE WHEN page_id % 5 <> 0 THEN '/pricing/' || page_id END AS pricing_link,
              CASE WHEN page_id % 2 = 1 AND p_size % 2 = 0 THEN 'https://site' || page_id || '.example.org/brand' || page_id || '.svg'
                ELSE {DIRECTORY_LOGO} END AS logo_url, category
            FROM pg JOIN verdict ON key = page_id""",
        "card_records": f"SELECT * FROM ({cards_cte()})",
        "card_urls": f"""
            SELECT {ai} || '/tool/' || p_partkey AS url FROM part UNION SELECT {ai} || '/tool/size-' || p_size FROM part""",
        "named_cards": f"""
            SELECT p_partkey AS page_id, 1 AS ordinal, p_name AS name, {ai} || '/tool/' || p_partkey AS tool_url FROM part
            UNION ALL SELECT p_partkey, 2, p_brand, {ai} || '/tool/' || p_partkey FROM part
            UNION ALL SELECT p_partkey, 3, '', {ai} || '/tool/size-' || p_size FROM part""",
        "first_cards_per_page": "SELECT p_partkey AS page_id, 1 AS ordinal, p_name AS name FROM part",
        "listing_records": f"""
            SELECT page_id, ordinal, name, description, '{SITE.grid_category}' AS category, 0.0::DOUBLE AS rating, 'N/A' AS image_url,
              {ai} || link AS pricing_link, 'N/A' AS support_email FROM ({listing_cte()})""",
        "pages_without_results": "SELECT p_partkey AS page_id, p_partkey % 5 = 0 OR p_partkey % 7 = 0 AS no_results FROM part",
        "registry_fields": """
            SELECT p_partkey AS page_id, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_name || ' one' END AS name,
              'N/A' AS description, 'Cat ' || p_size AS category,
              CASE WHEN p_partkey % 2 = 0 THEN p_size || 'K' ELSE 'N/A' END AS monthly_traffic,
              CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 6 AS VARCHAR) ELSE CAST(p_size % 5 AS VARCHAR) END AS rating,
              'N/A' AS pricing_model, 'N/A' AS api_info, 'Fast' || p_type AS features,
              p_name || 'Text ' || p_type AS tool_card, ' /i' || p_size || '.png ' AS image_url,
              'N/A' AS pricing_link, 'N/A' AS twitter_link, 'N/A' AS facebook_link, 'N/A' AS linkedin_link,
              'N/A' AS instagram_link, 'N/A' AS support_email FROM part""",
        "fields_by_selector_table": f"""
            SELECT page_id, {title} AS title, {strip(decoded("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS lead,
              {strip(decoded("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"))} AS notice,
              {strip(decoded("regexp_extract(html, '<nav><ul><li><a href=\"[^\"]*\">(.*?)</a>', 1)"))} AS first_entry, 'N/A' AS price
            FROM pages""",
        # logos
        "logo_candidates": candidates(directory=False),
        "logo_candidates_directory": candidates(directory=True),
        "best_logo": best(directory=False),
        "logo_with_fallback": f"""
            SELECT p_partkey AS tool_id, coalesce(o.logo_url, d.logo_url) AS logo_url FROM part
            LEFT JOIN ({best(False)}) o ON o.tool_id = p_partkey LEFT JOIN ({best(True)}) d ON d.tool_id = p_partkey""",
        # incremental
        "incremental_batch": f"""
            SELECT page_id, url, {title} AS name, CASE WHEN {HTTPS} THEN 0 ELSE 1 END AS batch_id FROM pages""",
        "rejected_pages": f"""
            SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN url END AS url, 'no page' AS reason, 1 AS attempts
            FROM pages WHERE page_id % 3 = 0""",
        "retried_pages": f"""
            SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN url END AS url, {title} AS name,
              CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS batch_id
            FROM pages""",
        "stream_results": f"SELECT page_id, url, {title} AS name FROM pages",
        "enriched_listings": """
            WITH p AS (SELECT p_partkey AS k, DATE '1995-01-01' + (p_partkey % 1000)::INTEGER AS seen FROM part),
            r AS (
              SELECT k, l_orderkey AS o, l_linenumber AS n FROM lineitem JOIN p ON k = l_partkey
              WHERE l_shipdate::DATE <= seen AND l_linenumber % 4 <> 2
              QUALIFY row_number() OVER (PARTITION BY k ORDER BY l_shipdate::DATE DESC, l_orderkey DESC, l_linenumber DESC) = 1),
            l AS (""" + LISTINGS + """)
            SELECT tool_id, CASE WHEN n % 4 < 2 THEN 'N' || o ELSE name END AS name,
              CASE WHEN n % 4 < 2 THEN n::VARCHAR WHEN n % 4 = 3 THEN '0' ELSE rating END AS rating, n IS NOT NULL AS enriched,
              (CASE WHEN n % 4 < 2 THEN 'N' || o ELSE name END) IS NOT NULL AND (n IS NOT NULL OR rating IS NOT NULL) AS complete
            FROM l LEFT JOIN r ON k = tool_id""",
        "compacted_stream": f"SELECT page_id, url, {title} AS name, page_id % 4 AS batch_id FROM pages",
        "resumed_stream": f"SELECT page_id, url, {title} AS name, page_id % 2 AS batch_id FROM pages",
        "retry_schedule": """
            SELECT page_id, url, 'try ' || page_id % 5 AS reason, 2 AS attempts,
              CASE WHEN page_id % 3 = 0 THEN 'open' ELSE 'done' END AS state, 180 AS due_after
            FROM pages WHERE page_id % 3 = 0
            UNION ALL SELECT page_id, url, 'no record', 2, 'done', 180 FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 = 1""",
        "dead_letters": """
            SELECT page_id, url, 'try ' || page_id % 5 AS reason, 2 AS attempts, html FROM pages WHERE page_id % 3 = 0""",
        "frontier_by_key_index": """
            SELECT DISTINCT 'https://directory.example.com/order/' || l_orderkey AS url FROM lineitem
            WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
        "stream_distinct_pages": """
            WITH v AS (
              SELECT 'https://directory.example.com/' || event_type || '/' || user_id AS url,
                date_diff('day', DATE '2024-01-01', ts::DATE) // 8 AS part, min(ts) AS seen FROM events GROUP BY 1, 2),
            w AS (SELECT part, max(seen) - INTERVAL 2 DAY AS mark FROM v GROUP BY part),
            e0 AS (FROM v WHERE part = 0),
            e1 AS (FROM v WHERE part = 1 AND url NOT IN (
              SELECT url FROM e0 WHERE seen + INTERVAL 2 DAY > (SELECT mark FROM w WHERE part = 0))),
            e2 AS (FROM v WHERE part = 2 AND url NOT IN (
              SELECT url FROM (FROM e0 UNION ALL FROM e1) WHERE seen + INTERVAL 2 DAY > (SELECT mark FROM w WHERE part = 1))),
            e3 AS (FROM v WHERE part = 3 AND url NOT IN (
              SELECT url FROM (FROM e0 UNION ALL FROM e1 UNION ALL FROM e2)
              WHERE seen + INTERVAL 2 DAY > (SELECT mark FROM w WHERE part = 2)))
            SELECT url, part::INTEGER AS came FROM (FROM e0 UNION ALL FROM e1 UNION ALL FROM e2 UNION ALL FROM e3)""",
        "records_from_json": on_listings(
            "name, full_description, support_email, image_url, links_json AS social_links, unnest(['lines', 'array']) AS form"),
        "empty_write": """
            SELECT form, kept, kept = 'all' AS had_rows, CASE WHEN kept = 'all' THEN (SELECT count(*) FROM part) ELSE 0 END AS n_rows
            FROM (SELECT unnest(['json', 'csv', 'folders']) AS form), (SELECT unnest(['all', 'none']) AS kept)""",
        # files
        "sorted_json_keys": on_listings("tool_id, to_json({'name': name, 'rating': rating, 'tool_id': tool_id})::VARCHAR AS record"),
        "text_preview": "SELECT doc_id, left(text, 80) AS preview FROM documents",
        "html_files": f"SELECT page_id, {title} AS title FROM pages",
        "aliases_by_table": f"""
            WITH l AS ({LISTINGS}), names AS (SELECT tool_id, unnest(string_split(categories_csv, ';')) AS c FROM l),
            m(alias, standard) AS (VALUES {ALIAS_VALUES})
            SELECT tool_id, coalesce(standard, 'Other') AS category FROM names LEFT JOIN m ON c = alias""",
    }
    twins["json_round_trip"] = twins["format_records"]
    twins["csv_round_trip"] = twins["flatten_records"]
    twins["summary_after_batches"] = twins["category_summary"]
    twins["category_folders"] = twins["category_counts"]
    return twins
