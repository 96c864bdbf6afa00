import pytest
from pyspark.sql import functions as F

from shelfmark.operators import extract, logos
from shelfmark.operators.elements import explode_elements, parse_pages, register_html_elements
from shelfmark.operators.matching import Page, Sel, selectors_from
from shelfmark.settings import SiteProfile

SITE = SiteProfile()
PAGE = Page()


@pytest.fixture
def parsed(spark):
    def run(*html, attrs=None):
        rows = [(i, f"https://h/{i}", h) for i, h in enumerate(html)]
        return parse_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"), attrs=attrs)

    return run


def tree(df):
    rows = explode_elements(df, "page_id").orderBy("page_id", "pos").collect()
    return [(r["tag"], r["parent_pos"], r["last_pos"], r["text"]) for r in rows]


@pytest.mark.parametrize("html, expected", [
    ("<p>a<p>b", [("p", -1, 0, "a"), ("p", -1, 1, "b")]),
    ("<p><b>a<br><p>c</p>d", [("p", -1, 2, "a"), ("b", 0, 2, "a"), ("br", 1, 2, ""), ("p", -1, 3, "c")]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", [("ul", -1, 4, "abc"), ("li", 0, 3, "ab"), ("ul", 1, 3, "b"), ("li", 2, 3, "b"), ("li", 0, 4, "c")]),
    ("<DIV>x<script>var a='</div><p>';</script>y</DIV>z", [("div", -1, 0, "xy")]),
    ("<div><noscript><p>n</p></noscript><style>p{}</style>t", [("div", -1, 0, "t")]),
    ("<title>a <b> c</title><i>d</i>", [("title", -1, 0, "a <b> c"), ("i", -1, 1, "d")]),
    ("<i>&amp;&copy;&middot;&#65;&bogus; a < b</i>", [("i", -1, 0, "&©·A&bogus; a < b")]),
    ("<!-- <p>no</p> --><!doctype html><i>1</i><!-- open <i>2</i>", [("i", -1, 0, "1")]),
    ("</b></i><i>x</b></i>", [("i", -1, 0, "x")]),
    ("<div/>a", [("div", -1, 0, "a")]),
    ("<a title='x>y' href=\"p>q\">t</a>", [("a", -1, 0, "t")]),
    ("<i>x</i><b", [("i", -1, 0, "x"), ("b", -1, 1, "")]),
    ("", []),
    ("plain", []),
])
def test_tree(parsed, html, expected):
    assert tree(parsed(html)) == expected


def test_attributes(parsed):
    html = """<a CLASS="x  y" href=/a?b=1&amp;c="d" data-x='it"s' hidden href=second title="&lt;">t</a>"""
    (row,) = explode_elements(parsed(html), "page_id").collect()
    assert row["classes"] == ["x", "y"]
    assert row["attrs"] == {"href": '/a?b=1&c="d"', "data-x": 'it"s', "hidden": "", "title": "<"}
    (row,) = explode_elements(parsed(html, attrs=("href",)), "page_id").collect()
    assert list(row["attrs"]) == ["href"] and row["classes"] == ["x", "y"]


def test_bad_page_does_not_stop_the_job(parsed):
    bad = "<p>a</p>&#" + "9" * 5000 + ";"
    rows = {r["page_id"]: r for r in parsed("<p>x", bad, None, "<p>y").collect()}
    assert len(rows) == 4
    assert rows[1]["parse_error"].startswith("ValueError") and rows[1]["elements"] == [] and rows[1]["runs"] == []
    assert rows[2]["elements"] == [] and rows[2]["parse_error"] is None
    assert rows[3]["runs"] == ["y"] and rows[0]["runs"] == ["x"]


def test_hostile_pages_stay_linear(parsed):
    import time

    pages = ["<a " * 200_000, "<div>" * 100_000, "</p>" * 200_000, '<a x="' * 100_000, "<!--" * 200_000, "<li>" * 100_000]
    start = time.time()
    counts = [r[0] for r in parsed(*pages).select(F.size("elements")).collect()]
    assert len(counts) == 6 and time.time() - start < 60


def test_hostile_pages_stay_linear_to_select(parsed):
    import time

    deep = "<div>" * 20_000 + "x" * 1_000_000 + "No Results Found"
    grid = '<div class="grid">' + '<div><h3>n</h3><p>t<a href="/ai-tools/x">l</a></div>' * 3_000
    df = parsed(deep, grid)
    start = time.time()
    no_results = extract.has_no_results(PAGE, SITE)
    assert [v for (v,) in values(df, no_results)] == [True, False]
    assert extract.listings(df, SITE).count() == 1 and time.time() - start < 90


def test_ink(parsed):
    (row,) = parsed("<div> a <b>b c</b><br> <i>\u00a0</i></div>").collect()
    assert [(e["tag"], e["ink"]) for e in row["elements"]] == [("div", 3), ("b", 2), ("br", 0), ("i", 0)]


def test_sql_form(spark):
    register_html_elements(spark)
    rows = spark.sql("SELECT e.tag, e.attrs['href'], e.text FROM html_elements('<a href=/x>t<br>u</a>') e").collect()
    assert [tuple(r) for r in rows] == [("a", "/x", "tu"), ("br", None, "")]


def values(df, *columns):
    return [tuple(r) for r in df.orderBy("page_id").select(*columns).collect()]


def test_selectors(parsed):
    df = parsed(
        '<div class="grid a"><div><h3>A</h3><a href="/q/x">l</a></div><p>t</p><div><span><h3> B </h3></span></div></div>'
        '<div><a href="http://y"><div class="v">go</div></a></div>'
    )

    def tags(sel):
        return F.transform(PAGE.select(sel), lambda e: F.concat(e["tag"], F.lit(":"), PAGE.trimmed(e)))

    grid = Sel(tags=("div",), classes=("grid",))
    (got,) = values(
        df, tags(Sel(tags=("div",), child_of=grid)), tags(Sel(tags=("h3",), inside=grid)),
        tags(Sel(tags=("a",), attr="href", op="prefix", value="http", holds=Sel(classes=("v",)))),
        tags(Sel(tags=("a",), attr="href", op="contains", value="/q/")), tags(Sel(part_class="ri")),
        tags(Sel(tags=("div",), after=Sel(tags=("p",)))), tags(Sel(tags=("p",), after=Sel(tags=("h3",)))),
        tags(Sel(text="B")), tags(Sel(classes=("none",))), tags(Sel(tags=("a",), attr="href", op="equals", value="http://y")),
    )
    assert got == (["div:Al", "div:B"], ["h3:A", "h3:B"], ["a:go"], ["a:l"], ["div:Alt B"], ["div:B"], [],
                   ["div:B", "span:B", "h3:B"], [], ["a:go"])


def test_following_sibling_skips_nested_text(parsed):
    usage = Sel(tags=("p",), after=Sel(text="How to use"))
    df = parsed(
        "<h2>How to use</h2><p>one</p>", "<h2>How to <b>use</b></h2> text <p>two</p>", "<h2>How to use</h2><i></i><p>no</p>",
        "<div><h2>How to use</h2></div><p>outer</p>", "<h2>how to use</h2><p>case</p>",
    )
    assert [v for (v,) in values(df, PAGE.first_text(usage))] == ["one", "two", None, "outer", None]


def test_texts_and_fallbacks(parsed):
    df = parsed("<h2> </h2><h2> x <b>y</b></h2><p>p1</p>", "<p>p1</p><p> p2</p>", "<i>")
    h2, p = Sel(tags=("h2",)), Sel(tags=("p",))
    assert values(df, PAGE.first_text(h2), PAGE.first_filled_text(h2), PAGE.texts(p), PAGE.text_or((h2,), (p,))) == [
        ("", "x y", ["p1"], "N/A"), (None, None, ["p1", "p2"], "p1  p2"), (None, None, [], "N/A"),
    ]


def test_selectors_from_a_table(spark, parsed):
    layout = ("field string, priority int, tag string, class_name string, class_part string, attr string, attr_op string, "
              "attr_value string, ancestor_class string")
    rows = [("who", 2, "h1 h2", None, None, None, None, None, None), ("who", 1, None, "n", None, None, None, None, "box"),
            ("site", 1, "a", None, None, "href", "prefix", "http", None)]
    registry = selectors_from(spark.createDataFrame(rows, layout))
    df = parsed('<i class=n>no</i><div class="box"><i class="m n">yes</i></div><a href="/x">l</a><a href="http://y">far</a>', "<h2>H</h2>")
    assert values(extract.fields_by(df, registry), "who", "site") == [("yes", "far"), ("H", "N/A")]


def test_selector_tables_can_say_what_the_registry_says(spark, parsed):
    layout = ("field string, tag string, attr string, attr_op string, attr_value string, text_part string, "
              "later_tag string, later_text string, parent_tag string, parent_class string, held_tag string")
    rows = [("main", None, "id", "equals", "main", None, None, None, None, None, None),
            ("visits", "span", None, None, None, None, "span", "Monthly Visits", None, None, None),
            ("price", "a", None, None, None, "Pricing", None, None, None, None, None),
            ("child", "li", None, None, None, None, None, None, "ul", "f", None),
            ("holder", "div", None, None, None, None, None, None, None, None, "b")]
    df = parsed('<div id=main>hello</div><p><span>Monthly Visits</span><i>x</i><span>12K</span></p><a>See Pricing</a>'
                '<ol><li>no</ol><ul class=f><li>yes</ul><div>a</div><div><i><b>held</b></i></div>')
    got = values(extract.fields_by(df, selectors_from(spark.createDataFrame(rows, layout))), "main", "visits", "price", "child", "holder")
    assert got == [("hello", "12K", "See Pricing", "yes", "held")]


def test_all_later_siblings_are_the_fallback(parsed):
    df = parsed("<div><span>Monthly Visits</span><b>x</b><span>12K</span><span>5K</span></div><p><span>other</span></p>", "<span>12K</span>")
    assert values(extract.registry_fields(df), "monthly_traffic") == [("12K 5K",), ("N/A",)]


def test_many_distinct_names_on_one_page(spark, parsed):
    from time import perf_counter

    def spent(n):
        html = "".join(f'<a href="/ai-tools/{i}">name {i}</a>' for i in range(n))
        df, start = parsed(f"<div>{html}</div>"), perf_counter()
        assert extract.listings(df, SITE).count() == n
        return perf_counter() - start

    spent(100)
    assert spent(8_000) < 8 * max(spent(2_000), 1.0)


def test_platform_links(parsed):
    df = parsed('<div class="s"><a href="https://x.twitter.com/a">t</a></div><a href="http://linkedin.com/b">l</a>')
    inside = extract.platform_links(PAGE, Sel(classes=("s",)))
    assert values(df, extract.platform_links(PAGE)["linkedin_link"], inside["twitter_link"], inside["linkedin_link"]) == [
        ("http://linkedin.com/b", "https://x.twitter.com/a", "N/A")
    ]


def test_cards_need_name_and_description(parsed):
    df = parsed(
        '<div class="tool-item"><h3> </h3><h4>N</h4><p class="description-x"> D </p><a href=" /l ">x</a><img src=" i ">'
        '</div><div class="tool-item"><h3>only name</h3></div>',
    )
    assert values(extract.cards(df), "ordinal", "name", "description", "link", "image_url") == [(1, "N", "D", "/l", "i")]


def test_listings_prefer_the_grid(parsed):
    grid = '<div class="grid"><div><h2>A</h2><a href="/ai-tools/a">x</a></div><div><h2>A</h2><a href="/ai-tools/b">x</a></div></div>'
    links = '<article><div><p>near</p><a href="/ai-tools/c">C</a></div><p>far</p></article><a href="/ai-tools/d">D</a>'
    got = values(extract.listings(parsed(grid + links, links, "<div class=grid><div><h2>B</h2></div></div>" + links), SITE),
                 "page_id", "ordinal", "name", "description", "pricing_link")
    base = SITE.base_url
    assert got == [(0, 1, "A", "N/A", f"{base}/ai-tools/a"), (1, 1, "C", "near", f"{base}/ai-tools/c"),
                   (2, 1, "C", "near", f"{base}/ai-tools/c")]


def test_no_results(parsed):
    df = parsed("<div class=grid><div>x</div></div>", "<div class=grid></div>", "<p>",
                "<div class=grid><div>x</div></div><b>No Results Found</b>")
    assert [v for (v,) in values(df, extract.has_no_results(PAGE, SITE))] == [False, True, True, True]


def test_faq_needs_both_parts(parsed):
    df = parsed('<div class="faq-section"><div class="qa-pair"><i class=question> q </i><i class=answer>a</i></div>'
                '<div class="qa-pair"><i class=answer>b</i></div></div><div class="qa-pair"><i class=question>x</i><i class=answer>y</i></div>')
    assert [(f["question"], f["answer"]) for f in values(df, extract.faq(PAGE))[0][0]] == [("q", "a")]


def test_image_sizes(parsed):
    df = parsed('<img src=a width=50 height="20px"><img src=b width=auto><img width=0 height=3.5>')
    (row,) = values(df, F.transform(extract.images(PAGE), lambda i: F.array(i["w"], i["h"])))
    assert row[0] == [[50.0, 20.0], [1.0, 1.0], [1.0, 3.5]]


def _images(spark, rows):
    return spark.createDataFrame(rows, "id int, pos int, name string, src string, alt string, w double, h double")


def test_external_logo_scores(spark):
    rows = [
        (1, 0, "Acme", "/Logo.png", "", 100.0, 100.0),     # 5 + 3 + 2
        (1, 1, "Acme", "//c/acme.png", None, 10.0, 40.0),  # 8
        (1, 2, "Acme", "data:image/png;base64,logo", "logo acme", 50.0, 50.0),
        (1, 3, "Acme", "https://c/x.png", "", 100.0, 100.0),  # 5 is not enough
        (1, 4, "", "https://c/icon.png", "any", 0.0, 0.0),    # no name: 5 + 3
        (1, 5, "Acme", None, "acme logo", 50.0, 50.0),
    ]
    got = logos.candidates(_images(spark, rows), "id", F.lit("https://own.site/p"))
    assert sorted((r["pos"], r["url"], r["score"]) for r in got.collect()) == [
        (0, "https://own.site/Logo.png", 10), (1, "https://c/acme.png", 8), (4, "https://c/icon.png", 8),
    ]


def test_directory_logo_scores(spark):
    rows = [
        (1, 0, "Acme", "https://cdn/a.png", "the ACME", 100.0, 100.0),  # 8 + 3
        (1, 1, "Acme", "https://zzz/a.png", "the ACME", 100.0, 100.0),  # 3
        (1, 2, "Acme", "/logo.png", "", 31.0, 31.0),                    # tiny
        (1, 3, "Acme", "/logo.png", "", 40.0, 400.0),                   # 5
        (1, 4, "Acme", "/logo.png", "", 40.0, 40.0),                    # 5 + 3
    ]
    got = logos.candidates(_images(spark, rows), "id", F.lit("https://d"), "cdn")
    assert sorted((r["pos"], r["score"]) for r in got.collect()) == [(0, 11), (4, 8)]


def test_best_logo_order(spark):
    rows = [(1, 3, "u3", 10, 50.0, 40.0), (1, 1, "u1", 10, 45.0, 40.0), (1, 2, "u2", 10, 40.0, 45.0), (1, 0, "u0", 9, 40.0, 40.0)]
    df = spark.createDataFrame(rows, "id int, pos int, url string, score int, w double, h double")
    assert [tuple(r) for r in logos.best(df, "id").collect()] == [(1, "u1", 10)]
