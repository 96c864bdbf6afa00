from pyspark.sql import functions as F

from shelfmark.functions import arrays, labels, sections, text, urls
from shelfmark.functions.base import WS_CHARS, first_filled, let, strip

BASE, MARK = "https://h", "logo.f3a91ce.png"


def test_match_text(evaluate):
    got = evaluate(text.match_text("c"), [" SEO & On-Page  ", "Ünï", "a b\n\tc", "", None])
    assert got == ["seo on page", "n", "a b c", "", None]


def test_display_text(evaluate):
    got = evaluate(text.display_text("c"), ["a & b|c", " a \u0085b ", "x_1 (y), z!?-.", "²Ⅵ一é", None])
    assert got == ["a  bc", "a b", "x_1 (y), z!?-.", "²Ⅵ一é", ""]


def test_description_text(evaluate):
    got = evaluate(text.description_text("c"), [
        "What is X? It sings. How to use X? Press.\nFAQ from X\nQ1", "What is\nX? a", "what is x? b", None,
    ])
    assert got == ["It sings. Press.", "What is X? a", "what is x? b", ""]


def test_dot_stops_at_newline_only(evaluate):
    # Java's dot also stops at \r and U+2028 unless told otherwise.
    got = evaluate(text.description_text("c"), ["What is a\rb? c", "What is a b? c"])
    assert got == ["c", "c"]


def test_qa_markers(evaluate):
    got = evaluate(text.without_qa_markers("c"), [
        "a Q1 A1 Q2 A2 b", "FAQ from X: 1\nrest", "FAQ from X", "a Q1\nA12\tb", None,
    ])
    assert got == ["a Q2 A2 b", "\nFrequently Asked Questions:\nrest", "FAQ from X", "a b", None]


def test_email(evaluate):
    got = evaluate(text.email_address("c", "desk@d.org"), [" A@B.Co ", "x@y", "x.y", "\tDESK@d.org", "", "N/A"])
    assert got == ["a@b.co", "", "", "", "", ""]


def test_slug(evaluate):
    got = evaluate(text.slug("c"), [" Foo: Bar/Baz_1-x ", "É t²", "a  b"])
    assert got == ["foo_barbaz_1-x", "é_t²", "a__b"]


def test_collapse_once(evaluate):
    got = evaluate(text.collapse_once("c"), ["a    b", "\n a\n\nb ", "a   b"])
    assert got == ["a  b", "a b", "a  b"]


def test_strip_all_white_space(evaluate):
    assert evaluate(strip("c"), [WS_CHARS + "a b" + WS_CHARS, "​x"]) == ["a b", "​x"]


def test_linked(evaluate):
    got = evaluate(text.linked("c", r"x\.com/\w+"), ["see X.com/ab", "http://q", None])
    assert got == ["https://X.com/ab", "", ""]
    assert evaluate(text.linked("c", r"at \((https?://[^)]+)\)"), ["at (http://a/b)"]) == ["http://a/b"]


def test_preview(evaluate):
    assert evaluate(text.preview("c", 3), ["abcdef", "ab"]) == ["abc", "ab"]


def test_clean_url(evaluate):
    got = evaluate(urls.clean_url("c", BASE, MARK), [
        "/a", "//c/a", "ftp://c", " http://x ", "", f"https://x/{MARK}", f"/{MARK}", "N/A", None,
    ])
    assert got == ["https://h/a", "https://c/a", "", "http://x", "", "", "", "", ""]


def test_absolute_url(evaluate):
    got = evaluate(urls.absolute_url("c", F.lit("https://h:8/p/q")), ["//c/a", "/a", "./a", "a", "http://z"])
    assert got == ["https://c/a", "https://h:8/a", "https://h:8/a", "a", "http://z"]


def test_asset_and_page_names(evaluate):
    assert evaluate(urls.asset_url("c", "full", "https://s"), ["A / B"]) == ["https://s/a__b_full.png"]
    assert evaluate(urls.base_name("c"), ["https://s/x/y.png"]) == ["y.png"]
    assert evaluate(urls.listing_page_url(F.lit("b"), "c"), [1, 2], "int") == ["b", "b/page/2"]


def test_sections(evaluate):
    whole = "WHAT IS Foo Bar. How to use Foo? Press it. core features 1. A 2. v2.0 x Use Cases #1 b  c #22 d FAQ z"
    assert evaluate(sections.short_description("c"), [whole, "none", None, "What is X? end\n"]) == ["Bar.", "", "", "end"]
    assert evaluate(sections.how_to_use("c"), [whole, ""]) == ["Press it.", ""]
    assert evaluate(sections.features("c"), [whole, "x"]) == [["A", "v", "0 x"], []]
    assert evaluate(sections.use_cases("c"), [whole, None]) == [["b", "c", "d"], []]


def test_section_links(evaluate):
    def one(name, value):
        return evaluate(sections.link_columns("c")[name], [value])[0]

    assert one("linkedin", "see LinkedIn.com/company/acme now") == "https://linkedin.com/acme"
    assert one("discord", "discordapp.com/x1\"") == "https://discord.gg/x1"
    assert one("youtube", "youtube.com/@me") == "https://youtube.com/me"
    assert one("facebook", "facebook.com/https://f.b/x") == "https://f.b/x"
    assert one("login", "login link:  http://a/b c") == "http://a/b"
    assert one("contact", "contact us page (https://a/c d)") == "https://a/c d"
    assert one("signup", "nothing") == ""


def test_clean_lists(evaluate):
    kind = "array<string>"
    assert evaluate(arrays.clean_features("c"), [[" a ", "", "a", "b"], None], kind) == [["a", "b"], []]
    links = ["https://t/intent/tweet", "http://b", "mailto:x", "https://a", "http://b"]
    assert evaluate(arrays.clean_social_links("c"), [links, None], kind) == [["http://b", "https://a"], []]
    assert evaluate(arrays.join_list("c"), [["a", "b|c"], None], kind) == ["a|b|c", ""]
    names = ["PPC Tools", "SEO Tools", "Rank Tracking", "zzz"]
    assert evaluate(labels.consolidate("c"), [names], kind) == [["Marketing & Advertising", "Other", "SEO Tools"]]


def test_cleaning_twice_changes_nothing(evaluate):
    kind, rows = "array<string>", [[" a", "b ", "a"], ["http://x", "y"], []]
    for clean in (arrays.clean_features, arrays.clean_social_links, labels.consolidate):
        assert evaluate(clean("c"), rows, kind) == evaluate(clean(clean("c")), rows, kind)
    texts = ["A & B — ü", "x\n\ny", " 1 2 "]
    assert evaluate(text.match_text("c"), texts) == evaluate(text.match_text(text.match_text("c")), texts)


def test_labels(evaluate):
    got = evaluate(labels.normalize_label("c"), [" SEO Tools\n", "seo tools", "AI SEO Tools", "Other", None])
    assert got == ["SEO Tools", "Other", "Other", "Other", "Other"]
    assert evaluate(labels.is_valid_category("c"), ["Other", "x", None]) == [True, False, False]
    assert len(labels.ALIASES) == 33


def test_label_prompt_keeps_whole_texts_and_braces(evaluate):
    long = "{name} " + "x" * 5000
    (prompt,) = evaluate(labels.label_prompt(F.lit("{description}"), "c"), [long])
    assert long in prompt and "Listing: {description}\n" in prompt and "- SEO Tools" in prompt
    assert "xxx" not in evaluate(labels.label_prompt(F.lit("n"), "c", max_chars=8), [long])[0]


def test_link_fields(evaluate):
    links = arrays.links_from_json("c")
    rows = ['["http://a", "b", "https://c"]', ' {"x": "http://a", "y": "n", "z": ""}', "plain", None, "[]", "{}"]
    assert evaluate(links["as_text"], rows) == ["http://a|https://c", "x: http://a", "", "", "", ""]
    assert evaluate(links["as_map"].isNotNull(), rows) == [False, True, False, False, False, True]


def test_nth_http(evaluate):
    fields = ("c", F.lit("x"), F.lit("http://b"))
    assert evaluate(arrays.nth_http(1, *fields), ["http://a", None]) == ["http://a", "http://b"]
    assert evaluate(arrays.nth_http(2, *fields), ["http://a", None]) == ["http://b", ""]


def test_parse_reply(evaluate):
    rows = ['{"k": 1}', '[{"k": 2}, {"k": 3}]', "[]", "oops", '{"k": ', None, "7"]
    assert evaluate(arrays.parse_reply("c", "k int")["k"], rows) == [1, 2, None, None, None, None, None]


def test_first_filled(evaluate):
    assert evaluate(first_filled("c", F.lit("z")), ["a", "", None]) == ["a", "z", "z"]


def test_let_keeps_the_value_out_of_the_lambda(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("t"))
    words = F.array(*[F.lit(w) for w in "abc"])
    bound = let(F.upper("t"), lambda v: F.filter(words, lambda w: F.contains(v, w)))
    plan = df.select(bound.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1 and "transform(array(upper(" in plan
