import pytest

from pageproof.functions import text as t
from pageproof.functions import urls as u

BASE = "https://www.example.com/blog/post"


@pytest.mark.parametrize(
    "build, given, wanted",
    [
        (t.normalize_text, " a  \t b　", "a b"),
        (t.normalize_text, None, ""),
        (t.content_key, "“It’s fine”…", "\"it's fine\""),
        (t.content_key, "  Trailing Period. ", "trailing period"),
        (t.decode_entities, "&amp;lt; &#8217; &#x2019;", "< ’ ’"),
        (t.decode_entities, "&ndash; stays", "&ndash; stays"),
        (t.decode_markup, "&amp;lt; &ndash; &nope;", "&lt; – &nope;"),
        (t.html_to_text, "<b>Infra</b>'s<br>next ​", "Infra's next "),
        (t.preview10, "a b c d e f g h i j k", "a b c d e f g h i j…"),
        (t.source_slug, "audit-sheets/Spring fixes_ home page - north.xlsx", "Spring-fixes-home-page-north"),
        (t.compact_timestamp, "2026-07-01T11:11:52.947Z", "2026-07-01T11-11-52"),
        (t.slug_segment, " /Blog/Post/ ", "blog/post"),
        (t.md_cell, "a|b\\c\nd", "a\\|b\\\\c<br>d"),
        (t.html_escape, "<a href='x'>&\"", "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"),
        (t.normalize_label, "Page URL (live)", "pageurllive"),
    ],
)
def test_text(value, build, given, wanted):
    assert value(lambda c: build(c), c=given) == wanted


def test_question_preview_cuts_at_a_word(value):
    long = 'Why "this" ' + "word " * 30
    out = value(lambda c: t.question_preview(c), c=long)
    assert out.startswith("Why 'this' word") and out.endswith("word…") and len(out) <= 91


def test_content_words_drop_stopwords_and_edges(value):
    assert value(lambda c: t.content_words(c), c="the quick, (brown) fox is quick") == ["quick", "brown", "fox"]


@pytest.mark.parametrize(
    "e, a, hit", [("a title", "a title - site", True), ("a title", "a title - ", False), ("a title", "a titles", False)]
)
def test_site_suffix(value, e, a, hit):
    assert value(lambda x, y: t.has_site_suffix(x, y), x=e, y=a) is hit


@pytest.mark.parametrize("a, b, hit", [("plans", "+ plans +", True), ("faq", "faq list", False), ("one two", "three", False)])
def test_heading_contained(value, a, b, hit):
    assert value(lambda x, y: t.heading_contained(x, y), x=a, y=b) is hit


@pytest.mark.parametrize(
    "href, wanted",
    [
        ("https://example.com/page", "https://example.com/page"),
        ("/about", "https://www.example.com/about"),
        ("next?b=2&a=1", "https://www.example.com/blog/next?a=1&b=2"),
        ("https://example.com/p?utm_source=x&UTM_Medium=y&id=1", "https://example.com/p?id=1"),
        ("https://example.com/p?fbclid=1&gclid=2", "https://example.com/p"),
        ("https://EXAMPLE.com/Page/", "https://example.com/Page"),
        ("https://example.com/", "https://example.com/"),
        ("https://example.com/p#part", "https://example.com/p"),
        ("http://example.com:80/a/../b/./c", "http://example.com/b/c"),
        ("mailto:a@b.c", "mailto:a@b.c"),
        (" tel:123 ", "tel:123"),
        ("#top", "#top"),
        ("//cdn.example.com/x", "https://cdn.example.com/x"),
        ("/café one", "https://www.example.com/caf%C3%A9%20one"),
        ("/s?q=a%20b&x", "https://www.example.com/s?q=a+b&x="),
    ],
)
def test_normalize_url(value, href, wanted):
    assert value(lambda h, b: u.normalize_url(h, b), h=href, b=BASE) == wanted


def test_relative_without_base_stays(value):
    assert value(lambda h, b: u.normalize_url(h, b), h=" about ", b="") == "about"


def test_resolve_keeps_absolute_spelling(value):
    assert value(lambda h, b: u.resolve_url(h, b), h="HTTPS://X.com/A/?ref=1", b=BASE) == "HTTPS://X.com/A/?ref=1"
    assert value(lambda h, b: u.resolve_url(h, b), h="/a", b=BASE) == "https://www.example.com/a"


def test_link_type_is_a_prefix_test(value):
    kind = lambda link: value(lambda l, p: u.link_type(l, p), l=link, p="https://a.com/x")
    assert (kind("https://a.com/y"), kind("https://a.com.evil/"), kind("https://b.com/")) == ("Internal", "Internal", "External")


def test_sql_names(spark):
    from pageproof.functions.sql import register_sql_functions

    names = register_sql_functions(spark)
    assert "pp_normalize_text" in names
    row = spark.sql("select pp_normalize_text('  a   b ') a, pp_is_url('https://x.y') b, pp_strip_edge_punct('..x!') c").first()
    assert tuple(row) == ("a b", True, "x")


def test_numeric_references_of_any_length(value):
    from pageproof.functions import text as t

    for raw in ("&#0000000000065;", "&#x00000000000041;", "&#65;"):
        assert value(lambda c: t.decode_entities(c), c=raw) == "A"
        assert value(lambda c: t.decode_markup(c), c=raw) == "A"


def test_functions_by_name_in_sql_equal_the_column_functions(spark):
    from pyspark.sql import functions as F

    from pageproof.functions import sql
    from pageproof.functions import text as t
    from pageproof.functions import urls as u

    sql.register_sql_functions(spark)
    links = [
        None, "", " /a/b/?utm_source=x&b=2&a=1#f ", "HTTP://Ex.com:80/A%20b/", "//cdn.x/y", "?q='it''s'", "mailto:a@b.c", "../up", "#top",
        "https://ex.com/?a=(1)&or(2)", "javascript:void(0)", "\\\\odd\\path", "x y", "https://u:p@ex.com:443", "Q &amp; A?! &#8211; don't",
    ]
    bases = ["https://Ex.com/c/d?x=1", "http://ex.com", "not a url", None]
    df = spark.createDataFrame([(a, b) for a in links for b in bases], "link string, base string")
    both = df.select(
        F.struct(u.normalize_url("link", "base"), u.resolve_url("link", "base"), u.link_href("link", "base"), u.link_type("link", "base"),
                 t.faq_key("link"), t.decode_entities("link")).cast("string").alias("want"),
        F.expr("cast(struct(pp_normalize_url(link, base), pp_resolve_url(link, base), pp_link_href(link, base), pp_link_type(link, base),"
               " pp_faq_key(link), pp_decode_entities(link)) as string)").alias("got"),
    )
    assert both.where("not (want <=> got)").collect() == []


def test_canonical_urls_are_known_by_their_shape_and_spelled_as_before(spark, monkeypatch):
    import random
    import re

    from pyspark.sql import functions as F

    from pageproof.functions import urls

    rng = random.Random(11)
    pieces = ["https://", "http://", "HTTP://", "/", "//", "a", "B", "..", ".", "x.com", "X.com", ":80", "?q=1", "#f", " ", "%20", "é", "~", "-", "_", "\n"]
    rows = [(i, "".join(["https://x.com/", *rng.choices(pieces, k=rng.randint(0, 5))][rng.random() < 0.3 :])) for i in range(3000)]
    rows += [(3000, None), (3001, "https://x.com/" + "a/" * 20_000 + "b"), (3002, "https://x.com"), (3003, "https://x.com/a\n")]
    frame = spark.createDataFrame(rows, "i long, url string")

    def spelled():
        return {r.i: r.u for r in frame.select("i", urls.normalize_url(F.col("url"), F.lit("https://x.com/p/")).alias("u")).collect()}

    fast = spelled()
    known = {i for i, u in rows if u and re.match(urls.CANONICAL.replace(r"\z", r"\Z"), u) and "/." not in u}
    monkeypatch.setattr(urls, "CANONICAL", r"\b\B")
    assert fast == spelled() and 200 < len(known) < 3000 and all(fast[i] == dict(rows)[i] for i in known)
