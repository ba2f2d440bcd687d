import pytest
from pyspark.sql import functions as F

from pageproof.functions.dom import faq_items, page_parts
from pageproof.operators import checks as C
from pageproof.operators import html as H

SCHEMA = "page_id long, url string, html string"


def parts(spark, html, url="https://x.com/a"):
    df = spark.createDataFrame([(1, url, html)], SCHEMA)
    full = H.with_faqs(H.with_body(H.with_head(df)))
    return full.select(
        "*",
        H.paragraph_units().alias("paragraphs"),
        H.scoped_links().alias("links"),
        H.scoped_bolds().alias("bold"),
        H.heading_texts(2).alias("h2"),
        H.page_title_h1().alias("h1"),
        H.full_text().alias("full"),
        H.h1_count().alias("h1_count"),
    ).first()


def test_field_check_page(spark):
    html = """<html><head><title>Example &amp; Co</title><meta name="description" content="A > B">
    <link rel="canonical" href="/home"><meta property="og:title" content="1"><meta property="og:title" content="2">
    <meta name="twitter:card" content="summary"></head><body><h1>One</h1><h1> </h1><h2>Two</h2><img src="a.png" alt="Logo"></body></html>"""
    r = C.page_facts(spark.createDataFrame([(1, "https://x.com/a/b", html)], SCHEMA)).first()
    assert (r.title, r.meta_description, r.canonical, r.h1_text, r.h2_text) == ("Example & Co", "A > B", "https://x.com/home", "One", "Two")
    assert [tuple(x) for x in r.og_tags] == [("og:title", "2")]
    assert [tuple(x) for x in r.images] == [("a.png", "Logo")]


def test_scope_and_outside_intro(spark):
    r = parts(
        spark,
        '<body><p>intro</p><ul><li>nav</li></ul><h1>Site</h1><article><h1>Post</h1><h2>A</h2><p>x <b>y</b><br>z<p>next'
        '<ul><li>one<li>two</ul><a href="/p?utm_source=q">go</a><a href="#top">up</a></article><a href="/out">out</a></body>',
    )
    assert r.h1 == "Post" and r.h1_count == 2 and r.h2 == ["A"]
    assert r.paragraphs == ["intro", "x yz", "next", "one", "two"]
    assert [tuple(x) for x in r.links] == [("go", "https://x.com/p")] and r.bold == ["y"]


def test_nested_blocks_take_the_tree_path(spark):
    r = parts(spark, "<main><blockquote><p>q</p></blockquote><ul><li>a<ul><li>b</li></ul></li></ul><figure><figcaption>c</figcaption></figure></main>")
    assert r.paragraphs == ["q", "q", "ab", "b", "c"] and r.scope == "main"


def test_class_scope_and_aria_headings(spark):
    r = parts(spark, '<div class="x post-content"><div role="heading" aria-level="2">Q</div><p>in</p></div><h2>out</h2>')
    assert r.scope == ".post-content" and r.h2 == ["Q"]


def test_unclosed_bold_ends_with_its_block(spark):
    assert parts(spark, "<article><p><b>a<br>c<p>d</article>").bold == ["ac"]


def test_script_text_is_not_markup(spark):
    r = parts(spark, '<body><script>var t="</p><h2>no</h2>";</script><!-- <p>no</p> --><article><p>yes</p></article></body>')
    assert r.paragraphs == ["yes"] and r.h2 == []


@pytest.mark.parametrize(
    "html, wanted",
    [
        ('<details><summary>Q</summary>A <b>x</b></details>', [(5, "Q", "A x")]),
        ('<button aria-expanded="false" aria-controls="p">Q</button><div id="p" hidden>A</div>', [(4, "Q", "A")]),
        # The item's own class says accordion, so the generic strategy has it.
        (
            '<div class="elementor-accordion-item"><a class="elementor-tab-title">Q</a><div class="elementor-tab-content">A</div></div>',
            [(2, "Q", "A")],
        ),
        ('<div><a class="elementor-tab-title">Q</a><div class="elementor-tab-content">A</div></div>', [(3, "Q", "A")]),
        (
            '<div class="accordion"><div class="accordion-item"><div class="accordion-item-trigger"><h3 class="a-heading">Q</h3></div>'
            '<div class="accordion-content">A<a href="#">Read</a></div></div></div>',
            [(2, "Q", "ARead")],
        ),
        (
            '<script type="application/ld+json">oops</script><script type="application/ld+json">[{"@graph":[{"@type":"FAQPage","mainEntity":'
            '[{"name":" Q ","acceptedAnswer":{"text":"A"}},{"name":"no answer"}]}]}]</script><details><summary>x</summary>y</details>',
            [(1, "Q", "A")],
        ),
        ("<p>Q</p><p>A</p>", []),
    ],
)
def test_faq_strategies(spark, html, wanted):
    assert [tuple(f) for f in parts(spark, f"<body>{html}</body>").faqs] == wanted


def test_tree_and_flat_paths_agree_on_flat_markup(spark):
    html = '<body><nav><ul><li><a href="/n">n</a></li></ul></nav><article><h1>T &amp; U</h1><p><b>one<br><p>two <i>x</i></p><h2>h</h2><p>three</p></article><footer>f</footer></body>'
    tree = page_parts(html)
    flat = parts(spark, html)
    assert [(b["kind"], b["text"], b["in_scope"]) for b in tree["blocks"]] == [tuple(b) for b in flat.blocks]
    assert [(a["text"], a["href"]) for a in tree["anchors"]] == [(a.text, a.href) for a in flat.anchors]
    assert [b["text"] for b in tree["bolds"]] == [b.text for b in flat.bolds]


def test_first_content_element_around_a_heading():
    items = faq_items('<div class="accordion"><h3 class="title">Q</h3><div class="body"> </div><div class="panel">A</div></div>')
    assert items == [{"strategy": 2, "question": "Q", "answer": "A"}]


def test_extraction_is_one_narrow_pass(spark):
    """No shuffle, and the tree call is fed through the flag."""
    df = H.with_body(spark.createDataFrame([(1, "u", "<article><p>a</p></article>")], SCHEMA))
    plan = df.select("blocks")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    assert "CASE WHEN _deep" in df._jdf.queryExecution().analyzed().toString().replace("CASE WHEN (_deep", "CASE WHEN _deep")
