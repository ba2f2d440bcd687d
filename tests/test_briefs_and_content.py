import pytest
from pyspark.sql import functions as F

from pageproof.operators import briefs as B
from pageproof.operators import content as K
from pageproof.operators.similar import best_similar, similar_across_corpus

URL = "https://x.com/blog/post"


def brief(spark, html):
    return B.brief_content(spark.createDataFrame([(1, URL, html)], "doc_id long, url string, html string")).first()


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("<p>Meta Title: A – B</p><p>Canonical: https://x.com/a Focus Keyword: k</p>", {"meta_title": "A – B", "canonical": "https://x.com/a"}),
        ("<p>Met Description - d</p><p>SEO Slug: my-post-slug-2026</p>", {"meta_description": "d", "slug": "my-post-slug-2026"}),
        ("<p>Meta Title:<br>Next line<br>Body</p>", {"meta_title": "Next line", "title": "Body"}),
        ("<p>x<br>Slug:</p><p>/the/value</p><p>after</p>", {"slug": "/the/value", "paragraphs": ["after"], "title": "x"}),
        ("<p>Slug:</p><p>Category: c</p><p>t</p>", {"slug": None, "title": "t"}),
        ("<p>Slug:</p><p>Slug: late</p>", {"slug": None}),
        ("<table><tr><td>Meta Title</td><td>T &amp; U</td></tr><tr><td>only</td></tr></table>", {"meta_title": "T & U"}),
        ("<p><strong>​Title:</strong> Named</p><h1>Real</h1>", {"title": "Named"}),
        ("<h3>First</h3><p>body</p><h3>Later</h3>", {"title": "First", "h3": ["Later"], "paragraphs": ["body"]}),
        ("<h3>First</h3>", {"title": None, "h3": ["First"]}),
        ("<p>lead</p><p>body</p>", {"title": "lead", "paragraphs": ["body"]}),
        ("<p>t</p><p>-----</p><p>“—”</p><p>​</p><p>b</p>", {"title": "t", "paragraphs": ["b"]}),
        ("<h1>t</h1><p>Is it? (H4)<br>Yes.<br>Really.</p><h2>Deep - H3</h2>", {"h4": ["Is it?"], "paragraphs": ["Yes. Really."], "h3": ["Deep"], "h2": []}),
        ("<h1>t</h1><ul><li>one</li><li>Meta Title: kept</li></ul>", {"paragraphs": ["one", "Meta Title: kept"], "meta_title": None}),
        (
            '<h1>t</h1><p><b>Meta Title:</b> x</p><p><strong>bold (H2)</strong> <a href="/a?utm_source=q">go</a> <a href="mailto:x">m</a></p>',
            {"bolds": ["bold"], "links": [("go", "https://x.com/a")]},
        ),
    ],
)
def test_brief_fields_and_items(spark, html, wanted):
    r = brief(spark, html).asDict()
    if "links" in wanted:
        r["links"] = [tuple(x) for x in r["links"]]
    assert {k: r[k] for k in wanted} == wanted


P = [
    "Managed farmland communities offer families a calm weekend retreat from crowded city living.",
    "Solar panels installed across every shared rooftop power common lighting through the monsoon season.",
    "Residents plant native fruit orchards together while experienced agronomists guide soil preparation.",
    "Weekly markets connect growers directly with neighbours seeking seasonal organic vegetables.",
]


def pair(spark, expected=None, actual=None):
    blank = {"title": "T", "meta_title": None, "meta_description": None, "canonical": None, "h2": [], "h3": [], "h4": [], "paragraphs": [], "links": [], "bolds": []}
    e = {**blank, "slug": None, **(expected or {})}
    a = {**blank, "h1_count": 1, **(actual or {})}
    types = {"title": "string", "meta_title": "string", "meta_description": "string", "canonical": "string", "slug": "string", "h1_count": "int", "links": "array<struct<text:string,url:string>>"}
    ddl = ["pair_id long", "url string"] + [f"{s}_{k} {types.get(k, 'array<string>')}" for s, d in (("e", e), ("a", a)) for k in d]
    return spark.createDataFrame([(1, URL, *e.values(), *a.values())], ", ".join(ddl))


def paragraphs(spark, e, a):
    return [(r.status, r.message) for r in K.paragraph_results(pair(spark, {"paragraphs": e}, {"paragraphs": a})).orderBy("seq").collect()]


OK = ("passed", "Paragraph matches the approved document.")


@pytest.mark.parametrize(
    "actual, wanted",
    [
        (P, [OK] * 4),
        (["Something new."] + P, [OK] * 4),
        (P[:2] + ["Something new."] + P[2:], [OK] * 4),
        (P[:1] + P[2:], [OK, ("failed", "Paragraph is missing from the live page."), OK, OK]),
        (P[1:] + P[:1], [("warning", "Paragraph is unchanged but has moved (expected around position 1, found at position 4)."), OK, OK, OK]),
        ([p.upper().rstrip(".") for p in P], [OK] * 4),
    ],
)
def test_paragraph_order(spark, actual, wanted):
    assert paragraphs(spark, P, actual) == wanted


def test_changed_paragraph_has_a_diff(spark):
    rows = K.paragraph_results(pair(spark, {"paragraphs": P[:1]}, {"paragraphs": [P[0].replace("calm", "quiet")]})).collect()
    assert rows[0].message == 'Paragraph text has changed — 1 word changed (e.g. "calm" → "quiet").'
    assert [tuple(d) for d in rows[0].diff if d.type != "same"] == [("changed", "calm", "quiet")]


def test_heading_tiers(spark):
    e = {"h2": ["Same", "Swapped two", "Swapped one", "Wrapped heading", "Lower level", "Bold one", "Planning a farmland retreat weekend", "Nowhere"]}
    a = {"h2": ["Same:", "Swapped one", "Swapped two", "+ Wrapped heading +", "Planning a farmland retreat holiday weekend"], "h3": ["lower level"], "bolds": ["BOLD ONE"]}
    got = [(r.status, r.check_type) for r in K.heading_results(pair(spark, e, a), 2).orderBy("seq").collect()]
    assert [g[0] for g in got] == ["passed", "warning", "passed", "warning", "warning", "warning", "failed", "failed"]
    assert got[7][1] == "H2 #8"


def test_links(spark):
    e = [("Plans", "u1"), ("Plans", "u1"), ("Old text", "u2"), ("Read", "u3"), ("Gone", "u9")]
    a = [("plans", "u1"), ("New text", "u2"), ("Read", "u4"), ("Card", "u5"), ("Card", "u5")]
    got = [(r.family, r.status, r.actual) for r in K.link_results(pair(spark, {"links": e}, {"links": a})).orderBy("family", "seq").collect()]
    assert got[:5] == [
        ("link", "passed", "Plans → u1"), ("link", "failed", "plans → u1"), ("link", "failed", "New text → u2"), ("link", "failed", "Read → u4"), ("link", "failed", None),
    ]
    assert [g[2] for g in got[5:]] == ["New text → u2", "Read → u4", "Card → u5"]


def test_bolds(spark):
    e = {"bolds": ["One", "One", "Head", "Anchor", "Lost"], "links": [("anchor", "u")]}
    got = [(r.check_type, r.status) for r in K.bold_results(pair(spark, e, {"bolds": ["one", "More", "more"], "h3": ["head"]})).orderBy("family", "seq").collect()]
    assert got == [('Bold: "One"', "passed"), ('Bold: "One"', "failed"), ('Bold: "Head"', "passed"), ('Bold: "Anchor"', "skipped"), ('Bold: "Lost"', "failed"), ('Bold (extra): "More"', "warning")]


def test_single_values(spark):
    e = {"meta_title": "The Title.", "meta_description": "Same", "canonical": None, "slug": "/Blog/post/"}
    a = {"meta_title": "the title – Site", "meta_description": "Other", "canonical": URL + "/?utm_source=x", "h1_count": 2}
    got = {r.check_type: r.status for r in K.value_rows(pair(spark, e, a), K.standard_values()).collect()}
    assert got == {
        "Meta Title": "passed", "Meta Description": "failed", "Blog Title (H1)": "passed", "H1 Tag Count": "failed", "Canonical URL": "passed", "Blog URL / Slug": "passed",
    }


def test_similar_prefix_join_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    vocab = [f"word{i}" for i in range(14)]
    texts = lambda n: [(i, " ".join(rng.choices(vocab, k=rng.randint(2, 9)))) for i in range(n)]
    e, a = texts(40), texts(60)

    def brute(words):
        best = None
        for j, text in a:
            other = set(text.split())
            shared = len(words & other)
            score = shared / max(len(words), len(other))
            if shared >= 3 and score >= 0.65 and (best is None or score > best[1]):
                best = (j, score)
        return best

    want = {i: brute(set(text.split())) for i, text in e}
    want = {i: (b[0], round(b[1], 9)) for i, b in want.items() if b}
    ed = spark.createDataFrame(e, "e_id long, e_key string")
    ad = spark.createDataFrame(a, "a_id long, a_key string")
    for out in (best_similar(ed.withColumn("g", F.lit(1)), ad.withColumn("g", F.lit(1)), ["g"]), similar_across_corpus(ed, ad)):
        assert {r.e_id: (r.a_id, round(r.score, 9)) for r in out.collect()} == want


def test_copies_enter_the_corpus_join_once(spark):
    e = spark.createDataFrame([(i, "alpha beta gamma delta") for i in range(50)], "e_id long, e_key string")
    a = spark.createDataFrame([(i + 7, "delta gamma beta alpha") for i in range(300)], "a_id long, a_key string")
    got = similar_across_corpus(e, a).collect()
    assert len(got) == 50 and {r.a_id for r in got} == {7}
