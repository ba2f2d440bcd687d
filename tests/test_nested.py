"""FAQ markup read from nesting intervals, held against the tree helper."""

import random

import pytest
from pyspark.sql import functions as F

from pageproof.functions.dom import faq_items
from pageproof.operators import html as H
from pageproof.operators.nested import DEEPEST, nested_faqs

NESTED = [
    "<details><p>B</p><summary>Q <details><summary>in</summary>x</details></summary>A &amp; <b>x</b></details>",
    '<button aria-expanded="false" aria-controls="p">Q</button><div id="p">A<div id=p>second</div></div>',
    '<div title="a > b" ARIA-Controls=x aria-expanded>1 < 2</div><span id=x>q<br/>r</span>',
    '<details><summary>Q</summary>A<script>if (a<b) "<p>&amp;</p>"</script><!-- <p>no --></details>',
    '<div class="accordion"><h3 class="title">Q</h3><div class="body"> </div><div class="panel">A</div></div>',
    '<i class="elementor-tab-title">Q</i><i class="elementor-tab-content">A</i>',
    "",
]
REPAIRED = [
    "<ul><li>a<li>b</ul><details><summary>Q</summary>A</details>",
    "<details><summary>Q<b></summary>A</b></details>",
    "<p>x<details><summary>Q</summary>A</details></p>",
    "<details><summary>Q</summary>A",
    '<details class="a"b"><summary>Q</summary>A</details>',
    "<div>" * (DEEPEST + 1) + "<details><summary>Q</summary>A</details>" + "</div>" * (DEEPEST + 1),
]


def read(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    rows = df.select("i", nested_faqs().alias("faqs")).orderBy("i").collect()
    return [None if r.faqs is None else [tuple(f) for f in r.faqs] for r in rows]


def tree(html):
    return sorted(((f["strategy"], f["question"], f["answer"]) for f in faq_items(html)), key=lambda f: f[0])


def test_nesting_pages_equal_the_tree_and_others_are_left_to_it(spark):
    assert read(spark, NESTED) == [tree(h) for h in NESTED]
    assert read(spark, [*REPAIRED, None]) == [None] * (len(REPAIRED) + 1)


def random_page(rng, depth=0):
    words = ["one", "two &lt;", "a < b", "caf&eacute;", " ", "x"]
    names = ["div", "span", "section", "details", "summary", "p", "ul", "li", "a", "h3", "button", "table", "tr", "td"]
    classes = ["accordion", "accordion-item", "x-trigger", "heading", "content", "answer panel", "elementor-tab-title",
               "elementor-tab-content", "elementor-accordion-item", "plain"]
    out = []
    for _ in range(rng.randint(1, 4)):
        if depth > 4 or rng.random() < 0.35:
            out.append(rng.choice(words + ["<br>", "<!-- c -->", "<img alt='>'>"]))
            continue
        name = rng.choice(names)
        attrs = f' class="{rng.choice(classes)}"' if rng.random() < 0.6 else ""
        attrs += f" id=p{rng.randint(0, 3)}" if rng.random() < 0.3 else ""
        attrs += f" aria-expanded aria-controls='p{rng.randint(0, 4)}'" if rng.random() < 0.2 else ""
        end = f"</{name}>" if rng.random() > 0.01 else ""
        out.append(f"<{name}{attrs}>{random_page(rng, depth + 1)}{end}")
    return "".join(out)


def test_random_markup_equals_the_tree(spark):
    rng = random.Random(7)
    pages = [random_page(rng) for _ in range(1500)]
    found = read(spark, pages)
    wrong = [(p, f, tree(p)) for p, f in zip(pages, found) if f is not None and f != tree(p)]
    assert not wrong, wrong[0]
    kept = [f for f in found if f is not None]
    assert len(kept) > 300 and {f[0] for row in kept for f in row} == {2, 3, 4, 5}


@pytest.mark.parametrize("html", [NESTED[0], REPAIRED[0]])
def test_either_path_gives_the_first_strategy(spark, html):
    both = html + '<button aria-expanded="true" aria-controls="z">Z</button><div id="z">last</div>'
    rows = H.with_faqs(spark.createDataFrame([(both,), (None,), ("",)], "html string")).select("faqs").collect()
    assert [[tuple(f) for f in r.faqs] for r in rows] == [[(4, "Z", "last")], [], []]


def test_long_pages_take_one_pass(spark):
    """Tokens of a long page are folded once: 20,000 flat elements."""
    page = "<div><span class='plain'>x</span></div>" * 10000 + "<details><summary>Q</summary>A</details>"
    assert read(spark, [page]) == [[(5, "Q", "A")]]
    assert spark.range(1).select(F.size(nested_faqs(F.lit("<details><summary>Q</summary>A</details>")))).first()[0] == 1
