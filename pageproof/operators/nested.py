"""Nested markup on the JVM: elements as intervals of a page's tokens.

The page is cut into tokens; one fold over its tags keeps the open elements and
gives every candidate (start, end, path), where the path holds the starts of the
elements around it, -1 for the page first. Containment is then a membership test and text a slice of
the tokens, so FAQ markup is found in the row, without shuffle or Python.

The fold follows markup whose tags nest. A page where a tree builder would repair
something (end tags left out, crossed tags, blocks in a paragraph, attributes
outside the strict syntax) gives NULL and is left to
:mod:`pageproof.functions.dom`, and so is one nested deeper than ``DEEPEST``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageproof.functions import text as t
from pageproof.functions.dom import CLOSES_P, CONTENT_CLASSES, HEADING_CLASSES, VOID

#: Elements open at one time; the fold copies them at every tag.
DEEPEST = 200

_ATTR = r"""\s++([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+"""
_ATTRS = "(?:" + _ATTR.replace("([^", "(?:[^", 1).replace('("[^"]', '(?:"[^"]', 1) + ")*+"
_RAW = rf"(?i:<(script|style){_ATTRS}\s*+>[\s\S]*?</\1\s*+>)"
_TAG = rf"</?+[a-zA-Z][a-zA-Z0-9-]*+{_ATTRS}\s*+/?+>"
_STRAY = "<[a-zA-Z/!?]"
_TOKEN = rf"<!--[\s\S]*?-->|{_RAW}|{_TAG}|<!(?i:doctype)[^>]*+>|<(?![a-zA-Z/!?])|[^<]++|{_STRAY}"
# Markup that a tree builder reads by rules of its own.
_UNLIKE = (
    r"(?i)<!--?>|<!--->|--!>|<plaintext|</[a-z][^\s>]*\s[^>]*=|<(?:script|style)\b[^>]*/>"
    r"|<(title|textarea)\b[^>]*>[^<]*<(?!/\1)|<(iframe|xmp|noembed|noframes)\b[^>]*>[^<&]*(?:&|<(?!/\2))"
)
_MAY_MATTER = "(?i)" + "|".join(("accordion", "elementor-tab", *HEADING_CLASSES, *CONTENT_CLASSES, "aria-controls", r"\sid\s*="))

# Parents that keep an element from ending an open one of its kind.
_RIGHT_PARENT = {
    ("li",): ("ul", "ol", "menu"),
    ("dt", "dd"): ("dl",),
    ("td", "th"): ("tr",),
    ("tr",): ("table", "tbody", "thead", "tfoot"),
}
_STACK = "array<struct<name:string,at:int,found:boolean>>"
_SPANS = "array<struct<at:int,till:int,path:array<int>>>"
_PAIRS = "array<struct<strategy:int,question:string,answer:string>>"


def tag_attributes(tag: Column) -> Column:
    """Attributes of a start tag by lower-case name, the first of a name; values decoded."""
    found = F.transform(
        F.regexp_extract_all(tag, F.lit(_ATTR), F.lit(0)),
        lambda a: F.struct(
            F.lower(F.regexp_extract(a, "^" + _ATTR, 1)).alias("name"),
            t.decode_markup(F.regexp_replace(F.regexp_extract(a, "^" + _ATTR, 2), r"""(?s)^(["'])(.*)\1$""", "$2")).alias("value"),
        ),
    )
    first = lambda every: F.filter(every, lambda a, i: ~F.exists(F.slice(every, F.lit(1), i), lambda b: b["name"] == a["name"]))
    return t.let(found, lambda every: F.map_from_entries(first(every)))


def _tokens(html: Column) -> Column:
    """Tokens with ``sign`` (1 opens, -1 closes, 0 neither), tag name and whether
    the element may matter."""

    def parsed(token, at):
        raw = token.rlike("^(?i)<(?:script|style)[^>]*>") & token.rlike("(?i)</(?:script|style)\\s*>$")
        tag = token.startswith("<") & (F.length(token) > 2) & ~token.startswith("<!") & ~raw
        name = F.lower(F.regexp_extract(token, "^</?([a-zA-Z][a-zA-Z0-9-]*)", 1))
        sign = F.when(~tag | name.isin(*sorted(VOID)), 0).when(token.startswith("</"), -1).otherwise(1)
        inner = F.regexp_replace(token, r"(?i)^<(?:script|style)[^>]*>|</(?:script|style)\s*>$", "")
        return F.struct(
            at.cast("int").alias("at"),
            sign.alias("sign"),
            F.when(tag, name).alias("name"),
            (tag & (name.isin("details", "summary") | token.rlike(_MAY_MATTER))).alias("found"),
            F.when(raw, inner).when(token.startswith("<") & (token != "<"), "").otherwise(t.decode_markup(token)).alias("text"),
            F.when(tag, token).alias("tag"),
            token.rlike(f"^{_STRAY}$").alias("stray"),
        )

    return F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), parsed)


def _spans(tokens: Column) -> Column:
    """(at, till, path) of the candidates in order of their start; NULL if the tags don't nest."""
    is_open = lambda stack, *names: F.exists(stack, lambda e: e["name"].isin(*names))
    start = F.struct(F.array().cast(_STACK).alias("stack"), F.array().cast(_SPANS).alias("spans"), F.lit(True).alias("ok"))

    def fits(stack, name):
        parent = F.coalesce(F.get(stack, F.size(stack) - 1)["name"], F.lit(""))
        rule = F.when(name.isin(*sorted(CLOSES_P)) & is_open(stack, "p"), False)
        rule = rule.when((name == "a") & is_open(stack, "a"), False).when(name.isin("script", "style"), False)
        for names, parents in _RIGHT_PARENT.items():
            rule = rule.when(name.isin(*names), parent.isin(*parents) | ~is_open(stack, *names))
        return rule.when(name.isin("tbody", "thead", "tfoot"), parent == "table").otherwise(F.size(stack) < DEEPEST)

    def step(state, token):
        stack, spans = state["stack"], state["spans"]
        top = F.get(stack, F.size(stack) - 1)
        opens = token["sign"] == 1
        fine = F.when(opens, fits(stack, token["name"])).otherwise(F.coalesce(top["name"] == token["name"], F.lit(False)))
        entry = F.struct(token["name"].alias("name"), token["at"].alias("at"), token["found"].alias("found"))
        shorter = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        span = F.struct(top["at"].alias("at"), token["at"].alias("till"), F.concat(F.array(F.lit(-1)), F.transform(shorter, lambda e: e["at"])).alias("path"))
        taken = ~opens & F.coalesce(top["found"], F.lit(False))
        moved = F.struct(
            F.when(opens, F.concat(stack, F.array(entry))).otherwise(shorter).alias("stack"),
            F.when(taken, F.concat(spans, F.array(span))).otherwise(spans).alias("spans"),
            F.lit(True).alias("ok"),
        )
        stopped = F.struct(stack.alias("stack"), spans.alias("spans"), F.lit(False).alias("ok"))
        return F.when(~state["ok"], state).when(fine, moved).otherwise(stopped)

    folded = F.aggregate(F.filter(tokens, lambda k: k["sign"] != 0), start, step)
    whole = lambda s: s["ok"] & ~F.exists(s["stack"], lambda e: e["found"])
    return t.let(folded, lambda s: F.when(whole(s), F.array_sort(s["spans"])))


@t.by_name
def nested_faqs(html="html") -> Column:
    """Question and answer pairs of every markup strategy, numbered by preference:
    2 class-named accordions, 3 tab widgets, 4 ARIA triggers, 5 details; each in
    document order. NULL for a NULL page and for one whose tags don't nest."""

    def from_tokens(tokens):
        spans = F.when(~F.exists(tokens, lambda k: k["stray"]), _spans(tokens))
        element = lambda s: F.struct(
            s["at"].alias("at"), s["till"].alias("till"), s["path"].alias("path"),
            F.get(tokens, s["at"])["name"].alias("name"), tag_attributes(F.get(tokens, s["at"])["tag"]).alias("attrs"),
        )
        return t.let(F.transform(spans, element), lambda elements: _pairs(tokens, elements))

    html = F.col(html) if isinstance(html, str) else html
    return F.when(~html.rlike(_UNLIKE), t.let(_tokens(html), from_tokens))


def _pairs(tokens: Column, elements: Column) -> Column:
    between = lambda a, b: F.array_join(F.transform(F.slice(tokens, a + 2, F.greatest(b - a - 1, F.lit(0))), lambda k: k["text"]), "")
    text = lambda e: t.normalize_text(between(e["at"], e["till"]))
    attr = lambda e, name: F.coalesce(F.try_element_at(e["attrs"], F.lit(name)), F.lit(""))
    classed = lambda e, parts: attr(e, "class").rlike("|".join(parts))
    is_class = lambda e, name: F.array_contains(F.split(attr(e, "class"), r"\s+"), name)
    starts = lambda es: F.transform(es, lambda e: e["at"])
    pair = lambda n, question, answer: F.struct(
        F.lit(n).alias("strategy"), question.alias("question"), F.coalesce(answer, F.lit("")).alias("answer")
    )
    last = lambda items: F.get(items, F.size(items) - 1)

    def accordions(around):
        heads = F.filter(elements, lambda e: classed(e, HEADING_CLASSES) & F.arrays_overlap(e["path"], around))
        # In document order a head that holds another one holds the next one.
        leaf = lambda every: F.filter(every, lambda e, i: F.coalesce(F.get(every, i + 1)["at"] > e["till"], F.lit(True)))
        contents = F.transform(
            F.filter(elements, lambda e: classed(e, CONTENT_CLASSES)),
            lambda e: F.struct(e["at"].alias("at"), e["path"].alias("path"), text(e).alias("text")),
        )

        def answer(head, filled):
            nearest = F.slice(F.reverse(head["path"]), 1, 5)
            free = F.filter(filled, lambda c: (c["at"] != head["at"]) & ~F.array_contains(head["path"], c["at"]))
            inside = lambda free_, a: F.get(F.filter(free_, lambda c: F.array_contains(c["path"], a)), F.lit(0))["text"]
            found = t.let(free, lambda free_: F.transform(nearest, lambda a: inside(free_, a)))
            return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))

        filled = F.filter(contents, lambda c: c["text"] != "")
        return t.let(filled, lambda fs: F.transform(t.let(heads, leaf), lambda h: pair(2, text(h), answer(h, fs))))

    around = starts(F.filter(elements, lambda e: attr(e, "class").contains("accordion")))
    classes = t.let(around, accordions)

    def tabs(items):
        def one(title):
            own = F.filter(F.concat(title["path"], F.array(title["at"])), lambda a: F.array_contains(items, a))
            box = F.coalesce(last(own), last(title["path"]))
            held = lambda b: F.filter(elements, lambda e: is_class(e, "elementor-tab-content") & F.array_contains(e["path"], b))
            return pair(3, text(title), t.let(t.let(box, held), lambda hit: F.when(F.size(hit) > 0, text(F.get(hit, F.lit(0))))))

        return F.transform(F.filter(elements, lambda e: is_class(e, "elementor-tab-title")), one)

    widgets = t.let(starts(F.filter(elements, lambda e: is_class(e, "elementor-accordion-item"))), tabs)

    def controlled(trigger):
        wanted = attr(trigger, "aria-controls")
        hit = t.let(wanted, lambda w: F.filter(elements, lambda e: (w != "") & (attr(e, "id") == w)))
        return pair(4, text(trigger), t.let(hit, lambda h: F.when(F.size(h) > 0, text(F.get(h, F.lit(0))))))

    has = lambda e, name: F.map_contains_key(e["attrs"], name)
    aria = F.transform(F.filter(elements, lambda e: has(e, "aria-controls") & has(e, "aria-expanded")), controlled)

    def opened(details):
        hit = F.filter(elements, lambda e: (e["name"] == "summary") & F.array_contains(e["path"], details["at"]))
        rest = lambda s: t.normalize_text(F.concat(between(details["at"], s["at"]), between(s["till"], details["till"])))
        return t.let(F.get(hit, F.lit(0)), lambda s: pair(5, F.when(s.isNotNull(), text(s)).otherwise(""), F.when(s.isNotNull(), rest(s))))

    disclosures = F.transform(F.filter(elements, lambda e: e["name"] == "details"), opened)
    every = F.concat(*[x.cast(_PAIRS) for x in (classes, widgets, aria, disclosures)])
    return F.when(elements.isNotNull(), F.filter(every, lambda p: (p["question"] != "") & (p["answer"] != "")))
