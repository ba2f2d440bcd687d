"""Element extraction over page snapshots.

One page is one row, so everything here is a narrow projection: the markup is
cut at block tags into an array, and text, scope and attributes are read from
the array with higher-order functions. No shuffle, no sort, no page split
across tasks. Each result is its own column, so a job that needs titles only
never cuts blocks.

Pages whose nesting defeats a flat cut (blocks inside list items or quotes,
nested containers, class-named containers, ``aria-level`` headings) are
flagged by a JVM test and go through :mod:`pageproof.functions.dom` instead;
the Arrow call receives NULL for all other pages, in the same single scan.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageproof.functions import text as t
from pageproof.functions import urls as u
from pageproof.operators.nested import nested_faqs

BLOCK_TAGS = (
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer "
    "form h[1-6] header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul"
).split()
_CUT = "\x01"
_BLOCK = r"(?i)(</?(?:" + "|".join(BLOCK_TAGS) + r")(?:[\s/][^>]*)?>)"
_TAG = r"</?[a-zA-Z][^>]*>|<![^>]*>"
_QUOTED = r"""[^>"']*(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
_CLASS_SCOPES = r"""(?i)(?:class|id)\s*=\s*["'][^"']*(?:post-content|entry-content|blog-content|article-content|content)"""
_FAQ_MARKERS = "(?i)accordion|elementor-tab-title|aria-controls|<details"

_TEXT = T.StructField("text", T.StringType())
_FLAG = T.StructField("in_scope", T.BooleanType())
_KIND = T.StructField("kind", T.StringType())
_HREF = T.StructField("href", T.StringType())
PARTS_TYPE = T.StructType(
    [
        T.StructField("scope", T.StringType()),
        T.StructField("blocks", T.ArrayType(T.StructType([_KIND, _TEXT, _FLAG]))),
        T.StructField("anchors", T.ArrayType(T.StructType([_TEXT, _HREF, _FLAG]))),
        T.StructField("bolds", T.ArrayType(T.StructType([_TEXT, _FLAG]))),
    ]
)
FAQ_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("strategy", T.IntegerType()),
            T.StructField("question", T.StringType()),
            T.StructField("answer", T.StringType()),
        ]
    )
)


@F.pandas_udf(PARTS_TYPE)
def _dom_parts(html: pd.Series) -> pd.DataFrame:
    from pageproof.functions.dom import page_parts

    empty = {"scope": None, "blocks": None, "anchors": None, "bolds": None}
    rows = [empty if h is None else page_parts(h) for h in html]
    return pd.DataFrame(rows, columns=list(empty))


@F.pandas_udf(FAQ_TYPE)
def _dom_faqs(html: pd.Series) -> pd.Series:
    from pageproof.functions.dom import faq_items

    return pd.Series([None if h is None else faq_items(h) for h in html], dtype=object)


# Not deterministic for the optimiser only: it keeps a filter inferred further
# up (for instance from explode) from pulling a second call below itself.
_dom_parts = _dom_parts.asNondeterministic()
_dom_faqs = _dom_faqs.asNondeterministic()


def attr(tag, name: str) -> Column:
    """Attribute of one start tag: NULL when absent, '' when empty."""
    lead = r"""(?i)[\s"'/]""" + name
    found = lead + r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    read = lambda v: t.decode_markup(F.concat(*[F.regexp_extract(v, found, g) for g in (1, 2, 3)]))
    return t.let(
        tag,
        lambda v: F.when(v.rlike(found), read(v)).when(v.rlike(lead + r"(?:[\s>/]|=\s*>|$)"), F.lit("")),
    )


def page_text(c) -> Column:
    """Text content of a fragment; '<' not opening a tag stays text."""
    return t.normalize_text(t.decode_markup(F.regexp_replace(c, _TAG, "")))


def drop_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"<!--[\s\S]*?-->", "")


def drop_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?i)<(?:script\b[^>]*>[\s\S]*?</script|style\b[^>]*>[\s\S]*?</style)\s*>", "")


def _void_tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}[\s/]{_QUOTED}>"), F.lit(0))


@t.by_name
def _head_columns() -> dict:
    metas = F.transform(
        _void_tags(F.col("_live"), "meta"),
        lambda m: F.struct(
            attr(m, "name").alias("name"), attr(m, "property").alias("property"), attr(m, "content").alias("content")
        ),
    )
    canon = F.filter(_void_tags(F.col("_live"), "link"), lambda m: F.lower(attr(m, "rel")) == "canonical")
    images = F.transform(
        _void_tags(F.col("_live"), "img"),
        lambda m: F.struct(
            t.normalize_text(attr(m, "src")).alias("src"), t.normalize_text(attr(m, "alt")).alias("alt")
        ),
    )
    title = F.regexp_extract("_live", r"(?i)<title\b[^>]*>([\s\S]*?)</title", 1)
    href = attr(F.get(canon, F.lit(0)), "href")
    absolute = t.let(href, lambda h: F.when(h != "", u.link_href(h, F.col("url"))))
    return {
        "metas": metas,
        "title": t.normalize_text(t.decode_markup(title)),
        "canonical": absolute,
        "images": images,
    }


def with_head(pages: DataFrame) -> DataFrame:
    """Head and image facts: title, metas, canonical, images (arrays keep
    document order)."""
    live = pages.withColumn("_live", drop_scripts(drop_comments(F.col("html"))))
    return live.withColumns(_head_columns()).drop("_live")


@t.by_name
def meta_description(metas="metas") -> Column:
    hit = F.filter(metas, lambda m: m["name"] == "description")
    return F.get(hit, F.lit(0))["content"]


@t.by_name
def prefixed_tags(field: str, prefix: str, metas="metas") -> Column:
    """(name, content) of metas whose ``field`` starts with ``prefix``; a
    repeated name keeps its last content only."""
    tags = F.transform(
        F.filter(metas, lambda m: m[field].startswith(prefix)),
        lambda m: F.struct(
            t.normalize_text(m[field]).alias("name"), t.normalize_text(m["content"]).alias("content")
        ),
    )

    def last_wins(all_tags: Column) -> Column:
        later = lambda m, i: F.exists(
            F.slice(all_tags, i + 2, F.size(all_tags)), lambda n: n["name"] == m["name"]
        )
        return F.filter(all_tags, lambda m, i: ~later(m, i))

    return t.let(tags, last_wins)


def _piece_kind(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, r"^<(/?[a-zA-Z][a-zA-Z0-9]*)", 1))


@t.by_name
def _body_columns() -> list:
    """Steps of :func:`with_body`, each reading columns of the one before."""
    live = F.col("_live")
    winner = (
        F.when(live.rlike(r"(?i)<article[\s>]"), "article").when(live.rlike(r"(?i)<main[\s>]"), "main").otherwise("body")
    )
    cut_at = lambda name: F.split(F.regexp_replace(live, rf"(?i)(</?{name}(?:\s[^>]*)?>)", _CUT + "$1"), _CUT)
    parts = (
        F.when(F.col("_win") == "article", cut_at("article"))
        .when(F.col("_win") == "main", cut_at("main"))
        .otherwise(F.array(live))
    )
    inside = lambda s: (F.col("_win") == "body") | F.lower(s).startswith(F.concat(F.lit("<"), F.col("_win")))
    segments = F.transform(parts, lambda s: F.struct(inside(s).alias("in_scope"), s.alias("body")))
    pieces = F.flatten(
        F.transform(
            "_segs",
            lambda s: F.transform(
                F.split(F.regexp_replace(s["body"], _BLOCK, _CUT + "$1"), _CUT),
                lambda p: F.struct(_piece_kind(p).alias("kind"), p.alias("piece"), s["in_scope"].alias("in_scope")),
            ),
        )
    )

    def neighbours(a: Column, test) -> Column:
        return t.let(
            a,
            lambda v: F.exists(F.arrays_zip(v.alias("a"), F.slice(v, F.lit(2), F.size(v)).alias("b")), lambda z: test(z["a"], z["b"])),
        )

    kinds = F.filter(F.transform("_pieces", lambda p: p["kind"]), lambda k: k != "")
    holds_block = neighbours(
        kinds,
        lambda x, y: x.rlike("^(li|blockquote|figcaption|h[1-6])$")
        & ~y.startswith("/")
        & ~((x == "li") & (y == "li")),
    )
    nested = neighbours(
        F.filter(kinds, lambda k: F.regexp_replace(k, "^/", "") == F.col("_win")), lambda x, y: x == y
    )
    deep = (
        holds_block
        | ((F.col("_win") != "body") & nested)
        | ((F.col("_win") == "body") & live.rlike(_CLASS_SCOPES))
        | live.contains("aria-level")
    )
    blocks = F.transform(
        F.filter("_pieces", lambda p: p["kind"].rlike("^(h[1-6]|p|li|blockquote|figcaption)$")),
        lambda p: F.struct(p["kind"].alias("kind"), page_text(p["piece"]).alias("text"), p["in_scope"].alias("in_scope")),
    )
    links = F.flatten(
        F.transform(
            "_segs",
            lambda s: F.transform(
                F.regexp_extract_all(s["body"], F.lit(r"(?i)<a\s[^>]*>[\s\S]*?(?:</a\s*>|$)"), F.lit(0)),
                lambda m: F.struct(
                    page_text(m).alias("text"),
                    attr(F.regexp_extract(m, "^<[^>]*>", 0), "href").alias("href"),
                    s["in_scope"].alias("in_scope"),
                ),
            ),
        )
    )
    phrase = F.lit(r"(?i)<(?:strong|b)(?:\s[^>]*)?>([\s\S]*?)(?:</(?:strong|b)\s*>|$)")
    bolds = F.flatten(
        F.transform(
            "_pieces",
            lambda p: F.transform(
                F.regexp_extract_all(p["piece"], phrase, F.lit(1)),
                lambda b: F.struct(page_text(b).alias("text"), p["in_scope"].alias("in_scope")),
            ),
        )
    )
    full = lambda a: F.filter(a, lambda x: x["text"] != "")
    return [
        {"_live": drop_scripts(drop_comments(F.col("html")))},
        {"_win": winner},
        {"_segs": segments},
        {"_pieces": pieces},
        {"_deep": deep},
        {"_dom": _dom_parts(F.when(F.col("_deep"), F.col("html")))},
        {
            "scope": F.coalesce(F.col("_dom.scope"), F.col("_win")),
            "blocks": full(F.coalesce(F.col("_dom.blocks"), blocks)),
            "anchors": F.coalesce(F.col("_dom.anchors"), F.filter(links, lambda a: a["href"].isNotNull())),
            "bolds": full(F.coalesce(F.col("_dom.bolds"), bolds)),
        },
    ]


def with_body(pages: DataFrame) -> DataFrame:
    """Body facts: ``scope``, ``blocks`` (headings and paragraph units),
    ``anchors`` and ``bolds``, each in document order with ``in_scope``."""
    step = pages
    for columns in _body_columns():
        step = step.withColumns(columns)
    return step.drop("_live", "_win", "_segs", "_pieces", "_deep", "_dom")


@t.by_name
def heading_texts(level: int, scoped: bool = True, blocks="blocks") -> Column:
    hit = F.filter(blocks, lambda b: (b["kind"] == f"h{level}") & (b["in_scope"] | F.lit(not scoped)))
    return F.transform(hit, lambda b: b["text"])


@t.by_name
def joined_headings(level: int) -> Column:
    return F.array_join(heading_texts(level, scoped=False), " | ")


@t.by_name
def h1_count(html="html") -> Column:
    live = drop_scripts(drop_comments(F.col(html)))
    return F.size(F.regexp_extract_all(live, F.lit(r"(?i)<h1(?:[\s/][^>]*)?>"), F.lit(0)))


@t.by_name
def page_title_h1(blocks="blocks") -> Column:
    """First scoped h1, else the page's first; NULL when there is none."""
    return F.coalesce(
        F.get(heading_texts(1, True, blocks), F.lit(0)), F.get(heading_texts(1, False, blocks), F.lit(0))
    )


@t.by_name
def paragraph_units(blocks="blocks") -> Column:
    hit = F.filter(
        blocks,
        lambda b: b["kind"].isin("p", "blockquote", "figcaption") | ((b["kind"] == "li") & b["in_scope"]),
    )
    return F.transform(hit, lambda b: b["text"])


@t.by_name
def scoped_links(anchors="anchors", url="url") -> Column:
    kept = F.filter(
        anchors,
        lambda a: a["in_scope"] & (a["text"] != "") & (a["href"] != "")
        & ~F.trim(a["href"]).rlike("(?i)^(#|mailto:|tel:|javascript:)"),
    )
    return F.transform(
        kept, lambda a: F.struct(a["text"].alias("text"), u.normalize_url(a["href"], F.col(url)).alias("url"))
    )


@t.by_name
def scoped_bolds(bolds="bolds") -> Column:
    return F.transform(F.filter(bolds, lambda b: b["in_scope"]), lambda b: b["text"])


@t.by_name
def full_text(html="html") -> Column:
    """All text of the body, scripts' text included as the DOM has it."""
    body = F.regexp_extract(drop_comments(F.col(html)), r"(?i)<body\b[^>]*>([\s\S]*)$", 1)
    body = F.when(body == "", drop_comments(F.col(html))).otherwise(body)
    return page_text(body)


def element_rows(pages: DataFrame) -> DataFrame:
    """Long form: one row per element, position counted per page and family."""
    body = with_body(with_head(pages))
    as_el = lambda kind, text, href, scope: F.struct(
        kind.alias("kind"), text.alias("text"), href.alias("href"), scope.alias("in_scope")
    )
    none = F.lit(None).cast("string")
    families = [
        F.array(as_el(F.lit("title"), F.col("title"), none, F.lit(False))),
        F.transform("blocks", lambda b: as_el(b["kind"], b["text"], none, b["in_scope"])),
        F.transform("anchors", lambda a: as_el(F.lit("a"), a["text"], a["href"], a["in_scope"])),
        F.transform("bolds", lambda b: as_el(F.lit("b"), b["text"], none, b["in_scope"])),
        F.transform("images", lambda i: as_el(F.lit("img"), i["alt"], i["src"], F.lit(False))),
    ]
    numbered = [F.transform(f, lambda e, i: F.struct(i.cast("int").alias("pos"), e.alias("e"))) for f in families]
    return body.select("page_id", "url", F.explode(F.concat(*numbered)).alias("x")).select(
        "page_id", "url", "x.pos", "x.e.kind", "x.e.text", "x.e.href", "x.e.in_scope"
    )


@t.by_name
def jsonld_faqs(html="html") -> Column:
    """FAQ pairs from ld+json blocks; unreadable blocks are skipped."""
    blocks = F.regexp_extract_all(
        drop_comments(F.col(html)),
        F.lit(r"""(?i)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>([\s\S]*?)</script"""),
        F.lit(1),
    )
    empty = F.array().cast("array<variant>")
    arr = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    is_list = lambda v: F.schema_of_variant(v).startswith("ARRAY")
    docs = F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    nodes = F.flatten(F.transform(docs, lambda v: F.when(is_list(v), arr(v, "$")).otherwise(F.array(v))))
    graph = lambda v: F.try_variant_get(v, "$['@graph']", "variant")
    entries = F.flatten(
        F.transform(
            nodes,
            lambda v: F.when(graph(v).isNotNull() & is_list(graph(v)), arr(v, "$['@graph']")).otherwise(F.array(v)),
        )
    )
    kind = lambda v: F.try_variant_get(v, "$['@type']", "variant")
    is_faq = lambda v: F.when(
        is_list(kind(v)), F.array_contains(F.try_variant_get(v, "$['@type']", "array<string>"), "FAQPage")
    ).otherwise(F.try_variant_get(v, "$['@type']", "string") == "FAQPage")
    entity = lambda v: F.try_variant_get(v, "$.mainEntity", "variant")
    questions = F.flatten(
        F.transform(
            F.filter(entries, lambda v: F.coalesce(is_faq(v), F.lit(False))),
            lambda v: F.when(entity(v).isNotNull() & is_list(entity(v)), arr(v, "$.mainEntity")).otherwise(empty),
        )
    )
    is_text = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    text = lambda v, path: F.when(is_text(v, path), F.trim(F.try_variant_get(v, path, "string"))).otherwise("")
    pairs = F.transform(
        questions,
        lambda v: F.struct(
            F.lit(1).alias("strategy"),
            text(v, "$.name").alias("question"),
            text(v, "$.acceptedAnswer.text").alias("answer"),
        ),
    )
    return F.filter(pairs, lambda p: (p["question"] != "") & (p["answer"] != ""))


def with_faqs(pages: DataFrame) -> DataFrame:
    """``faqs``: pairs of the first strategy that yields any. Structured data
    short-cuts the rest, pages whose tags nest are read on the JVM, and only
    others that hold a marker reach Python."""
    step = pages.withColumn("_ld", F.when(F.col("html").contains("ld+json"), jsonld_faqs()))
    solved = F.coalesce(F.size("_ld") > 0, F.lit(False))
    marked = F.when(~solved & F.col("html").rlike(_FAQ_MARKERS), F.col("html"))
    step = step.withColumn("_marked", marked).withColumn("_flat", nested_faqs("_marked"))
    step = step.withColumn("_dom", _dom_faqs(F.when(F.col("_flat").isNull(), F.col("_marked"))))
    first = lambda pairs: F.filter(pairs, lambda p: p["strategy"] == F.array_min(F.transform(pairs, lambda x: x["strategy"])))
    chosen = t.let(F.coalesce("_flat", "_dom"), first)
    empty = F.array().cast(FAQ_TYPE)
    faqs = F.when(solved, F.col("_ld")).otherwise(F.coalesce(chosen, empty))
    return step.withColumn("faqs", faqs).drop("_ld", "_marked", "_flat", "_dom")
