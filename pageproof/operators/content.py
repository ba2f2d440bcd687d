"""Approved content against published content, page by page.

Both sides are one row per page with arrays; they meet in one equi-join.
Alignment, exact position and containment are settled inside the row. Only
items no exact rule explains go on to the similarity join, and only pairs
reported as changed reach the word diff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageproof.functions import text as t
from pageproof.functions import urls as u
from pageproof.functions.align import diff_summary, diff_words, lcs_align
from pageproof.operators import html as H
from pageproof.operators.ordered import sequence_number
from pageproof.operators.similar import best_similar
from pageproof.session import materialized

RESULT = ["pair_id", "url", "family", "seq", "check_type", "status", "expected", "actual", "message", "diff"]
DIFF = "array<struct<type:string,expected:string,actual:string>>"


def published_content(pages: DataFrame) -> DataFrame:
    """Actual side, one row per page."""
    body = H.with_body(H.with_head(pages))
    return body.select(
        "url",
        H.page_title_h1().alias("title"),
        F.nullif("title", F.lit("")).alias("meta_title"),
        F.nullif(t.normalize_text(H.meta_description()), F.lit("")).alias("meta_description"),
        "canonical",
        H.h1_count().alias("h1_count"),
        *[H.heading_texts(n).alias(f"h{n}") for n in (2, 3, 4)],
        H.paragraph_units().alias("paragraphs"),
        H.scoped_links().alias("links"),
        H.scoped_bolds().alias("bolds"),
    )


def pair_content(expected: DataFrame, actual: DataFrame, on: str = "url") -> DataFrame:
    """One row per page with e_* and a_* columns. ``expected`` carries doc_id."""
    left = expected.select(
        on,
        F.col("doc_id").alias("pair_id"),
        *[F.col(c).alias(f"e_{c}") for c in expected.columns if c not in (on, "doc_id", "url")],
    )
    right = actual.select(
        on, *(["url"] if on != "url" else []), *[F.col(c).alias(f"a_{c}") for c in actual.columns if c not in (on, "url")]
    )
    return left.join(right, on)


def _row(df: DataFrame, family, seq, check_type, status, expected, actual, message, diff=None) -> DataFrame:
    as_col = lambda c: c if isinstance(c, Column) else F.lit(c)
    return df.select(
        "pair_id",
        "url",
        as_col(family).alias("family"),
        as_col(seq).cast("int").alias("seq"),
        as_col(check_type).alias("check_type"),
        as_col(status).alias("status"),
        as_col(expected).cast("string").alias("expected"),
        as_col(actual).cast("string").alias("actual"),
        as_col(message).alias("message"),
        (F.lit(None).cast(DIFF) if diff is None else diff).alias("diff"),
    )


def _value(name: str, seq: int, status, expected, actual, message, diff_e=None, diff_a=None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(
        F.lit(seq).alias("seq"),
        F.lit(name).alias("check_type"),
        status.alias("status"),
        text(expected).alias("expected"),
        text(actual).alias("actual"),
        message.alias("message"),
        text(diff_e).alias("diff_e"),
        text(diff_a).alias("diff_a"),
    )


def value_rows(pairs: DataFrame, values: list[Column]) -> DataFrame:
    """Results of single-value checks: all are columns of one pass over the
    pairs, unfolded afterwards; only changed values carry texts to diff."""
    rows = pairs.select("pair_id", "url", F.explode(F.array(*values)).alias("v")).select("pair_id", "url", "v.*")
    return _row(
        rows, "value", F.col("seq"), F.col("check_type"), F.col("status"), F.col("expected"), F.col("actual"),
        F.col("message"), diff_words("diff_e", "diff_a"),
    )


def single_value(name: str, column: str, missing: str, site_suffix: bool = False, seq: int = 0) -> Column:
    """Missing, equal, equal but for a site-name suffix, or changed."""
    e, a = F.col(f"e_{column}"), F.col(f"a_{column}")
    keys = F.struct(
        t.normalize_text(e).alias("e"), t.normalize_text(a).alias("a"),
        t.content_key(e).alias("ek"), t.content_key(a).alias("ak"),
    )

    def judge(k: Column) -> Column:
        none, gone, same = k["e"] == "", k["a"] == "", k["ek"] == k["ak"]
        suffix = t.has_site_suffix(k["ek"], k["ak"]) & F.lit(site_suffix)
        changed = ~none & ~gone & ~same & ~suffix
        message = (
            F.when(none, "No expected value provided in the document.")
            .when(gone, missing)
            .when(same, f"{name} matches the approved document.")
            .when(suffix, f"{name} matches the approved document (a trailing site-name suffix was ignored).")
            .otherwise(
                F.concat(F.lit(f'{name} has changed. Expected "'), k["e"], F.lit('" but found "'), k["a"], F.lit('".'))
            )
        )
        status = F.when(none, "skipped").when(gone | changed, "failed").otherwise("passed")
        texts = [F.when(changed, t.content_display(c)) for c in (e, a)]
        return _value(name, seq, status, e, a, message, *texts)

    return t.let(keys, judge)


def h1_count_check() -> Column:
    n = F.col("a_h1_count")
    none = n.isNull() | (n == 0)
    message = (
        F.when(none, 'No H1 tag was found on the live page; see "Blog Title (H1)".')
        .when(n == 1, "Exactly one H1 tag is present on the live page.")
        .otherwise(
            F.concat(
                F.lit("Found "),
                n.cast("string"),
                F.lit(
                    " <h1> tags on the live page, but a page should have exactly one. "
                    'Multiple H1 tags dilute the semantic "primary heading" signal search engines use and often '
                    "indicate the CMS is re-rendering the blog title as a second literal heading inside the body content."
                ),
            )
        )
    )
    status = F.when(none, "skipped").when(n == 1, "passed").otherwise("failed")
    return _value("H1 Tag Count", 3, status, F.lit("1"), n, message)


def canonical_check() -> Column:
    """The page's canonical must be the brief's override, else the page."""
    have = F.nullif("a_canonical", F.lit(""))
    shown = F.coalesce("e_canonical", "url")

    def judge(k: Column) -> Column:
        differs = have.isNotNull() & (k["want"] != k["have"])
        message = (
            F.when(have.isNull(), "Canonical URL is missing from the live page.")
            .when(
                differs,
                F.concat(
                    F.lit('Canonical URL does not match. Expected it to point to "'), shown,
                    F.lit('" but found "'), have, F.lit('".'),
                ),
            )
            .otherwise("Canonical URL matches the expected target.")
        )
        status = F.when(have.isNull() | differs, "failed").otherwise("passed")
        return _value("Canonical URL", 4, status, shown, have, message, F.when(differs, shown), F.when(differs, have))

    targets = F.struct(u.normalize_url(shown, F.col("url")).alias("want"), u.normalize_url(have, F.col("url")).alias("have"))
    return t.let(targets, judge)


def slug_check() -> Column:
    e = F.col("e_slug")

    def judge(k: Column) -> Column:
        none, hit = k["want"] == "", k["path"].endswith(k["want"])
        bad = ~none & ~hit
        message = (
            F.when(none, "No expected URL/slug was specified in the approved document.")
            .when(hit, "Live URL matches the expected slug/structure.")
            .otherwise(
                F.concat(
                    F.lit('The live URL does not match the expected slug. Expected "'), e,
                    F.lit('" but the live URL path is "'), k["path"], F.lit('".'),
                )
            )
        )
        status = F.when(none, "skipped").when(hit, "passed").otherwise("failed")
        shown = F.when(~none, k["path"])
        return _value("Blog URL / Slug", 5, status, e, shown, message, F.when(bad, e), F.when(bad, k["path"]))

    parts = F.struct(t.slug_segment(F.coalesce(e, F.lit(""))).alias("want"), t.slug_segment(u.url_path("url")).alias("path"))
    return t.let(parts, judge)


@t.by_name
def standard_values() -> list[Column]:
    """The six single-value checks of a content comparison."""
    return [
        single_value("Meta Title", "meta_title", "Meta title is missing from the live page.", True, 0),
        single_value("Meta Description", "meta_description", "Meta description is missing from the live page.", seq=1),
        single_value("Blog Title (H1)", "title", "H1 is missing from the live page.", seq=2),
        h1_count_check(),
        canonical_check(),
        slug_check(),
    ]


HEADINGS = ("h2", "h3", "h4")
PARAGRAPHS = "paragraphs"


@t.by_name
def _keys(column: str) -> Column:
    return F.transform(column, lambda x: t.content_key(x))


@t.by_name
def _item_columns(kind: str) -> list:
    """In-row answers for one list: ``lcs`` (partner in order), ``exact``
    (first equal) and, for headings, ``inside`` (first that contains or is
    contained), ``elsewhere`` (any level) and ``as_bold``; each is only looked
    for where the one before failed."""
    ek, ak = F.col(f"_ek_{kind}"), F.col(f"_ak_{kind}")
    lcs, place = F.col(f"_lcs_{kind}"), f"_at_{kind}"
    spot = F.transform(
        ek,
        lambda k, i: F.struct(
            F.get(lcs, i).alias("lcs"),
            F.when(F.get(lcs, i).isNull(), F.nullif(F.array_position(ak, k).cast("int"), F.lit(0)) - 1).alias("exact"),
        ),
    )
    none, no = F.lit(None).cast("int"), F.lit(None).cast("boolean")

    def wrapped(k: Column) -> Column:
        fits = lambda x: lambda c, j: F.when((F.length(c) >= 4) & (c.contains(x) | x.contains(c)), j)
        hits = lambda x: F.array_min(F.filter(F.transform(f"_bare_{kind}", fits(x)), lambda j: j.isNotNull()))
        return t.let(t.strip_decoration(k), lambda x: F.when(F.length(x) >= 4, hits(x)))

    def item(k: Column, i: Column) -> Column:
        at = F.get(place, i)
        unplaced = at["lcs"].isNull() & at["exact"].isNull()
        heading = kind in HEADINGS
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("idx"),
            k.alias("key"),
            F.get(f"e_{kind}", i).alias("text"),
            at["lcs"].alias("lcs"),
            at["exact"].alias("exact"),
            (F.when(unplaced, wrapped(k)) if heading else none).alias("inside"),
            (F.when(unplaced, F.array_contains("_all", k)) if heading else no).alias("elsewhere"),
            (F.when(unplaced, F.array_contains("_bold", k)) if heading else no).alias("as_bold"),
        )

    return [{place: spot}, {f"_items_{kind}": F.transform(ek, item)}]


def aligned_items(pairs: DataFrame, kinds=(*HEADINGS, PARAGRAPHS)) -> DataFrame:
    """One row per expected item of the given lists, see ``_item_columns``.
    All lists of a page are aligned in one Arrow call per batch."""
    step = pairs.withColumns({f"_{s}k_{k}": _keys(f"{s}_{k}") for k in kinds for s in ("e", "a")})
    if any(k in HEADINGS for k in kinds):
        every = F.concat(F.filter(F.array("a_title"), lambda x: x.isNotNull()), "a_h2", "a_h3", "a_h4")
        bare = {f"_bare_{k}": F.transform(f"_ak_{k}", t.strip_decoration) for k in kinds if k in HEADINGS}
        step = step.withColumns({"_all": F.transform(every, lambda x: t.content_key(x)), "_bold": _keys("a_bolds"), **bare})
    step = step.withColumns({f"_lcs_{k}": lcs_align(f"_ek_{k}", f"_ak_{k}") for k in kinds})
    for k in kinds:
        for columns in _item_columns(k):
            step = step.withColumns(columns)
    found = lambda k: F.transform(
        f"_items_{k}", lambda x: F.struct(x.alias("it"), F.get(f"a_{k}", F.coalesce(x["lcs"], x["exact"], x["inside"])).alias("found"))
    )
    rows = step.select("pair_id", "url", F.explode(F.concat(*[found(k) for k in kinds])).alias("r"))
    return rows.select("pair_id", "url", "r.it.*", "r.found")


def open_items() -> Column:
    """No exact rule explains the item."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return (
        F.col("lcs").isNull() & F.col("exact").isNull() & F.col("inside").isNull() & no("elsewhere") & no("as_bold")
    )


def similar_items(pairs: DataFrame, items: DataFrame, kinds=(*HEADINGS, PARAGRAPHS)) -> DataFrame:
    """Best similar published item for the items still open."""
    e = items.where(open_items()).select("pair_id", "kind", F.col("idx").alias("e_id"), F.col("key").alias("e_key"))
    tagged = [F.transform(f"a_{k}", _tag(k)) for k in kinds]
    a = pairs.select("pair_id", F.explode(F.concat(*tagged)).alias("r")).select("pair_id", "r.*")
    a = a.withColumn("a_key", t.content_key("a_text"))
    best = best_similar(e, a.select("pair_id", "kind", "a_id", "a_key"), ["pair_id", "kind"])
    texts = a.select("pair_id", "kind", "a_id", "a_text")
    return best.join(texts, ["pair_id", "kind", "a_id"]).select(
        "pair_id", "kind", F.col("e_id").alias("idx"), F.col("a_id").alias("sim"), F.col("a_text").alias("sim_text")
    )


def _tag(kind: str):
    return lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("a_id"), x.alias("a_text"))


def _n(c) -> Column:
    return (F.col(c) + 1).cast("string")


def item_results(pairs: DataFrame, kinds=(*HEADINGS, PARAGRAPHS)) -> DataFrame:
    """Headings and paragraphs by tier: aligned, elsewhere in the list,
    (headings) wrapped, at another level, as bold text, then changed with a
    word diff, or missing."""
    # Stored: alignment is the costly part, and items are read twice.
    items = materialized(aligned_items(pairs, kinds))
    step = items.join(similar_items(pairs, items, kinds), ["pair_id", "kind", "idx"], "left")
    changed = open_items() & F.col("sim").isNotNull()
    step = step.withColumn(
        "diff", diff_words(F.when(changed, t.content_display("text")), F.when(changed, t.content_display("sim_text")))
    )
    para = F.col("kind") == PARAGRAPHS
    label = F.upper("kind")
    named = F.concat(label, F.lit(' heading "'), "text", F.lit('"'))
    at = F.concat(F.lit(" (expected around position "), _n("idx"), F.lit(", found at position "), _n("exact"), F.lit(")."))
    aligned, exact, inside = (F.col(c).isNotNull() for c in ("lcs", "exact", "inside"))
    elsewhere, bold = F.coalesce("elsewhere", F.lit(False)), F.coalesce("as_bold", F.lit(False))
    subject = F.when(para, "Paragraph text").otherwise(F.concat(label, F.lit(" heading")))
    message = (
        F.when(
            aligned,
            F.when(para, "Paragraph matches the approved document.").otherwise(
                F.concat(label, F.lit(" heading matches the approved document."))
            ),
        )
        .when(
            exact,
            F.concat(
                F.when(para, "Paragraph is unchanged but has moved").otherwise(
                    F.concat(named, F.lit(" is present but out of order"))
                ),
                at,
            ),
        )
        .when(
            inside,
            F.concat(
                named,
                F.lit(
                    " was found on the live page wrapped in additional markup (e.g. an accordion/FAQ widget)"
                    ' — found "'
                ),
                "found",
                F.lit('".'),
            ),
        )
        .when(
            elsewhere,
            F.concat(
                named, F.lit(" was not found as an "), label,
                F.lit(" tag specifically, but is present as a heading at a different level on the live page."),
            ),
        )
        .when(
            bold,
            F.concat(
                named,
                F.lit(" was not found as a heading tag on the live page, but is present as bold-styled text."),
            ),
        )
        .when(F.col("sim").isNotNull(), diff_summary("diff", subject))
        .when(para, "Paragraph is missing from the live page.")
        .otherwise(F.concat(named, F.lit(" is missing from the live page.")))
    )
    status = F.when(aligned, "passed").when(exact | inside | elsewhere | bold, "warning").otherwise("failed")
    check = F.when(para, F.concat(F.lit('"'), t.preview10("text"), F.lit('"'))).otherwise(
        F.concat(label, F.lit(" #"), _n("idx"))
    )
    actual = F.coalesce(F.col("found"), F.when(elsewhere | bold, F.col("text")), F.col("sim_text"))
    family = F.when(para, "paragraph").otherwise(F.col("kind"))
    return _row(step, family, F.col("idx"), check, status, F.col("text"), actual, message, F.col("diff"))


def paragraph_results(pairs: DataFrame) -> DataFrame:
    return item_results(pairs, (PARAGRAPHS,))


def heading_results(pairs: DataFrame, level: int) -> DataFrame:
    return item_results(pairs, (f"h{level}",))


def link_items(pairs: DataFrame, side: str) -> DataFrame:
    """Long form (pair_id, url, idx, text, link) of one side's links."""
    return pairs.select("pair_id", "url", F.posexplode(f"{side}_links").alias("idx", "x")).select(
        "pair_id", "url", "idx", "x.text", F.col("x.url").alias("link")
    )


def match_links(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Occurrence-counted (text, URL) matches, the two fallbacks, and one
    warning per extra pair, from long form. The k-th expected occurrence passes
    when the page has k of them, so the published side is only counted."""
    prepared = lambda df: df.withColumns(
        {
            "tkey": t.normalize_cmp("text"),
            "key": F.concat(t.normalize_cmp("text"), F.lit("||"), "link"),
            "shown": F.concat("text", F.lit(" → "), "link"),
        }
    )
    e = sequence_number(prepared(expected), ["pair_id", "key"], "idx", "occ")
    a = prepared(actual)
    first = F.min_by(F.struct("text", "link", "shown"), "idx")
    have = a.groupBy("pair_id", "url", "key").agg(F.count("*").alias("n"), first.alias("f"), F.min("idx").alias("idx"))
    by_url = a.groupBy("pair_id", "link").agg(first.alias("fu"))
    by_text = a.groupBy("pair_id", "tkey").agg(first.alias("ft"))
    step = (
        e.join(have.select("pair_id", "key", "n"), ["pair_id", "key"], "left")
        .join(by_url, ["pair_id", "link"], "left")
        .join(by_text, ["pair_id", "tkey"], "left")
    )
    ok = F.coalesce(F.col("occ") <= F.col("n"), F.lit(False))
    same_url, same_text = ~ok & F.col("fu").isNotNull(), ~ok & F.col("fu").isNull() & F.col("ft").isNotNull()
    found = F.when(same_url, F.col("fu.shown")).when(same_text, F.col("ft.shown"))
    step = step.withColumn("_found", found)
    quote = lambda before, want, mid, got: F.concat(F.lit(before), want, F.lit(mid), got, F.lit('".'))
    message = (
        F.when(ok, "Hyperlink matches the approved document.")
        .when(
            same_url,
            quote(
                'Hyperlink destination matches but anchor text differs. Expected "',
                F.col("text"),
                '" but found "',
                F.col("fu.text"),
            ),
        )
        .when(
            same_text,
            quote(
                'Hyperlink text matches but destination URL differs. Expected "',
                F.col("link"),
                '" but found "',
                F.col("ft.link"),
            ),
        )
        .otherwise(
            F.concat(F.lit('Hyperlink "'), "text", F.lit('" ('), "link", F.lit(") is missing from the live page."))
        )
    )
    wrong = F.col("_found").isNotNull()
    diff = diff_words(F.when(wrong, F.col("shown")), F.when(wrong, F.col("_found")))
    named = lambda kind, text: F.concat(F.lit(f'{kind}: "'), t.preview10(text), F.lit('"'))
    checked = _row(
        step, "link", F.col("idx"), named("Hyperlink", F.col("text")), F.when(ok, "passed").otherwise("failed"),
        F.col("shown"), F.when(ok, F.col("shown")).otherwise(F.col("_found")), message, diff,
    )
    wanted = e.groupBy("pair_id", "key").agg(F.count("*").alias("m"))
    extra = have.join(wanted, ["pair_id", "key"], "left").where(F.col("n") > F.coalesce("m", F.lit(0)))
    extras = _row(
        extra, "link_extra", F.col("idx"), named("Hyperlink (extra)", F.col("f.text")), "warning", F.lit(None),
        F.col("f.shown"),
        F.concat(
            F.lit('Hyperlink "'), F.col("f.text"), F.lit('" ('), F.col("f.link"),
            F.lit(") is present on the live page but not in the approved document."),
        ),
    )
    return checked.unionByName(extras)


def link_results(pairs: DataFrame) -> DataFrame:
    return match_links(link_items(pairs, "e"), link_items(pairs, "a"))


def bold_items(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long forms: expected (pair_id, url, idx, text, head, link) with flags
    for "is a heading" and "is an expected link's text", and published."""
    headings = F.concat(F.filter(F.array("a_title"), lambda x: x.isNotNull()), "a_h2", "a_h3", "a_h4")
    step = pairs.withColumns(
        {
            "_heads": F.transform(headings, lambda x: t.normalize_cmp(x)),
            "_texts": F.transform("e_links", lambda x: t.normalize_cmp(x["text"])),
        }
    )
    flagged = F.transform(
        "e_bolds",
        lambda b: F.struct(
            b.alias("text"),
            F.array_contains("_heads", t.normalize_cmp(b)).alias("head"),
            F.array_contains("_texts", t.normalize_cmp(b)).alias("link"),
        ),
    )
    e = step.select("pair_id", "url", F.posexplode(flagged).alias("idx", "x")).select(
        "pair_id", "url", "idx", "x.text", "x.head", "x.link"
    )
    return e, pairs.select("pair_id", "url", F.posexplode("a_bolds").alias("idx", "text"))


def match_bolds(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Occurrence-counted phrases; headings count as bold, link texts need not
    be; one warning per extra phrase."""
    e = sequence_number(expected.withColumn("key", t.normalize_cmp("text")), ["pair_id", "key"], "idx", "occ")
    a = actual.withColumn("key", t.normalize_cmp("text"))
    have = a.groupBy("pair_id", "url", "key").agg(F.count("*").alias("n"), F.min_by("text", "idx").alias("text"), F.min("idx").alias("idx"))
    j = e.join(have.select("pair_id", "key", "n"), ["pair_id", "key"], "left")
    ok = F.coalesce(F.col("occ") <= F.col("n"), F.lit(False))
    text, head, link = F.col("text"), F.col("head"), F.col("link")
    message = (
        F.when(ok, "Bold phrase matches the approved document.")
        .when(
            head,
            "Bold phrase matches a heading on the live page (rendered bold via heading styling, not a literal bold tag).",
        )
        .when(link, "Bold phrase is also a hyperlink anchor text; hyperlinks are not required to also render bold.")
        .otherwise(F.concat(F.lit('Bold phrase "'), text, F.lit('" is missing from the live page.')))
    )
    status = F.when(ok | head, "passed").when(link, "skipped").otherwise("failed")
    named = lambda kind, c: F.concat(F.lit(f'{kind}: "'), t.preview10(c), F.lit('"'))
    checked = _row(j, "bold", F.col("idx"), named("Bold", text), status, text, F.when(ok | head, text), message)
    wanted = e.groupBy("pair_id", "key").agg(F.count("*").alias("m"))
    extra = have.join(wanted, ["pair_id", "key"], "left").where(F.col("n") > F.coalesce("m", F.lit(0)))
    extras = _row(
        extra, "bold_extra", F.col("idx"), named("Bold (extra)", F.col("text")), "warning", F.lit(None), F.col("text"),
        F.concat(
            F.lit('Bold phrase "'), "text", F.lit('" is present on the live page but not in the approved document.')
        ),
    )
    return checked.unionByName(extras)


def bold_results(pairs: DataFrame) -> DataFrame:
    return match_bolds(*bold_items(pairs))


def not_loaded(brief_table: DataFrame) -> DataFrame:
    """One row of status ``error`` for each brief (doc_id, url) without a page."""
    rows = brief_table.select(F.col("doc_id").alias("pair_id"), "url")
    return _row(rows, "load", 0, "Page", "error", None, None, "no snapshot of this page")


def compare_content(pairs: DataFrame) -> DataFrame:
    """All content checks of every pair, in one result table. The pairs are
    read once per group of checks; callers materialise them first."""
    return (
        value_rows(pairs, standard_values())
        .unionByName(item_results(pairs))
        .unionByName(link_results(pairs))
        .unionByName(bold_results(pairs))
    )
