"""FAQ sheets to expected pairs, and expected against published pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageproof.functions import text as t
from pageproof.functions.align import diff_words
from pageproof.operators.html import full_text, with_faqs
from pageproof.operators.ordered import SEGMENT_ROWS, latest_row, ordered_scan, sequence_number
from pageproof.operators.sheet_rules import HEADER_ROWS

# ---- fixed values -----------------------------------------------------------
ROLES = {"url": ["url"], "question": ["faqs", "faq", "question", "questions"], "answer": ["answer", "answers"]}
MISSING_ACTUAL = "Missing — add this FAQ (question + answer) to the live page."
MISSING_MESSAGE = "This FAQ question was not found on the live page."
DIFFERS_MESSAGE = "The live answer does not match the expected answer."
EXTRA_EXPECTED = (
    "Not in the approved FAQ sheet — remove this from the live page, or add it to the sheet if it should stay."
)
EXTRA_MESSAGE = "This FAQ appears on the live page but is not listed in the FAQ sheet."
TEXT_ACTUAL = (
    "Question is present, but this answer text is missing or different — update the live answer to match Expected."
)
TEXT_MESSAGE = "The FAQ question is present, but its expected answer text could not be found on the live page."
LOAD_CHECK = "FAQ (page load failed)"
LOAD_EXPECTED = "This page's FAQs — not a live-site bug, nothing to fix on the page itself."
LOAD_AGAIN = " Re-run the audit to test this page's FAQs."
# -----------------------------------------------------------------------------
NO_SNAPSHOT = "no snapshot of this page."
#: Questions that are looked up in one copy of a page's text.
QUESTIONS_A_BLOCK = 500


def faq_headers(cells: DataFrame) -> DataFrame:
    """First of a sheet's first ten rows that names all three columns."""
    value = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    role = F
    for name, labels in ROLES.items():
        role = role.when(value.isin(*labels), F.lit(name))
    top = cells.where(F.col("row_no") <= HEADER_ROWS).withColumn("role", role).where("role is not null")
    col = lambda r: F.min(F.when(F.col("role") == r, F.col("col_no"))).alias(f"{r}_col")
    full = top.groupBy("sheet_id", "row_no").agg(*[col(r) for r in ROLES]).dropna()
    return full.groupBy("sheet_id").agg(F.min_by(F.struct("row_no", *[f"{r}_col" for r in ROLES]), "row_no").alias("h")).select(
        "sheet_id", F.col("h.row_no").alias("header_row_no"), *[f"h.{r}_col" for r in ROLES]
    )


def faq_rows(cells: DataFrame, segment_rows: int = SEGMENT_ROWS, headers: DataFrame | None = None) -> DataFrame:
    """faq_rows(sheet_id, row_no, url_text, hyperlink, question, answer) below
    the header, blank rows included: they separate blocks. Row numbers must be
    the sheet's own (1-based). Headers are copied to each segment they serve,
    so one huge sheet does not make one huge join key. ``headers``: those of
    :func:`faq_headers`, where they are stored already."""
    headers = faq_headers(cells) if headers is None else headers
    rows = (
        cells.groupBy("sheet_id", "row_no")
        .agg(
            F.collect_list(
                F.struct(
                    F.col("col_no").alias("col"),
                    F.trim(F.coalesce("value", F.lit(""))).alias("v"),
                    F.col("hyperlink").alias("h"),
                )
            ).alias("cells")
        )
        .withColumn("_seg", F.floor(F.col("row_no") / segment_rows).cast("bigint"))
    )
    served = rows.select("sheet_id", "_seg").distinct().join(headers, "sheet_id")
    cell = lambda role: F.get(F.filter("cells", lambda c: c["col"] == F.col(f"{role}_col")), F.lit(0))
    text = lambda role: F.coalesce(cell(role)["v"], F.lit(""))
    return (
        rows.join(served, ["sheet_id", "_seg"])
        .where("row_no > header_row_no")
        .select(
            "sheet_id",
            "row_no",
            text("url").alias("url_text"),
            F.nullif(cell("url")["h"], F.lit("")).alias("hyperlink"),
            text("question").alias("question"),
            text("answer").alias("answer"),
        )
    )


def faq_runs(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Attach each row to its identity run.

    Blank rows end a block. A labelled row opens a run when its identity (link,
    else label) differs from the label before it in the block; other rows join
    the run above them, or, at the top of a block, the first run below. Adds
    block_id, run_row, label, url; rows of blocks without any label drop out.
    """
    blank = (F.col("url_text") == "") & (F.col("question") == "") & (F.col("answer") == "")
    identity = F.coalesce("hyperlink", F.concat(F.lit("label:"), t.normalize_label("url_text")))
    mark = F.struct(F.col("row_no").alias("row"), identity.alias("key"))
    step = ordered_scan(
        rows,
        ["sheet_id"],
        "row_no",
        sums={"block_id": blank.cast("bigint")},
        last={"_gap_above": F.when(blank, F.col("row_no"))},
        prev={"_label_above": F.when(F.col("url_text") != "", mark)},
        next={"_gap_below": F.when(blank, F.col("row_no"))},
        segment_rows=segment_rows,
    ).where(~blank)
    same_block = F.coalesce(F.col("_label_above.row") > F.coalesce("_gap_above", F.lit(-1)), F.lit(False))
    opens = (F.col("url_text") != "") & ~(same_block & (F.col("_label_above.key") == identity))
    opener = F.struct(F.col("row_no").alias("row"), F.col("url_text").alias("label"), F.col("hyperlink").alias("url"))
    step = ordered_scan(
        step,
        ["sheet_id"],
        "row_no",
        last={"_open_above": F.when(opens, opener)},
        next={"_open_below": F.when(opens, opener)},
        segment_rows=segment_rows,
    )
    above = F.when(F.col("_open_above.row") > F.coalesce("_gap_above", F.lit(-1)), F.col("_open_above"))
    below = F.when(
        F.col("_gap_below").isNull() | (F.col("_open_below.row") < F.col("_gap_below")), F.col("_open_below")
    )
    return (
        step.withColumn("_run", F.coalesce(above, below))
        .where("_run is not null")
        .select(
            *rows.columns,
            "block_id",
            F.col("_run.row").alias("run_row"),
            F.col("_run.label").alias("label"),
            F.col("_run.url").alias("url"),
        )
    )


def complete_pairs(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("question") != "") & (F.col("answer") != ""))


def expected_faqs(runs: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Resolved pairs, runs of one URL merged in row order under the first
    run's label."""
    pairs = complete_pairs(runs).where("url is not null")
    labels = pairs.groupBy("sheet_id", "url").agg(F.min_by("label", "run_row").alias("label"))
    numbered = sequence_number(pairs.drop("label"), ["sheet_id", "url"], "row_no", "pos", segment_rows)
    return numbered.join(labels, ["sheet_id", "url"]).select(
        "sheet_id",
        "url",
        "label",
        F.col("pos").cast("int").alias("pos"),
        "question",
        "answer",
        F.col("row_no").cast("int").alias("source_row_number"),
    )


def unresolved_faqs(runs: DataFrame) -> DataFrame:
    return (
        complete_pairs(runs)
        .where("url is null")
        .groupBy("sheet_id", F.col("run_row").cast("int").alias("source_row_number"), "label")
        .agg(F.count("*").alias("faq_count"))
        .select("sheet_id", "label", "source_row_number", "faq_count")
    )


def unresolved_results(unresolved: DataFrame) -> DataFrame:
    """Warning results for runs that name no page."""
    return unresolved.select(*unresolved_columns())


def unresolved_columns() -> list[Column]:
    n = F.concat(
        F.col("faq_count").cast("string"), F.when(F.col("faq_count") == 1, F.lit(" FAQ")).otherwise(F.lit(" FAQs"))
    )
    return [
        F.col("label").alias("url"),
        F.lit("FAQ (skipped)").alias("check_type"),
        F.lit("warning").alias("status"),
        F.concat(
            n, F.lit(' for page "'), "label", F.lit('" — not a live-site bug, nothing to fix on the page itself.')
        ).alias("expected"),
        F.concat(
            F.lit('Untested — no hyperlink/URL found in the sheet for page label "'),
            "label",
            F.lit('" (row '),
            F.col("source_row_number").cast("string"),
            F.lit("). Add a real link in the sheet and re-run to test this page's FAQs."),
        ).alias("actual"),
        F.concat(n, F.lit(" could not be tested.")).alias("message"),
    ]


def _named(kind: str, question) -> Column:
    return F.concat(F.lit(f'{kind}: "'), t.question_preview(question), F.lit('"'))


def published_faqs(pages: DataFrame) -> DataFrame:
    """Long form of the pairs found on pages: (url, pos, question, answer)."""
    return with_faqs(pages).select("url", F.posexplode("faqs").alias("pos", "f")).select(
        "url", "pos", F.col("f.question").alias("question"), F.col("f.answer").alias("answer")
    )


def match_pairs(
    expected: DataFrame, actual: DataFrame, segment_rows: int = SEGMENT_ROWS, keys: Sequence[str] = ("url",)
) -> DataFrame:
    """Pair the k-th expected with the k-th published occurrence of a
    question. Both sides need (keys, pos, question, answer); a question repeated
    without end on one page is numbered segment by segment."""

    def numbered(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("key", t.faq_key("question"))
        return sequence_number(keyed, [*keys, "key"], "pos", "occ", segment_rows)

    e = numbered(expected.select(*keys, "pos", "question", "answer"))
    a = numbered(actual.select(*keys, "pos", "question", "answer"))
    side = lambda df, p: df.select(*keys, "key", "occ", *[F.col(c).alias(f"{p}_{c}") for c in ("pos", "question", "answer")])
    return side(e, "exp").join(side(a, "act"), [*keys, "key", "occ"], "full_outer")


def structural_results(matched: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """Results from :func:`match_pairs`: missing, differing, passed, extra.
    Only pairs whose answers differ reach the word diff."""
    missing = F.col("act_pos").isNull()
    extra = F.col("exp_pos").isNull()
    ok = t.answer_contains("act_answer", "exp_answer")
    differs = ~missing & ~extra & ~ok
    return matched.select(
        *keys,
        F.coalesce("exp_pos", "act_pos").alias("seq"),
        F.when(extra, _named("FAQ (extra)", F.col("act_question")))
        .otherwise(_named("FAQ", F.col("exp_question")))
        .alias("check_type"),
        F.when(extra, "warning").when(missing, "failed").when(ok, "passed").otherwise("failed").alias("status"),
        F.when(extra, EXTRA_EXPECTED).otherwise(F.col("exp_answer")).alias("expected"),
        F.when(missing, MISSING_ACTUAL).otherwise(F.col("act_answer")).alias("actual"),
        F.when(extra, EXTRA_MESSAGE).when(missing, MISSING_MESSAGE).when(differs, DIFFERS_MESSAGE).alias("message"),
        diff_words(F.when(differs, F.col("exp_answer")), F.when(differs, F.col("act_answer"))).alias("diff"),
    )


def page_text_results(expected: DataFrame, page_texts: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """Plain-text mode: is the question, then the answer, somewhere in the
    page? ``page_texts(url, page_text)``; no extras can be told here. Questions
    meet their page in blocks, so a page is copied once per block, not once per
    question, and no block outgrows its bound by more than chance."""
    page = [c for c in keys if c in page_texts.columns]
    sides = [c for c in keys if c not in page]
    asked = expected.select(*page, *sides, "pos", "question", "answer")
    blocks = asked.groupBy(*page).agg(F.ceil(F.count("*") / QUESTIONS_A_BLOCK).alias("_blocks"))
    dealt = asked.join(blocks, page).withColumn("_block", F.pmod(F.xxhash64(*sides, "pos", "question"), "_blocks"))
    dealt = dealt.groupBy(*page, "_block").agg(F.collect_list(F.struct(*sides, "pos", "question", "answer")).alias("_asked"))
    joined = dealt.join(page_texts.select(*page, t.faq_key("page_text").alias("_hay")), page)
    inside = lambda c: t.let(t.faq_key(c), lambda n: (n != "") & F.col("_hay").contains(n))
    told = F.transform("_asked", lambda q: F.struct(q.alias("of"), inside(q["question"]).alias("_q"), inside(q["answer"]).alias("_a")))
    state = joined.select(*page, F.explode(told).alias("x")).select(*page, "x.of.*", "x._q", "x._a")
    return state.select(
        *keys,
        F.col("pos").alias("seq"),
        _named("FAQ", F.col("question")).alias("check_type"),
        F.when(F.col("_q") & F.col("_a"), "passed").otherwise("failed").alias("status"),
        F.col("answer").alias("expected"),
        F.when(~F.col("_q"), MISSING_ACTUAL).when(~F.col("_a"), TEXT_ACTUAL).otherwise(F.col("answer")).alias("actual"),
        F.when(~F.col("_q"), MISSING_MESSAGE).when(~F.col("_a"), TEXT_MESSAGE).alias("message"),
        F.lit(None).cast("array<struct<type:string,expected:string,actual:string>>").alias("diff"),
    )


def load_failures(groups: DataFrame, failures: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """One warning per FAQ page that did not load: failures(url, error)."""
    return groups.select(*keys).distinct().join(failures, "url").select(
        *keys,
        F.lit(LOAD_CHECK).alias("check_type"),
        F.lit("warning").alias("status"),
        F.lit(LOAD_EXPECTED).alias("expected"),
        F.concat(F.lit("Untested — the page failed to load: "), "error", F.lit(LOAD_AGAIN)).alias("actual"),
        F.concat(F.lit("Unable to load the page to check its FAQs: "), "error").alias("message"),
    )


def page_faqs(pages: DataFrame) -> DataFrame:
    """(url, faqs, page_text) of each page, and the sheet_id it was fetched for
    where it has one; the text only where no pair is found."""
    sheet = [c for c in ("sheet_id",) if c in pages.columns]
    return with_faqs(pages).select(*sheet, "url", "faqs", F.when(F.size("faqs") == 0, full_text()).alias("page_text"))


def check_found(
    expected: DataFrame, found: DataFrame, segment_rows: int = SEGMENT_ROWS, keys: Sequence[str] = ("url",)
) -> DataFrame:
    """Expected pairs against ``page_faqs``, one row per URL: structured pages by
    occurrence, others by text, and one warning for a URL without a page. With
    more ``keys`` than the URL (a sheet's id), each of its groups meets the page
    by itself; the page is still read once. Keys that ``found`` has too say which
    page a group meets."""
    keys = list(keys)
    page = [c for c in keys if c in found.columns]
    groups = expected.select(*keys).distinct()
    structured = found.where(F.size("faqs") > 0)
    actual = groups.join(structured.select(*page, F.posexplode("faqs").alias("pos", "f")), page)
    actual = actual.select(*keys, "pos", "f.question", "f.answer")
    on_structured = expected.join(structured.select(*page), page, "left_semi")
    absent = groups.join(found.select(*page), page, "left_anti")
    untested = absent.select("url").distinct().withColumn("error", F.lit(NO_SNAPSHOT))
    return (
        structural_results(match_pairs(on_structured, actual, segment_rows, keys), keys)
        .unionByName(page_text_results(expected, found.where(F.size("faqs") == 0).select(*page, "page_text"), keys))
        .unionByName(load_failures(absent, untested, keys), allowMissingColumns=True)
    )


def check_faqs(expected: DataFrame, pages: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Whole FAQ audit of pages: one snapshot per URL is compared, the latest by
    page_id."""
    wanted = pages.join(expected.select("url").distinct(), "url", "left_semi")
    return check_found(expected, page_faqs(latest_row(wanted, ["url"], ["page_id"])), segment_rows)
