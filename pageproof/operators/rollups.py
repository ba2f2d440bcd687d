"""Counts, summaries and roll-ups of results; all map-side combinable."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageproof.functions import text as t
from pageproof.functions.urls import url_host
from pageproof.operators.sheet_rules import issue_type

# ---- fixed values -----------------------------------------------------------
METADATA_CHECKS = ("Meta Title", "Meta Description")
STATUS_RANK = {"failed": 0, "warning": 1, "skipped": 2, "passed": 3}
SCORES = {"performance": "performance", "accessibility": "accessibility", "bestPractices": "best_practices", "seo": "seo"}
# -----------------------------------------------------------------------------


def _count(status: str | Column, column: str = "status") -> Column:
    return F.count_if(F.col(column) == status)


def check_counts(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """passed / failed / warning / total; skipped counts in the total only."""
    return results.groupBy(*keys).agg(
        _count("passed").alias("passed"),
        _count("failed").alias("failed"),
        _count("warning").alias("warning"),
        F.count("*").alias("total"),
    )


def module_counts(results: DataFrame, keys: Sequence[str] = (), column: str = "status") -> DataFrame:
    """The same for PASS / FAIL / WARNING results."""
    return results.groupBy(*keys).agg(
        _count("PASS", column).alias("passed"),
        _count("FAIL", column).alias("failed"),
        _count("WARNING", column).alias("warning"),
        F.count("*").alias("total"),
    )


def accessibility_counts(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*keys).agg(
        _count("PASS").alias("passed"),
        _count("FAIL").alias("failed"),
        F.lit(0).cast("bigint").alias("warning"),
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.size("violations")), F.lit(0)).cast("bigint").alias("violations"),
    )


def accessibility_status(results: DataFrame) -> DataFrame:
    return results.withColumn("status", F.when(F.size("violations") == 0, "PASS").otherwise("FAIL"))


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def score_averages(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Audited pages, errors, and mean whole-percent scores without errored
    pages and NULLs; NULL when nothing is left. ``scores`` holds 0-100."""
    fine = F.coalesce("error", F.lit("")) == ""
    mean = lambda c: _half_up(F.avg(F.when(fine, F.col(f"scores.{c}"))))
    return results.groupBy(*keys).agg(
        F.count("*").alias("audited_pages"),
        F.count_if(~fine).alias("errors"),
        *[mean(c).alias(n) for c, n in SCORES.items()],
    )


def percent_scores(results: DataFrame) -> DataFrame:
    """0-1 engine scores to whole percent."""
    return results.withColumn(
        "scores", F.struct(*[t.score_pct(F.col(f"scores.{c}")).alias(c) for c in SCORES])
    )


def category_breakdown(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per issue category; warnings count as skipped. ``first_seq`` breaks
    ties when ordering by total, as the first result seen would."""
    first = F.min("seq") if "seq" in results.columns else F.lit(0)
    return (
        results.withColumn("category", issue_type("check_type"))
        .groupBy(*keys, "category")
        .agg(
            _count("passed").alias("passed"),
            _count("failed").alias("failed"),
            F.count_if(~F.col("status").isin("passed", "failed")).alias("skipped"),
            F.count("*").alias("total"),
            first.alias("first_seq"),
        )
    )


def content_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Content run summary with its bold breakdown; skipped checks excluded."""
    seen = F.col("status") != "skipped"
    failed = F.col("status") == "failed"
    blank = F.trim(F.coalesce("actual", F.lit(""))) == ""
    bold = seen & F.col("check_type").startswith("Bold:")
    return results.groupBy(*keys).agg(
        F.count_if(seen).alias("total_checks"),
        _count("passed").alias("passed"),
        F.count_if(failed).alias("failed"),
        F.count_if(failed & blank).alias("missing_content"),
        F.count_if(failed & ~blank).alias("modified_content"),
        F.count_if(failed & F.col("check_type").isin(*METADATA_CHECKS)).alias("metadata_issues"),
        F.count_if(bold).alias("bold_total"),
        F.count_if(bold & (F.col("status") == "passed")).alias("bold_passed"),
        F.count_if(bold & failed).alias("bold_missing"),
        F.lit(0).cast("bigint").alias("bold_modified"),
        F.count_if(seen & F.col("check_type").startswith("Bold (extra)")).alias("bold_extra"),
    )


def run_total_rows(sheets: DataFrame) -> DataFrame:
    """sheets(sheet_id, mode, row_count, faq_count, unresolved_count)."""
    return sheets.withColumn(
        "total_rows",
        F.when(F.col("mode") == "faq", F.col("faq_count") + F.col("unresolved_count")).otherwise(F.col("row_count")),
    )


def batch_summary(items: DataFrame) -> DataFrame:
    """items(batch_id, status, failed): failed is the content failure count."""
    done = F.col("status") == "done"
    return items.groupBy("batch_id").agg(
        F.count("*").alias("total"),
        F.count_if(done & (F.col("failed") == 0)).alias("passed"),
        F.count_if(done & (F.coalesce("failed", F.lit(0)) > 0)).alias("failed"),
        _count("error").alias("errored"),
        F.coalesce(F.sum("failed"), F.lit(0)).cast("bigint").alias("total_mismatches"),
    )


def percentage(value, total) -> Column:
    value, total = (F.col(c) if isinstance(c, str) else c for c in (value, total))
    return F.coalesce(_half_up(F.try_divide(value, total) * 100), F.lit(0))


def dashboard_totals(families: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of family counts (passed, failed, warning, total) with shares."""
    sums = families.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("passed", "failed", "warning", "total")])
    return sums.withColumns({f"{c}_pct": percentage(c, "total") for c in ("passed", "failed", "warning")})


def tone(score) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= 90, "success").when(score >= 50, "warning").when(score.isNotNull(), "danger").otherwise("neutral")


def sheet_cards(families: DataFrame, performance: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals without accessibility, mean performance and its tone band.
    families(keys, family, passed, failed, warning); performance(keys, scores)."""
    totals = (
        families.where(F.col("family") != "accessibility")
        .groupBy(*keys)
        .agg(*[F.sum(c).cast("bigint").alias(f"total_{c}") for c in ("passed", "failed", "warning")])
    )
    mean = performance.groupBy(*keys).agg(_half_up(F.avg("scores.performance")).alias("avg_performance"))
    return totals.join(mean, list(keys), "left").withColumn("tone", tone("avg_performance"))


def home_totals(runs: DataFrame, newest: int = 6) -> DataFrame:
    """Counts over the newest runs: the top-k keeps its limit as the feature."""
    top = runs.orderBy(F.desc("created_at"), "id").limit(newest)
    return top.agg(
        F.coalesce(F.sum("passed"), F.lit(0)).cast("bigint").alias("passed"),
        F.coalesce(F.sum("failed"), F.lit(0)).cast("bigint").alias("failed"),
        F.max("created_at").alias("last_run"),
    )


def status_facets(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count("*").alias("all"), *[_count(s).alias(s) for s in ("failed", "warning", "passed", "skipped")]
    )


def exit_gate(runs: DataFrame) -> DataFrame:
    """Run passes its gate without failures and without regressions."""
    return runs.withColumn("gate", (F.col("failed") == 0) & (F.coalesce("new_issues", F.lit(0)) == 0))


def site_rollup(results: DataFrame) -> DataFrame:
    """Host x category counts with subtotals; ``level`` tells them apart
    (0 detail, 1 host total, 3 grand total)."""
    base = results.select(url_host("url").alias("host"), issue_type("check_type").alias("category"), "status")
    return base.rollup("host", "category").agg(
        F.grouping_id().cast("int").alias("level"),
        _count("passed").alias("passed"),
        _count("failed").alias("failed"),
        _count("warning").alias("warning"),
        F.count("*").alias("total"),
    )


def duplicate_values(pages: DataFrame, column: str) -> DataFrame:
    """Values shared by several pages. Counted per value, never listed: a
    value on a third of all pages stays one row."""
    return (
        pages.withColumn("value", t.normalize_cmp(column))
        .where("value <> ''")
        .groupBy("value")
        .agg(F.count("*").alias("pages"), F.min("url").alias("first_url"))
        .where("pages > 1")
    )


def diff_statistics(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Segments per type and the results they come from."""
    return (
        results.where(F.col("diff").isNotNull())
        .select(*keys, F.explode("diff").alias("d"))
        .groupBy(*keys, F.col("d.type").alias("type"))
        .agg(F.count("*").alias("segments"))
    )


def search_results(results: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    """Status filter plus case-insensitive text in any shown column."""
    out = results if status == "all" else results.where(F.col("status") == status)
    if not text:
        return out
    q = text.lower()
    hit = F.lit(False)
    for c in ("url", "check_type", "expected", "actual"):
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(q)
    return out.where(hit)


def status_rank(column: str = "status") -> Column:
    out = F
    for name, rank in STATUS_RANK.items():
        out = out.when(F.col(column) == name, rank)
    return out.otherwise(9)


def sort_results(results: DataFrame, by: str = "status", descending: bool = False) -> DataFrame:
    """Order by status rank, url or check_type; ties by url, check, seq."""
    key = status_rank() if by == "status" else F.col(by)
    ties = [c for c in ("url", "check_type", "seq") if c in results.columns and c != by]
    return results.orderBy(key.desc() if descending else key.asc(), *ties)


def result_page(results: DataFrame, page: int, size: int = 25, **order) -> DataFrame:
    return sort_results(results, **order).offset(page * size).limit(size)


def page_after(
    results: DataFrame, last: Mapping | None = None, size: int = 25, by: str = "status", descending: bool = False
) -> DataFrame:
    """The page that follows ``last``, the last row of the page before; the first
    page without it. Rows are in the order of ``sort_results``, ties broken by the
    other plain columns. The row's sort key bounds the scan, so a task holds a page
    at most, however deep the page lies. Rows that are alike in every plain column
    can't be told apart: give results a ``seq``."""
    key = status_rank() if by == "status" else F.col(by)
    first = [c for c in ("url", "check_type", "seq") if c in results.columns and c != by]
    plain = [c for c, kind in results.dtypes if not kind.startswith(("array", "map", "struct"))]
    keys = [(by, key), *[(c, F.col(c)) for c in [*first, *plain] if c != by or by == "status"]]
    keys = list(dict((name if i else "", (name, k)) for i, (name, k) in enumerate(keys)).values())
    if last is not None:
        at = F.lit(STATUS_RANK.get(last[by], 9)) if by == "status" else F.lit(last[by])
        marks = [at, *[F.lit(last[c]) for c, _ in keys[1:]]]
        beyond, same = F.lit(False), F.lit(True)
        for i, ((_, key), mark) in enumerate(zip(keys, marks, strict=True)):
            # Ascending, NULL comes first; descending, it comes last.
            if i == 0 and descending:
                after = mark.isNotNull() & ((key < mark) | key.isNull())
            else:
                after = (mark.isNull() & key.isNotNull()) | (key > mark)
            beyond = beyond | (same & F.coalesce(after, F.lit(False)))
            same = same & key.eqNullSafe(mark)
        results = results.where(beyond)
    order = [k.desc() if descending and not i else k.asc() for i, (_, k) in enumerate(keys)]
    return results.orderBy(*order).limit(size)


def ordered_categories(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The category breakdown in report order: ``position`` from 1 by falling
    total, ties by the first result seen. A group has as many rows as there are
    categories, a fixed list."""
    window = Window.partitionBy(*keys).orderBy(F.desc("total"), "first_seq", "category")
    return category_breakdown(results, keys).withColumn("position", F.row_number().over(window)).drop("first_seq")
