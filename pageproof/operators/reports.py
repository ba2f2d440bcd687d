"""Exports and reports as row tables.

A report is a table of lines keyed by (run_id, section, seq, line): building
one needs filters and unions, not one group holding a whole run. Writers
range-partition by run and line, so the files of a run, read in name order,
are the document. ``document_lines`` is the document of every run as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageproof.functions import text as t

EXPORT = ["url", "fieldChecked", "expectedValue", "actualValue", "status", "recommendation"]
GLUED = 9
# ---- fixed values: headings and fixed sentences of the documents ------------
CHECK_HEAD = "| URL | Field Checked | Expected Value | Actual Value | Status | Recommendation | Screenshot |"
REDIRECT_HEAD = "| Original URL | Final URL | Status Code | Redirects | Recommendation |"
LINK_HEAD = "| Page | Link | Type | Status Code | Message |"
VIOLATION_HEAD = "| Rule | Impact | Nodes | Help |"
SCORE_HEAD = "| URL | Performance | Accessibility | Best Practices | SEO | Error |"
SKIPPED_HEAD = "| URL | Check | Reason |"
HEALTH_HEAD = "| Area | Passed | Failed | Warning | Total |"
CATEGORY_HEAD = "| Category | Passed | Failed | Skipped | Total |"
AVERAGE_HEAD = "| Performance | Accessibility | Best Practices | SEO | Pages Audited | Errors |"
CONTENT_HEAD = "| Total Checks | Passed | Failed | Missing Content | Modified Content | Metadata Issues |"
# -----------------------------------------------------------------------------


def _s(c) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def export_rows(checks: DataFrame, redirects: DataFrame, links: DataFrame, accessibility: DataFrame) -> DataFrame:
    """Six export columns over the four families, plus run_id, family, seq."""
    keys = ["run_id", "seq"]
    c = checks.select(
        *keys, F.lit(1).alias("family"), "url", F.col("check_type").alias("fieldChecked"),
        _s("expected").alias("expectedValue"), _s("actual").alias("actualValue"), F.upper("status").alias("status"),
        F.when(F.col("status").isin("failed", "warning"), _s("message")).otherwise("").alias("recommendation"),
    )
    r = redirects.select(
        *keys, F.lit(2).alias("family"), F.col("original_url").alias("url"), F.lit("Redirect").alias("fieldChecked"),
        F.lit("2xx/3xx, no broken redirect chain").alias("expectedValue"),
        F.concat(
            _s("status_code"), F.lit(" (final: "), "final_url", F.lit(", "), _s("redirect_count"), F.lit(" redirect(s))")
        ).alias("actualValue"),
        F.col("result").alias("status"),
        F.when(F.col("result") == "PASS", "").otherwise(F.col("recommendation")).alias("recommendation"),
    )
    l = links.select(
        *keys, F.lit(3).alias("family"), F.col("page_url").alias("url"),
        F.concat(F.lit("Link ("), "link_type", F.lit("): "), "link").alias("fieldChecked"),
        F.lit("2xx-3xx").alias("expectedValue"), _s("status_code").alias("actualValue"), "status",
        F.when(F.col("status") == "PASS", "").otherwise(F.col("message")).alias("recommendation"),
    )
    a = accessibility.select(
        *keys, F.lit(4).alias("family"), "url", F.lit("Accessibility Scan (axe-core)").alias("fieldChecked"),
        F.lit("0 violations").alias("expectedValue"),
        F.concat(F.size("violations").cast("string"), F.lit(" violation(s)")).alias("actualValue"), "status",
        F.when(F.col("status") == "PASS", "")
        .otherwise(F.array_join(F.transform("violations", lambda v: v["id"]), "; "))
        .alias("recommendation"),
    )
    return c.unionByName(r).unionByName(l).unionByName(a)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.select(*EXPORT).write.mode("overwrite").option("header", True).csv(path)


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def json_lines(report: DataFrame, keys=("run_id",)) -> DataFrame:
    return report.select(*keys, F.to_json(F.struct(*report.columns)).alias("json"))


# ---- line tables ------------------------------------------------------------


def _fixed(runs: DataFrame, section: int, *lines) -> DataFrame:
    """The same lines for every run; a NULL line is left out."""
    cols = [ln if isinstance(ln, Column) else F.lit(ln) for ln in lines]
    x = runs.select("run_id", F.posexplode(F.array(*cols)).alias("line_no", "line")).where("line is not null")
    return x.select("run_id", F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("seq"), "line_no", "line")


def _item(df: DataFrame, section: int, *lines) -> DataFrame:
    """Lines of each result row, in row order."""
    cols = [ln if isinstance(ln, Column) else F.lit(ln) for ln in lines]
    x = df.select("run_id", F.col("seq").cast("bigint").alias("seq"), F.posexplode(F.array(*cols)).alias("line_no", "line"))
    return x.where("line is not null").select("run_id", F.lit(section).alias("section"), (F.col("seq") + 1).alias("seq"), "line_no", "line")


def _rule(head: str) -> str:
    return "|" + " --- |" * (head.count("|") - 1)


def _section(runs: DataFrame, rows: DataFrame, no: int, title: str | Column, head: str | None, empty: str, *lines) -> list:
    """Title, then either the rows under a table head or one sentence."""
    has = rows.select("run_id").distinct().withColumn("_has", F.lit(True))
    marked = runs.join(has, "run_id", "left")
    opening = _fixed(
        marked, no, title, "", *([F.when(F.col("_has"), head), F.when(F.col("_has"), _rule(head))] if head else []),
        F.when(F.col("_has").isNull(), empty), F.when(F.col("_has").isNull(), ""),
    )
    closing = _fixed(marked.where("_has"), no, "").withColumn("seq", F.lit(2**62).cast("bigint"))
    parts = [opening, _item(rows, no, *lines)]
    return parts + ([closing] if head else [])


def _union(parts: list) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _score(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("n/a"))


def detail_report_lines(runs, checks, redirects, links, accessibility, scores, skipped) -> DataFrame:
    """Developer document: runs(run_id, kind, source_path, generated_at,
    duration_ms, total_rows); the families carry run_id and seq."""
    content = F.col("kind") == "blog"
    head = _fixed(
        runs, 0,
        F.when(content, "# Blog Content Validation Report (Developer)").otherwise("# SEO QA Audit Report (Developer)"), "",
        F.when(content, F.concat(F.lit("**Source Document:** `"), t.basename("source_path"), F.lit("`"))),
        F.concat(F.when(content, "- Full path: `").otherwise("- Source sheet: `"), "source_path", F.lit("`")),
        F.concat(F.lit("- Generated: "), "generated_at"),
        F.concat(F.lit("- Duration: "), _s("duration_ms"), F.lit("ms")),
        F.when(~content, F.concat(F.lit("- Rows in sheet: "), _s("total_rows"))),
        "",
    )
    advice = F.when(F.col("status") == "failed", _s("message")).otherwise("")
    shot = _s("screenshot_path") if "screenshot_path" in checks.columns else F.lit("")
    parts = [head]
    parts += _section(
        runs, checks, 1, F.when(content, "## Blog Content Comparisons").otherwise("## SEO Checks"), CHECK_HEAD,
        "No SEO field comparisons were run for this sheet.",
        t.md_row(F.col("url"), F.col("check_type"), _s("expected"), _s("actual"), F.upper("status"), advice, shot),
    )
    parts += _section(
        runs, redirects.where("result <> 'PASS'"), 2, "## Redirect Issues", REDIRECT_HEAD, "No redirect issues found.",
        t.md_row(F.col("original_url"), F.col("final_url"), F.col("status_code"), F.col("redirect_count"), F.col("recommendation")),
    )
    parts += _section(
        runs, links.where("status <> 'PASS'"), 3, "## Broken Links", LINK_HEAD, "No broken links found.",
        t.md_row(F.col("page_url"), F.col("link"), F.col("link_type"), F.col("status_code"), F.col("message")),
    )
    found = F.size("violations") > 0
    rows = F.transform(
        "violations",
        lambda v: t.md_row(v["id"], F.coalesce(v["impact"], F.lit("n/a")), v["nodeCount"].cast("string"),
                           F.concat(F.lit("[docs]("), v["helpUrl"], F.lit(")"))),
    )
    block = F.when(found, F.concat(F.array(F.lit(VIOLATION_HEAD), F.lit(_rule(VIOLATION_HEAD))), rows, F.array(F.lit("")))).otherwise(
        F.array(F.lit("No violations found."), F.lit(""))
    )
    scans = accessibility.select(
        "run_id", (F.col("seq").cast("bigint") + 1).alias("seq"),
        F.posexplode(
            F.concat(F.array(F.concat(F.lit("### "), t.md_cell("url"), F.lit(" — "), "status"), F.lit("")), block)
        ).alias("line_no", "line"),
    ).select("run_id", F.lit(4).alias("section"), "seq", "line_no", "line")
    parts += [*_section(runs, accessibility, 4, "## Accessibility", None, "No accessibility scans were run for this sheet.")[:1], scans]
    parts += _section(
        runs, scores, 5, "## Performance (Lighthouse)", SCORE_HEAD, "No Lighthouse audits were run for this sheet.",
        t.md_row(F.col("url"), *[_score(f"scores.{c}") for c in ("performance", "accessibility", "bestPractices", "seo")], _s("error")),
    )
    parts += _section(
        runs, skipped, 6, "## Skipped Rows", SKIPPED_HEAD, "No rows were skipped.",
        t.md_row(F.col("url"), F.col("check_type"), F.col("reason")),
    )
    return _union(parts)


def summary_report_lines(runs: DataFrame, categories: DataFrame) -> DataFrame:
    """Summary document. ``runs`` carries counts as structs: checks,
    redirects, links, accessibility (passed, failed, warning, total),
    violations, skipped, scores (audited_pages, errors, performance, ...) and,
    for content runs, content. ``categories`` adds first_seq for ties."""
    blog = F.col("kind") == "blog"
    counts = lambda label, c: t.md_row(F.lit(label), *[F.col(f"{c}.{x}") for x in ("passed", "failed", "warning", "total")])
    has_content = blog & F.col("content").isNotNull()
    head = _fixed(
        runs, 0,
        F.when(blog, "# Blog Content Validation Summary (QA)").otherwise("# SEO QA Summary Report"), "",
        F.concat(F.when(blog, "- Source document: `").otherwise("- Source sheet: `"), "source_path", F.lit("`")),
        F.concat(F.lit("- Generated: "), "generated_at"),
        F.when(~blog, F.concat(F.lit("- Rows audited: "), _s("total_rows"))), "",
        *[
            F.when(has_content, x)
            for x in (
                F.lit("## Blog Content Validation Summary"), F.lit(""), F.lit(CONTENT_HEAD), F.lit(_rule(CONTENT_HEAD)),
                t.md_row(*[F.col(f"content.{x}") for x in
                           ("total_checks", "passed", "failed", "missing_content", "modified_content", "metadata_issues")]),
                F.lit(""),
            )
        ],
        "## Overall Health", "", HEALTH_HEAD, _rule(HEALTH_HEAD),
        counts("SEO Checks", "checks"), counts("Redirects", "redirects"), counts("Broken Links", "links"),
        counts("Accessibility (pages)", "accessibility"), "",
        F.concat(F.lit("Accessibility violations found: **"), _s("violations"), F.lit("**")), "",
        F.concat(F.lit("Rows skipped (no implemented check): **"), _s("skipped"), F.lit("**")), "",
    )
    sheets = runs.where(~blog)
    # Largest category first; ties in order of first appearance.
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("total"), "first_seq", "category"))
    ranked = categories.withColumn("seq", place.cast("bigint"))
    cats = _section(
        sheets, ranked.join(sheets.select("run_id"), "run_id", "left_semi"), 1, "## SEO Issues by Category", CATEGORY_HEAD,
        "No SEO checks were executed for this sheet.",
        t.md_row(*[F.col(c) for c in ("category", "passed", "failed", "skipped", "total")]),
    )
    audited = F.col("scores.audited_pages") > 0
    tail = _fixed(
        runs, 2, "## Lighthouse Averages", "",
        F.when(audited, AVERAGE_HEAD), F.when(audited, _rule(AVERAGE_HEAD)),
        F.when(
            audited,
            t.md_row(*[_score(f"scores.{c}") for c in
                       ("performance", "accessibility", "best_practices", "seo", "audited_pages", "errors")]),
        ).otherwise("No Lighthouse audits were run for this sheet."), "",
    )
    return _union([head, *cats, tail])


def bug_report_lines(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Hand-over document: Must Fix, Warnings, Passed. ``runs`` may pin the
    page with ``url``; else a run over one URL names it, and a run over many
    shows the URL per issue. Names of passed checks belong to one text line;
    they come as rows of section GLUED, each a line of one paragraph, so that
    no run's passed checks are ever gathered."""
    stats = checks.groupBy("run_id").agg(
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "warning").alias("n_warning"),
        F.count_if(F.col("status") == "passed").alias("n_passed"),
        F.count_distinct(F.nullif("url", F.lit(""))).alias("n_urls"),
        F.min(F.nullif("url", F.lit(""))).alias("only_url"),
    )
    pinned = F.col("url") if "url" in runs.columns else F.lit(None).cast("string")
    r = runs.withColumn("_pin", pinned).join(stats, "run_id", "left").na.fill(
        0, ["n_failed", "n_warning", "n_passed", "n_urls"]
    ).withColumn("single_url", F.coalesce("_pin", F.when(F.col("n_urls") <= 1, F.col("only_url"))))
    blog = F.col("kind") == "blog"
    issues = (F.col("n_failed") > 0) | (F.col("n_warning") > 0)
    head = _fixed(
        r, 0,
        F.when(blog, "# Blog Content Bug Report").otherwise("# SEO Audit Bug Report"), "",
        F.when(F.col("single_url").isNotNull(), F.concat(F.lit("Live URL: "), "single_url")).otherwise(
            F.concat(F.lit("Pages tested: "), _s("n_urls"))
        ),
        F.concat(
            F.when(blog, "Approved source document").otherwise("Audit sheet"), F.lit(": "), t.basename("source_path")
        ),
        F.concat(F.lit("Tested: "), "generated_at"),
        F.concat(
            F.lit("Result: "), _s("n_failed"), F.lit(" Failed, "), _s("n_warning"),
            F.when(F.col("n_warning") == 1, " Warning, ").otherwise(" Warnings, "), _s("n_passed"), F.lit(" Passed"),
        ),
        "",
        F.when(~issues, "No issues found. Every check in this run passed — nothing for a developer to fix."),
        F.when(~issues, ""),
    )
    live = r.where(issues)
    rows = checks.withColumnRenamed("url", "page").join(live.select("run_id", "single_url"), "run_id")
    title = F.concat(
        F.lit("### "), "check_type",
        F.when(F.col("single_url").isNull(), F.concat(F.lit(" — "), "page")).otherwise(""),
    )
    issue = [
        title,
        F.concat(F.lit("Expected: "), F.coalesce("expected", F.lit("(none)"))),
        F.concat(F.lit("Actual: "), F.coalesce("actual", F.lit("(missing from the live page)"))),
        "",
    ]
    parts = [head]
    for no, status, name in ((1, "failed", "## Must Fix"), (2, "warning", "## Warnings")):
        parts.append(_fixed(live.where(F.col(f"n_{status}") > 0), no, name, ""))
        parts.append(_item(rows.where(F.col("status") == status), no, *issue))
    none = F.col("n_passed") == 0
    parts.append(
        _fixed(
            live, 3, "## Passed", "",
            F.when(none, "None.").otherwise(
                F.concat(_s("n_passed"), F.lit(" check(s) already match the approved document:"))
            ),
            F.when(none, ""),
        )
    )
    parts.append(_item(rows.where("status = 'passed'"), GLUED, F.col("check_type")))
    return _union(parts)


def nested_headings(lines: DataFrame) -> DataFrame:
    """Demote headings by two, for a report inside a batch report."""
    return lines.withColumn("line", F.regexp_replace("line", r"^(#{1,4}\s)", "##$1"))


def batch_report_lines(items: DataFrame, run_lines: DataFrame) -> DataFrame:
    """Combined document of batches: items(batch_id, index, filename, note,
    audit_id); ``note`` says why an item has no report."""
    size = items.groupBy("batch_id").agg(F.count("*").alias("n"))
    opening = size.select(
        F.col("batch_id"), F.lit(-1).cast("int").alias("index"), F.lit(0).alias("section"),
        F.lit(0).cast("bigint").alias("seq"),
        F.posexplode(
            F.array(
                F.lit("# Blog Content Bug Report — Batch"), F.lit(""),
                F.concat(F.lit("Combined report for "), _s("n"), F.lit(" blog(s) tested together.")), F.lit(""),
            )
        ).alias("line_no", "line"),
    )
    heads = items.select(
        "batch_id", F.col("index").cast("int").alias("index"), F.lit(-1).alias("section"),
        F.lit(0).cast("bigint").alias("seq"),
        F.posexplode(
            F.filter(
                F.array(F.lit("---"), F.lit(""), F.concat(F.lit("## "), "filename"), F.lit(""), F.col("note"),
                        F.when(F.col("note").isNotNull(), "")),
                lambda x: x.isNotNull(),
            )
        ).alias("line_no", "line"),
    )
    body = nested_headings(run_lines).join(
        items.where("note is null").select("batch_id", F.col("index").cast("int").alias("index"), F.col("audit_id").alias("run_id")),
        "run_id",
    ).select("batch_id", "index", "section", "seq", "line_no", "line")
    return opening.unionByName(heads).unionByName(body)


def write_lines(lines: DataFrame, path: str, by: str = "run_id") -> None:
    """Text files per run, ordered within and across files."""
    order = [by, *[c for c in ("index", "section", "seq", "line_no") if c in lines.columns]]
    (
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(by, "line")
        .write.mode("overwrite")
        .partitionBy(by)
        .text(path)
    )


def document_lines(lines: DataFrame) -> DataFrame:
    """(run_id, section, seq, line_no, line): the document of every run, one row
    per line, however many it has. Names of section GLUED are lines of one
    paragraph, which Markdown shows as running text; all but the last of a run
    end in a comma, told by one aggregate over the names."""
    glued = lines.where(F.col("section") == GLUED)
    place = F.struct("seq", "line_no")
    last = glued.groupBy("run_id").agg(F.max(place).alias("_last"))
    marked = glued.join(last, "run_id").withColumn("line", F.when(place == F.col("_last"), F.col("line")).otherwise(F.concat("line", F.lit(","))))
    columns = ["run_id", "section", "seq", "line_no", "line"]
    return lines.where(F.col("section") != GLUED).select(columns).unionByName(marked.select(columns))


def report_paths(runs: DataFrame) -> DataFrame:
    """File names of a run's six outputs."""
    prefix = F.concat(t.source_slug("source_path"), F.lit("-"), t.compact_timestamp("generated_at"))
    names = [
        ("audit-report-", "json"), ("audit-report-", "csv"), ("developer-report-", "md"),
        ("qa-report-", "md"), ("developer-report-", "html"), ("qa-report-", "html"),
    ]
    return runs.select(
        "run_id",
        F.explode(
            F.array(*[F.struct(F.lit(ext).alias("format"), F.concat(F.lit(lead), prefix, F.lit("." + ext)).alias("file_name")) for lead, ext in names])
        ).alias("f"),
    ).select("run_id", "f.format", "f.file_name")
