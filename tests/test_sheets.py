import pytest
from pyspark.sql import functions as F

from pageproof.operators import checks as C
from pageproof.operators import sheet_rules as N
from pageproof.plans import audits
from pageproof.sources import sheets as S

CELL = "sheet_id string, row_no bigint, col_no int, value string, hyperlink string"


def cells(spark, *rows, sheet="s"):
    return spark.createDataFrame(
        [(sheet, r + 1, c, v, None) for r, row in enumerate(rows) for c, v in enumerate(row)], CELL
    )


def audit(spark, *rows):
    out = N.audit_rows(cells(spark, *rows), segment_rows=3).orderBy("source_row_number", "issue_type")
    return out.collect()


def test_issue_sheet(spark):
    got = audit(
        spark,
        ["Page URL", "Problem", "Recommended Value", "Current Value", "Priority", "Comments"],
        ["https://example.com/", "Missing title", "New homepage title", "", "High", "Update title tag"],
        ["", "", "", "", "", ""],
        ["https://example.com/about", "Meta description too short", "About page summary", "Short", "Medium", ""],
    )
    assert [(r.issue_type, r.severity, r.expected, r.actual, r.source_row_number) for r in got] == [
        ("title", "high", "New homepage title", None, 2),
        ("metaDescription", "medium", "About page summary", "Short", 3),
    ]
    assert len(got[0].raw) == 6 and got[0].notes == "Update title tag" and got[1].notes is None


def test_second_header_spelling_and_title_rows_above(spark):
    got = audit(
        spark, ["Audit of March"], ["Address", "SEO Issue", "Expected", "Actual", "Severity", "Notes"], ["https://x.com", "404 found", "", "", "weird", "broken links here"]
    )
    assert [(r.issue_type, r.severity, r.source_row_number) for r in got] == [("brokenLink", None, 3)]


def test_recommendation_sheet(spark):
    head = ["Current URL", "Suggested Meta Title", "Suggested Meta Description", "Canonical Tag", "Suggested H1", "Suggested H2"]
    got = audit(spark, head, ["https://x.com/a", "T", "D", "https://x.com/a", "H", "S"], ["https://x.com/b", "Only title", "", "", "", ""])
    assert len(got) == 6 and {r.issue_type for r in got} == {"title", "metaDescription", "canonical", "h1", "h2"}


def test_measurement_and_current_columns_are_ignored(spark):
    head = ["Current URL", "Suggested Meta Title", "Title Chars", "Current meta description", "Suggested Meta Description"]
    got = audit(spark, head, ["https://x.com", "T", "55", "old", "D"])
    assert sorted((r.issue_type, r.expected) for r in got) == [("metaDescription", "D"), ("title", "T")]


def test_blank_cell_in_known_url_column_drops_the_row(spark):
    head = ["Source Page URL", "Image URL", "Optimised Alt Text"]
    assert audit(spark, head, ["", "https://x.com/i.png", "Alt"]) == []
    got = audit(spark, head, ["https://x.com/p", "https://x.com/i.png", "Alt"])
    assert [(r.url, r.issue_type) for r in got] == [("https://x.com/p", "imageAlt")]


def test_generic_recommendation_column_beside_fields(spark):
    got = audit(spark, ["Current URL", "Recommendation", "Suggested Meta Title", "Suggested H1"], ["https://x.com", "do", "T", "H"])
    assert sorted(r.issue_type for r in got) == ["h1", "title"]


def test_no_url_column_scans_the_row(spark):
    got = audit(spark, ["Notes", "Severity"], ["fix robots", "low", "https://x.com/z"])
    assert [(r.url, r.check_type, r.issue_type) for r in got] == [("https://x.com/z", "fix robots", "robots")]


def test_duplicate_and_blank_headers(spark):
    got = audit(spark, ["URL", "Issue", "", "Notes", "Notes"], ["https://x.com", "h1", "v", "first", "second"])
    assert got[0].raw == {"URL": "https://x.com", "Issue": "h1", "Column 3": "v", "Notes": "second"}


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿URL,Issue,"Notes"\r\n\r\n https://x.com ,"title, ""old""","two\nlines",extra\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("just," + "x" * 200_000 + ',"' + 'y""' * 50_000 + '"\n')
    got = S.read_csv_cells(spark, str(tmp_path))
    one = [(r.row_no, r.col_no, r.value) for r in got.where(F.col("sheet_id").endswith("a.csv")).orderBy("row_no", "col_no").collect()]
    assert [v for _, _, v in one] == ["URL", "Issue", "Notes", "https://x.com", 'title, "old"', "two\nlines", "extra"]
    assert [r.n for r in got.where(F.col("sheet_id").endswith("b.csv")).select(F.length("value").alias("n")).collect()] == [4, 200_000, 100_000]
    linked = S.csv_hyperlinks(got).where("hyperlink is not null").collect()
    assert [r.hyperlink for r in linked] == ["https://x.com"]


def test_unsupported_files(spark):
    files = spark.createDataFrame([("a.csv",), ("b.XLSX",), ("c.pdf",), ("noext",)], "path string")
    assert [(r.path, r.reason) for r in S.unsupported_files(files).collect()] == [
        ("c.pdf", "Unsupported audit sheet format: .pdf"), ("noext", "Unsupported audit sheet format: unknown"),
    ]


def test_modules_once_per_url_and_forced(spark):
    rows = spark.createDataFrame(
        [("https://a", "redirect", None), ("https://a", "redirect", None), ("https://b", "brokenLink", "timeout"), ("https://b", "title", "timeout"), ("https://c", "accessibility", None)],
        "url string, issue_type string, load_error string",
    )
    sent = C.dispatch(rows)
    plain = {tuple(r) for r in C.module_urls(sent).collect()}
    assert plain == {("https://a", "redirect"), ("https://c", "accessibility")}
    forced = C.module_urls(sent, accessibility=False, always_links=True, performance_urls=spark.createDataFrame([(" https://b ",)], "url string"))
    assert {tuple(r) for r in forced.collect()} == {
        ("https://a", "redirect"), ("https://a", "brokenLink"), ("https://c", "brokenLink"), ("https://b", "performance"),
    }
    assert {r.reason.split(":")[0] for r in C.skipped_rows(sent, accessibility=False).collect()} == {
        "Unable to load the page to scan for broken links", "Accessibility checks are disabled for this run.",
    }


def test_sheet_audit_end_to_end(spark):
    pages = spark.createDataFrame([(1, "https://x.com/a", "<title>New  Title</title><h1>x</h1>")], "page_id long, url string, html string")
    sheet = cells(
        spark, ["URL", "Issue", "Expected"], ["https://x.com/a", "Meta title", "new title"], ["https://x.com/a", "h1", "other"], ["/gone", "h2", "x"], ["https://x.com/a", "sitemap", ""]
    )
    a = audits.audit_sheets(sheet, pages, base_url="https://x.com", segment_rows=2)
    got = {(r.check_type, r.status, r.message) for r in a.results.collect()}
    assert got == {
        ("Meta title", "passed", "Meta title is valid."), ("h1", "failed", "H1 does not match the expected value."),
        ("h2", "failed", "Unable to load the page for SEO validation: no snapshot of this page"),
    }
    assert [r.reason for r in a.skipped.collect()] == ['No SEO check is implemented for issue type "sitemap".']


def test_a_check_can_be_added(spark):
    registry = {**C.check_registry(), "sitemap": C.expected_or_presence(F.col("title"), F.col("expected"), "Map")}
    rows = spark.createDataFrame([("u", "c", "sitemap", "t", None, "t")], "url string, check_type string, issue_type string, expected string, load_error string, title string")
    sent = C.dispatch(rows, registry).withColumns({c: F.lit(None).cast("string") for c in ("meta_description", "canonical", "h1_text", "h2_text")})
    sent = sent.withColumns({
        "images": F.array().cast("array<struct<src:string,alt:string>>"),
        "og_tags": F.array().cast("array<struct<name:string,content:string>>"), "twitter_tags": F.array().cast("array<struct<name:string,content:string>>"),
    })
    assert C.field_results(sent, registry).first().message == "Map is valid."


def test_merges_reach_columns_past_the_twentieth(spark):
    from pageproof.sources.sheets import expand_merges

    cells = spark.createDataFrame([("s", 0, 24, "wide", None)], "sheet_id string, row_no long, col_no int, value string, hyperlink string")
    merges = spark.createDataFrame([("s", 0, 24, 1, 25)], "sheet_id string, top long, left int, bottom long, right int")
    assert {(r.row_no, r.col_no, r.value) for r in expand_merges(cells, merges).collect()} == {(i, j, "wide") for i in (0, 1) for j in (24, 25)}


def test_the_latest_snapshot_alone_counts(spark):
    pages = spark.createDataFrame(
        [(1, "https://x.com/a", "<title>old</title>"), (2, "https://x.com/a", "<title>new</title>")], "page_id long, url string, html string"
    )
    sheet = cells(spark, ["URL", "Issue", "Expected"], ["https://x.com/a", "Meta title", "new"], ["https://x.com/a", "h1", "x"])
    got = audits.audit_sheets(sheet, pages).results.collect()
    assert sorted((r.check_type, r.status) for r in got) == [("Meta title", "passed"), ("h1", "failed")]
    brief = "<p>Meta Title: new</p><p>-------</p><p>Some text of the page that is long enough.</p>"
    briefs = spark.createDataFrame([(7, "https://x.com/a", brief), (8, "https://x.com/gone", brief)], "doc_id long, url string, html string")
    results = audits.audit_content(briefs, pages).collect()
    assert len({(r.pair_id, r.family, r.seq, r.check_type) for r in results}) == len(results)
    assert [(r.status, r.family) for r in results if r.pair_id == 8] == [("error", "load")]


def test_faq_sheets_are_told_first_and_checked_by_themselves(spark):
    a, b = "https://x.com/a", "https://x.com/b"
    schema = "sheet_id int, row_no int, col_no int, value string, hyperlink string"
    rows = [(1, 1, c, v, None) for c, v in enumerate(["URL", "Issue", "Expected"])] + [(1, 2, c, v, None) for c, v in enumerate([a, "Meta title", "T"])]
    for sheet, faqs in ((2, [("A", a, "Why?", "Because"), ("A", a, "Gone?", "x")]), (3, [("A", a, "Why?", "No"), ("B", b, "How?", "So"), ("C", None, "Who?", "We")])):
        rows += [(sheet, 1, c, v, None) for c, v in enumerate(["URL", "FAQs", "Answer"])]
        for n, (label, link, q, answer) in enumerate(faqs):
            rows += [(sheet, n + 2, 0, label, link), (sheet, n + 2, 1, q, None), (sheet, n + 2, 2, answer, None)]
    pages = spark.createDataFrame([(1, a, "<title>T</title><body><details><summary>Why?</summary>Because</details></body>")], "page_id long, url string, html string")
    table = spark.createDataFrame(rows, schema)
    got = sorted((r.sheet_id, r.check_type, r.status) for r in audits.audit_sheets(table, pages).results.collect())
    assert got == [
        (1, "Meta title", "passed"), (2, 'FAQ: "Gone?"', "failed"), (2, 'FAQ: "Why?"', "passed"),
        (3, "FAQ (page load failed)", "warning"), (3, "FAQ (skipped)", "warning"), (3, 'FAQ: "Why?"', "failed"),
    ]
    errors = spark.createDataFrame([(a, "timeout")], "url string, error string")
    failed = [r for r in audits.audit_sheets(table, pages, load_errors=errors).results.collect() if r.sheet_id == 2]
    assert [(r.url, r.status) for r in failed] == [(a, "warning")] and "timeout" in failed[0].message
    seen = audits.preview_sheets(table)
    modes = {r.sheet_id: (r.mode, r.row_count, r.faq_page_count, r.faq_count) for r in seen.sheets.collect()}
    assert modes[2] == ("faq", 2, 1, 2) and modes[3] == ("faq", 2, 2, 2) and modes[1][0] != "faq" and modes[1][1:] == (1, None, None)
    assert sorted((r.sheet_id, r.url) for r in seen.urls.collect()) == [(1, a), (2, a), (3, a), (3, b)]
    assert [(r.sheet_id, r.label) for r in seen.unresolved.collect()] == [(3, "C")]


def test_the_latest_snapshot_has_a_total_order(spark):
    schema = "page_id long, url string, html string, fetched_at string"
    rows = [(1, "a", "first", None), (2, "a", "second", None), (3, "b", "dated", "2024-01-01"), (4, "b", "undated", None)]
    rows += [(5, "c", None, "2024-02-01"), (5, "c", "known", "2024-02-01"), (6, "d", None, None), (None, "e", "x", None), (None, "e", "y", None)]
    got = {r.url: (r.page_id, r.html) for r in audits.latest_snapshots(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    assert got == {"a": (2, "second"), "b": (3, "dated"), "c": (5, "known"), "d": (6, None), "e": (None, "y")}
    pages = spark.createDataFrame([(1, "https://x.com/a", "<title>T</title>", None)], schema)
    sheet = cells(spark, ["URL", "Issue", "Expected"], ["https://x.com/a", "Meta title", "T"], ["https://x.com/a", "h2", "Sub"])
    got = audits.audit_sheets(sheet, pages).results.collect()
    assert [(r.status, r.actual) for r in sorted(got, key=lambda r: r.check_type)] == [("passed", "T"), ("failed", "")]


def test_a_sheet_without_faqs_starts_no_faq_jobs(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "https://x.com/a", "<title>T</title>")], "page_id long, url string, html string")
    sheet = cells(spark, ["URL", "Issue", "Expected"], ["https://x.com/a", "Meta title", "T"])
    monkeypatch.setattr(audits, "materialized", lambda df: pytest.fail("a job ran before results were asked for"))
    audit = audits.audit_sheets(sheet, pages)
    assert audit.rows.columns and audit.skipped.columns
    monkeypatch.undo()
    monkeypatch.setattr(audits, "faq_results", lambda *a: pytest.fail("FAQ jobs without an FAQ sheet"))
    assert audit.results.count() == 1


def test_split_csv_files_have_the_cells_of_whole_ones(spark, tmp_path):
    import csv
    import io
    import random

    rng = random.Random(4)
    word = lambda: rng.choice(["a", "two words", 'quo"te', "line\nbreak", "", " pad ", "x,y", "é", "cr\r\nlf"])
    for name in ("a.csv", "b.csv"):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\r\n" if name == "a.csv" else "\n")
        for _ in range(400):
            writer.writerow([word() for _ in range(rng.randint(1, 4))])
            if rng.random() < 0.1:
                out.write("\n")
        (tmp_path / name).write_text("\ufeff" + out.getvalue(), encoding="utf-8", newline="")
    key = lambda r: (r.sheet_id.rsplit("/", 1)[1], r.row_no, r.col_no, r.value)
    want = sorted(map(key, S.read_csv_cells(spark, str(tmp_path)).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = sorted(map(key, S.read_split_csv_cells(spark, str(tmp_path), segment_bytes=300).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "c.csv").write_text('a,"b"\nc,"d\ne,f\n')
    got = S.read_split_csv_cells(spark, str(tmp_path / "open")).orderBy("row_no", "col_no").collect()
    assert [(r.row_no, r.value) for r in got][:3] == [(1, "a"), (1, "b"), (2, "c")] and got[-1].value == "f"


def test_needles_of_issue_types_turn_no_match_away(spark):
    """Every way to write a pattern, also in capitals, between other letters and
    beside characters that change their length in lower case, against the patterns
    alone."""
    import itertools
    import re

    def ways(pattern):
        pattern = re.sub(r"\\b|\(\?:|\)", "", pattern)
        for part in pattern.split("|"):
            pieces = re.findall(r"\[[^]]*\]|\\s\*|.\?|.", part)
            options = [("", " ", "\t\n") if p == r"\s*" else tuple(p[1:-1]) if p[0] == "[" else ("", p[0]) if p.endswith("?") else (p,) for p in pieces]
            yield from ("".join(x) for x in itertools.product(*options))

    written = sorted({w for _, pattern in N.ISSUE_TYPES for w in ways(pattern)})
    values = [v for w in written for v in (w, w.upper(), f"\u0130\u1e9e {w.title()}, \u212a", f"x{w}", f"{w}9", w[:-1])] + ["", None, "plain"]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = frame.select("i", N.issue_type("v").alias("found"), N.first_match(F.col("v"), N.ISSUE_TYPES, "unknown").alias("plain")).collect()
    assert [r for r in got if r.found != r.plain] == [] and {r.found for r in got} == {*N.NEEDLES, "unknown"}
    # Each pattern by itself, as an earlier one may hide it.
    own = frame.where("v is not null").select("v", F.lower("v").alias("low"), *[F.col("v").rlike(f"(?i){p}").alias(k) for k, p in N.ISSUE_TYPES]).collect()
    for name, _ in N.ISSUE_TYPES:
        assert not [r.v for r in own if r[name] and not any(n in r.low for n in N.NEEDLES[name].split("|"))]
