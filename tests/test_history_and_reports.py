from pyspark.sql import functions as F

from pageproof.operators import checks as C
from pageproof.operators import history as P
from pageproof.operators import reports as S
from pageproof.operators import rollups as R

CHECK = "run_id string, seq bigint, url string, check_type string, status string, expected string, actual string, message string"


def checks(spark, run="r1", extra=()):
    rows = [(run, 0, "https://x.com/", "Missing title", "failed", "New", "Old", "Meta title does not match."), (run, 1, "https://x.com/", "H1", "passed", "A", "A", "H1 is valid.")]
    return spark.createDataFrame([*rows, *extra], CHECK)


def redirects(spark, run="r1"):
    log = spark.createDataFrame([("https://x.com/old", "https://x.com/404", 404, 9, None), ("https://x.com/a", "https://x.com/b", 200, 5, None), ("https://x.com/e", None, None, None, "refused")], "url string, final_url string, status int, response_ms bigint, error string")
    return C.redirect_results(log).withColumn("run_id", F.lit(run)).withColumn("seq", F.monotonically_increasing_id())


def links(spark, run="r1"):
    log = spark.createDataFrame([("https://x.com/ok", 200, None), ("https://y.com/bad", 500, None)], "url string, status int, error string")
    found = spark.createDataFrame([("https://x.com/", "https://x.com/ok"), ("https://x.com/", "https://y.com/bad"), ("https://x.com/", "https://z.com/none")], "page_url string, link string")
    return C.link_results(found, log).withColumn("run_id", F.lit(run)).withColumn("seq", F.lit(0).cast("bigint"))


def scans(spark, run="r1"):
    v = "array<struct<id:string,impact:string,description:string,helpUrl:string,nodeCount:int>>"
    return spark.createDataFrame([(run, 0, "https://x.com/", "FAIL", [("color-contrast", "serious", "d", "h", 3), ("image-alt", None, "d", "h", 1)])], f"run_id string, seq bigint, url string, status string, violations {v}")


def test_redirect_and_link_classes(spark):
    got = {r.original_url[-4:]: (r.result, r.status_code, r.redirect_count) for r in redirects(spark).collect()}
    assert got == {"/old": ("FAIL", 404, 1), "om/a": ("PASS", 200, 1), "om/e": ("FAIL", 0, 0)}
    assert {(r.link_type, r.message, r.status_code) for r in links(spark).collect()} == {("Internal", "Working", 200), ("External", "Broken Link", 500), ("External", "Unable to connect", 0)}


def test_entries_and_comparison(spark):
    first = P.failing_entries(checks(spark), redirects(spark), links(spark), scans(spark))
    assert {r.key for r in first.collect()} == {
        "seoCheck:https://x.com/:Missing title", "redirect:https://x.com/old", "redirect:https://x.com/e", "brokenLink:https://x.com/:https://y.com/bad",
        "brokenLink:https://x.com/:https://z.com/none", "accessibility:https://x.com/:color-contrast", "accessibility:https://x.com/:image-alt",
    }
    later = checks(spark, "r2", [("r2", 5, "https://x.com/", "H2", "failed", "B", None, "m"), ("r2", 6, "https://x.com/", "H2", "failed", "C", None, "m")]).where("check_type <> 'Missing title'")
    second = P.failing_entries(later, redirects(spark, "r2"), links(spark, "r2"), scans(spark, "r2"))
    changes = P.compare_two_runs(first.unionByName(second), "r1", "r2")
    counts = P.change_counts(changes).first()
    assert (counts.fixed, counts.new, counts.still) == (1, 1, 6)
    new = changes.where("change = 'new'").first()
    assert new.description == 'H2 — expected "C", found ""'


def test_last_two_runs_per_source(spark):
    runs = spark.createDataFrame([("s", "a", "2024-01-01"), ("s", "b", "2024-03-02"), ("s", "c", "2024-03-03"), ("t", "d", "2024-01-01")], "source_path string, run_id string, saved_at string")
    entries = spark.createDataFrame([("a", 0, "k1"), ("b", 0, "k2"), ("c", 0, "k2"), ("c", 1, "k3"), ("d", 0, "k4")], "run_id string, seq bigint, key string").select("*", *[F.lit("x").alias(c) for c in ("category", "url", "description")])
    assert {(r.source_path, r.key, r.change) for r in P.compare_last_two(runs, entries).collect()} == {("s", "k2", "still"), ("s", "k3", "new")}
    assert {(r.run_id, r.key, r.change) for r in P.run_changes(runs, entries).collect()} == {("b", "k1", "fixed"), ("b", "k2", "new"), ("c", "k2", "still"), ("c", "k3", "new")}
    assert {r.run_id for r in P.retained_snapshots(runs, 2).collect()} == {"b", "c", "d"}


def test_upsert_keeps_the_last_version(spark):
    store = spark.createDataFrame([("1", "old"), ("2", "kept")], "id string, v string")
    new = spark.createDataFrame([("1", "n1", 1), ("1", "n2", 2), ("3", "add", 1)], "id string, v string, seq int")
    assert {tuple(r) for r in P.upsert_runs(store, new).collect()} == {("1", "n2"), ("2", "kept"), ("3", "add")}


def test_summaries(spark):
    scores = spark.createDataFrame([({"performance": 0.825, "accessibility": 0.91, "bestPractices": None, "seo": 1.0}, None), ({"performance": 0.1, "accessibility": None, "bestPractices": None, "seo": None}, "boom")], "scores struct<performance:double,accessibility:double,bestPractices:double,seo:double>, error string")
    assert tuple(R.score_averages(R.percent_scores(scores)).first()) == (2, 1, 83, 91, None, 100)
    c = R.check_counts(checks(spark)).first()
    assert (c.passed, c.failed, c.warning, c.total) == (1, 1, 0, 2)
    assert {(r.category, r.total) for r in R.category_breakdown(checks(spark)).collect()} == {("title", 1), ("h1", 1)}
    assert R.percentage(F.lit(1), F.lit(0)) is not None


RUN = "run_id string, kind string, source_path string, generated_at string, duration_ms int, total_rows int"


def text_of(lines):
    rows = S.document_lines(lines).orderBy("run_id", "section", "seq", "line_no").collect()
    return {run: "\n".join(r.line for r in rows if r.run_id == run) for run in {r.run_id for r in rows}}


def test_bug_report_document(spark):
    runs = spark.createDataFrame([("r1", "sheet", "sheets/My.xlsx", "2024-01-01T00:00:00.000Z", 5, 2), ("r9", "blog", "b/p.docx", "2024-01-01T00:00:00.000Z", 5, 2)], RUN)
    extra = [("r1", 2, "https://x.com/", "Alt", "warning", None, None, "w"), ("r1", 3, "https://x.com/", "H2", "passed", "B", "B", "ok"), ("r9", 0, "https://y.com/", "H1", "passed", "A", "A", "ok")]
    docs = text_of(S.bug_report_lines(runs, checks(spark, extra=extra)))
    assert docs["r1"] == (
        "# SEO Audit Bug Report\n\nLive URL: https://x.com/\nAudit sheet: My.xlsx\nTested: 2024-01-01T00:00:00.000Z\n"
        "Result: 1 Failed, 1 Warning, 2 Passed\n\n## Must Fix\n\n### Missing title\nExpected: New\nActual: Old\n\n"
        "## Warnings\n\n### Alt\nExpected: (none)\nActual: (missing from the live page)\n\n"
        "## Passed\n\n2 check(s) already match the approved document:\nH1,\nH2"
    )
    assert docs["r9"].endswith("No issues found. Every check in this run passed — nothing for a developer to fix.\n")


def test_detail_report_document(spark):
    runs = spark.createDataFrame([("r1", "sheet", "sheets/My.xlsx", "2024-01-01T00:00:00.000Z", 5, 2)], RUN)
    none = spark.createDataFrame([], "run_id string, seq bigint, url string, check_type string, reason string, error string, scores struct<performance:int,accessibility:int,bestPractices:int,seo:int>")
    doc = text_of(S.detail_report_lines(runs, checks(spark), redirects(spark), links(spark), scans(spark), none, none))["r1"]
    assert doc.startswith("# SEO QA Audit Report (Developer)\n\n- Source sheet: `sheets/My.xlsx`\n")
    assert "| https://x.com/ | Missing title | New | Old | FAILED | Meta title does not match. |  |\n" in doc
    assert "## Skipped Rows\n\nNo rows were skipped.\n" in doc and "| image-alt | n/a | 1 | [docs](h) |" in doc
    assert "Working" not in doc and doc.index("## Redirect Issues") < doc.index("## Broken Links")


def test_export_and_files(spark, tmp_path):
    rows = S.export_rows(checks(spark), redirects(spark), links(spark), scans(spark))
    assert rows.count() == 2 + 3 + 3 + 1
    S.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == S.EXPORT
    runs = spark.createDataFrame([("r1", "sheet", "sheets/My.xlsx", "2024-01-01T00:00:00.000Z", 5, 2)], RUN)
    lines = S.bug_report_lines(runs, checks(spark))
    S.write_lines(lines, str(tmp_path / "txt"))
    written = [line for f in sorted((tmp_path / "txt" / "run_id=r1").glob("*.txt")) for line in f.read_text().splitlines()]
    assert written == [r.line for r in lines.orderBy("section", "seq", "line_no").collect()]
    assert {r.file_name for r in S.report_paths(runs).collect()} >= {"audit-report-My-2024-01-01T00-00-00.json", "qa-report-My-2024-01-01T00-00-00.html"}


def test_json_record_import(spark, tmp_path):
    from pageproof.sources.records import import_counts, read_run_records

    (tmp_path / "a.json").write_text('{"id": "1", "type": "blog", "filename": "f"}')
    (tmp_path / "b.json").write_text("{broken")
    got = import_counts(read_run_records(spark, str(tmp_path))).first()
    assert (got.migrated, got.failed, got.total) == (1, 1, 2)


def test_rerun_and_batches(spark):
    runs = spark.createDataFrame([("1", "blog", "a", "u", "{}"), ("2", "sheet", "b", "u", "{}"), ("3", "blog", "c", "", "{}"), ("4", "blog", "d", "u", None)], "id string, type string, filename string, url string, expected_content string")
    ids = spark.createDataFrame([(str(i),) for i in range(1, 6)], "id string")
    got = {r.id: r.reason for r in C.rerun_eligibility(ids, runs).collect()}
    assert got["1"] is None and got["2"] == '"b" is not a blog audit.' and got["5"] == "Audit 5 was not found." and "no live URL" in got["3"] and "upload it once more" in got["4"]
    items = spark.createDataFrame([(1, 0, "a.docx", "https://x.com/p/"), (1, 1, "b.docx", "https://x.com/p?utm_source=q"), (1, 2, "c.docx", "https://x.com/q")], "batch_id int, idx int, filename string, url string")
    assert [tuple(r) for r in C.duplicate_batch_urls(items).collect()] == [(1, "https://x.com/p?utm_source=q")]


def test_documents_of_any_length_and_ties(spark):
    from pyspark.sql import functions as F

    n = 100_001
    lines = spark.range(n).select(F.lit("r").alias("run_id"), F.lit(1).alias("section"), F.col("id").alias("seq"), F.lit(0).alias("line_no"), F.lit("x").alias("line"))
    assert S.document_lines(lines).count() == n


def test_categories_far_down_keep_their_order(spark):
    rows = [("r1", "b", 1, 0, 0, 1, 2**21 + 1), ("r1", "a", 1, 0, 0, 1, 2**21), ("r1", "c", 2, 0, 0, 2, 2**22)]
    cats = spark.createDataFrame(rows, "run_id string, category string, passed long, failed long, skipped long, total long, first_seq long")
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("total"), "first_seq", "category"))
    assert [r.category for r in cats.withColumn("seq", place).orderBy("seq").collect()] == ["c", "a", "b"]
