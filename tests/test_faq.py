from pageproof.operators import faq as Q

ROW = "sheet_id string, row_no bigint, url_text string, hyperlink string, question string, answer string"
L1, L2 = "https://x.com/one", "https://x.com/two"


def group(spark, *rows):
    """rows: (label, link, question) with an answer for each question; None is a blank row."""
    data = [("s", k + 2, *( ("", None, "", "") if r is None else (r[0], r[1], r[2], r[3] if len(r) > 3 else ("A " + r[2] if r[2] else "")))) for k, r in enumerate(rows)]
    runs = Q.faq_runs(spark.createDataFrame(data, ROW), segment_rows=3)
    resolved = [(r.url, r.label, r.pos, r.question) for r in Q.expected_faqs(runs, 3).orderBy("url", "pos").collect()]
    open_ = [(r.label, r.source_row_number, r.faq_count) for r in Q.unresolved_faqs(runs).orderBy("source_row_number").collect()]
    return resolved, open_


def test_continuation_and_blank_separator(spark):
    resolved, open_ = group(spark, ("One", L1, "q1"), ("", None, "q2"), None, ("Two", L2, "q3"))
    assert resolved == [(L1, "One", 1, "q1"), (L1, "One", 2, "q2"), (L2, "Two", 1, "q3")] and open_ == []


def test_link_in_the_middle_covers_the_rows_above(spark):
    resolved, _ = group(spark, ("", None, "q1"), ("", None, "q2"), ("One", L1, "q3"), ("", None, "q4"))
    assert [r[3] for r in resolved] == ["q1", "q2", "q3", "q4"]


def test_unlinked_section_after_a_linked_one(spark):
    resolved, open_ = group(spark, ("W", L1, "q1"), ("", None, "q2"), ("Home page", None, "q3"), ("Home page", None, "q4"), ("Garden", None, "q5"))
    assert [r[3] for r in resolved] == ["q1", "q2"] and open_ == [("Home page", 4, 2), ("Garden", 6, 1)]


def test_interrupted_label_starts_a_new_run(spark):
    _, open_ = group(spark, ("A", None, "q1"), ("B", None, "q2"), ("A", None, "q3"))
    assert open_ == [("A", 2, 1), ("B", 3, 1), ("A", 4, 1)]


def test_incomplete_rows_and_unlabelled_blocks_drop(spark):
    resolved, open_ = group(spark, ("One", L1, "q1", ""), ("", None, "q2"), None, ("", None, "lost"), None, ("Empty", None, "", ""))
    assert [r[3] for r in resolved] == ["q2"] and open_ == []


def test_two_labels_one_url_merge_under_the_first(spark):
    resolved, _ = group(spark, ("One", L1, "q1"), None, ("Other name", L1, "q2"))
    assert resolved == [(L1, "One", 1, "q1"), (L1, "One", 2, "q2")]


def test_unresolved_warning_counts(spark):
    _, _ = group(spark, ("A", None, "q1"))
    df = spark.createDataFrame([("A", 7, 1), ("B", 9, 3)], "label string, source_row_number int, faq_count bigint")
    got = [r.message for r in Q.unresolved_results(df).orderBy("url").collect()]
    assert got == ["1 FAQ could not be tested.", "3 FAQs could not be tested."]


def faq_page(body):
    return f"<html><body>{body}</body></html>"


def test_structured_page_results(spark):
    page = faq_page("".join(f"<details><summary>{q}</summary>{a}</details>" for q, a in [("What is it?", "It is good. Read more"), ("Why", "No"), ("Extra?", "x")]))
    pages = spark.createDataFrame([(1, L1, page)], "page_id long, url string, html string")
    expected = spark.createDataFrame([(L1, 1, "what is IT", "it is good"), (L1, 2, "Why?", "Because"), (L1, 3, "Gone?", "y")], "url string, pos int, question string, answer string")
    got = {r.check_type: (r.status, r.message) for r in Q.check_faqs(expected, pages).collect()}
    assert got == {
        'FAQ: "what is IT"': ("passed", None),
        'FAQ: "Why?"': ("failed", Q.DIFFERS_MESSAGE),
        'FAQ: "Gone?"': ("failed", Q.MISSING_MESSAGE),
        'FAQ (extra): "Extra?"': ("warning", Q.EXTRA_MESSAGE),
    }


def test_plain_page_falls_back_to_text(spark):
    pages = spark.createDataFrame([(1, L1, faq_page("<p>What is it?</p><p>Good &amp; fine.</p>"))], "page_id long, url string, html string")
    expected = spark.createDataFrame([(L1, 1, "What is it", "good & fine"), (L1, 2, "What", "bad"), (L1, 3, "Never", "x")], "url string, pos int, question string, answer string")
    got = [(r.seq, r.status, r.message) for r in Q.check_faqs(expected, pages).orderBy("seq").collect()]
    assert got == [(1, "passed", None), (2, "failed", Q.TEXT_MESSAGE), (3, "failed", Q.MISSING_MESSAGE)]


def test_repeated_questions_pair_by_occurrence(spark):
    e = spark.createDataFrame([("u", i, "Q", f"e{i}") for i in range(3)], "url string, pos int, question string, answer string")
    a = spark.createDataFrame([("u", i, "q?", f"a{i}") for i in range(2)], "url string, pos int, question string, answer string")
    got = {(r.exp_pos, r.act_pos) for r in Q.match_pairs(e, a, segment_rows=2).collect()}
    assert got == {(0, 0), (1, 1), (2, None)}


def test_a_page_without_snapshot_is_reported(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    expected = spark.createDataFrame([(L1, 1, "Q", "A"), (L1, 2, "R", "B")], "url string, pos int, question string, answer string")
    got = Q.check_faqs(expected, pages).collect()
    assert [(r.url, r.check_type, r.status) for r in got] == [(L1, Q.LOAD_CHECK, "warning")]


def test_many_questions_meet_one_page_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(Q, "QUESTIONS_A_BLOCK", 7)
    asked = [("u", i, f"Question {i}?", f"Answer {i}") for i in range(60)] + [("v", 1, "Else?", "No")]
    expected = spark.createDataFrame(asked, "url string, pos int, question string, answer string")
    text = " ".join(f"question {i}? answer {i if i % 2 else 'x'}" for i in range(50))
    pages = spark.createDataFrame([("u", text), ("w", "unasked")], "url string, page_text string")
    got = {r.seq: (r.status, r.message) for r in Q.page_text_results(expected, pages).collect()}
    assert len(got) == 60 and all(got[i][0] == ("passed" if i % 2 else "failed") for i in range(8, 50))
    assert {got[i][1] for i in range(50, 60)} == {Q.MISSING_MESSAGE}
