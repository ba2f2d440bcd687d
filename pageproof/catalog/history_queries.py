"""Run history, stored runs, exports and report line tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pageproof.catalog import duck as d
from pageproof.catalog import inputs as I
from pageproof.catalog.base import ORACLES, Tables, duck, query
from pageproof.catalog.check_queries import REDIRECT, SCANS, scans
from pageproof.catalog.sheet_queries import issue_case
from pageproof.operators import checks as C
from pageproof.operators import history as P
from pageproof.operators import reports as S
from pageproof.operators import rollups as R
from pageproof.operators import store as T
from pageproof.session import shared_folder
from pageproof.sources.records import read_run_records

RES = f"res as ({duck(I.CHECK_RESULTS)})"
RUNS = f"runs as ({duck(I.RUNS)})"


def redirects(db: Tables):
    log = db.sql(I.HTTP_LOG)
    return C.redirect_results(log).join(log.select(F.col("url").alias("original_url"), F.col("event_id").alias("seq")), "original_url").withColumn(
        "run_id", F.concat(F.lit("r"), (F.col("seq") % 20).cast("string"))
    )


def link_rows(db: Tables):
    log = db.sql(I.HTTP_LOG)
    home = F.concat(F.lit("https://site"), (F.col("event_id") % 97).cast("string"), F.lit(".example/home"))
    out = C.link_results(log.select(home.alias("page_url"), F.col("url").alias("link")), log)
    return out.join(log.select(F.col("url").alias("link"), F.col("event_id").alias("seq")), "link").withColumn(
        "run_id", F.concat(F.lit("r"), (F.col("seq") % 20).cast("string"))
    )


def check_rows(db: Tables):
    return db.sql(I.CHECK_RESULTS).withColumn("run_id", F.concat(F.lit("r"), (F.col("seq") % 20).cast("string")))


def scan_rows(db: Tables):
    return scans(db).withColumn("seq", F.col("event_id")).withColumn(
        "run_id", F.concat(F.lit("r"), (F.col("seq") % 20).cast("string"))
    )


# The four families in SQL, each with run_id and seq.
FAMILIES = f"""{RES}, {REDIRECT},
rk as (select 'r' || (seq % 20) as run_id, seq, url, check_type, status, expected, actual, message from res),
rr as (select 'r' || (event_id % 20) as run_id, event_id as seq, * exclude (event_id) from r),
rl as (select 'r' || (event_id % 20) as run_id, event_id as seq, 'https://site' || (event_id % 97) || '.example/home' as page_url, url as link,
  cast(case when error is null then status else 0 end as int) as status_code, case when error is null and status between 200 and 399 then 'PASS' else 'FAIL' end as status,
  case when error is not null then 'Unable to connect' when status between 200 and 399 then 'Working' else 'Broken Link' end as message from log),
ra as (select 'r' || (event_id % 20) as run_id, event_id as seq, url, n, 'rule-1-' || (event_id % 5) as v1, 'rule-2-' || (event_id % 5) as v2,
  case when event_id % 2 = 0 then 'serious' else 'n/a' end as impact, event_id % 7 as nodes from ({duck(SCANS)}))"""
ENTRIES = f"""{FAMILIES},
entries as (
  select run_id, seq, 'seoCheck:' || url || ':' || check_type as key, 'seoCheck' as category, url,
    check_type || ' — expected "' || coalesce(expected, '') || '", found "' || coalesce(actual, '') || '"' as description from rk where status = 'failed'
  union all select run_id, seq, 'redirect:' || original_url, 'redirect', original_url, result || ' (status ' || status_code || ') — ' || recommendation from rr where result <> 'PASS'
  union all select run_id, seq, 'brokenLink:' || page_url || ':' || link, 'brokenLink', page_url, message || ' (' || link || ', status ' || status_code || ')' from rl where status <> 'PASS'
  union all select run_id, seq, 'accessibility:' || url || ':' || v1, 'accessibility', url, v1 || ' (' || impact || ' impact, ' || nodes || ' node(s))' from ra where n >= 1
  union all select run_id, seq, 'accessibility:' || url || ':' || v2, 'accessibility', url, v2 || ' (' || impact || ' impact, ' || nodes || ' node(s))' from ra where n >= 2)"""


@query(f"with {ENTRIES} select * from entries")
def failing_entries(db: Tables):
    return P.failing_entries(check_rows(db), redirects(db), link_rows(db), scan_rows(db))


@query(f"""with {ENTRIES}, u as (select * from entries qualify row_number() over (partition by run_id, key order by seq desc) = 1),
p as (select * from u where run_id = 'r3'), c as (select * from u where run_id = 'r7')
select coalesce(c.key, p.key) as key, case when c.key is null then 'fixed' when p.key is null then 'new' else 'still' end as change,
  coalesce(c.category, p.category) as category, coalesce(c.url, p.url) as url, coalesce(c.description, p.description) as description
from p full join c on p.key = c.key""")
def run_compare(db: Tables):
    return P.compare_two_runs(P.failing_entries(check_rows(db), redirects(db), link_rows(db), scan_rows(db)), "r3", "r7")


# One run per user group and day; an entry is a user's failing check.
DAILY = f"""{RES}, {RUNS},
ent as (select run_id, seq, 'seoCheck:' || url || ':' || check_type as key, url from res where status = 'failed' qualify row_number() over (partition by run_id, 'seoCheck:' || url || ':' || check_type order by seq desc) = 1),
rs as (select *, row_number() over (partition by source_path order by saved_at desc, run_id desc) as recency, lag(run_id) over (partition by source_path order by saved_at, run_id) as prev from runs)"""


def runs(db: Tables):
    return db.sql(I.RUNS)


def daily_entries(db: Tables):
    return P.failing_entries(checks=db.sql(I.CHECK_RESULTS))


@query(f"""with {DAILY}, n as (select * from rs where recency = 1 and prev is not null),
c as (select n.source_path, e.key, e.url from ent e join n using (run_id)), p as (select n.source_path, e.key, e.url from ent e join n on n.prev = e.run_id)
select coalesce(c.source_path, p.source_path) as source_path, coalesce(c.key, p.key) as key, case when c.key is null then 'fixed' when p.key is null then 'new' else 'still' end as change
from p full join c on c.source_path = p.source_path and c.key = p.key""")
def last_two_runs(db: Tables):
    return P.compare_last_two(runs(db), daily_entries(db)).select("source_path", "key", "change")


@query(f"""with {DAILY}, s as (select * from rs where prev is not null),
c as (select s.source_path, s.run_id, e.key from ent e join s using (run_id)), p as (select s.source_path, s.run_id, e.key from ent e join s on s.prev = e.run_id),
x as (select coalesce(c.source_path, p.source_path) as source_path, coalesce(c.run_id, p.run_id) as run_id, case when c.key is null then 'fixed' when p.key is null then 'new' else 'still' end as change
  from p full join c on c.run_id = p.run_id and c.source_path = p.source_path and c.key = p.key)
select source_path, run_id, count(*) filter (change = 'fixed') as fixed, count(*) filter (change = 'new') as new, count(*) filter (change = 'still') as still from x group by 1, 2""")
def run_changes(db: Tables):
    return P.change_counts(P.run_changes(runs(db), daily_entries(db)), ["source_path", "run_id"])


@query(f"""with {RUNS} select source_path, run_id, saved_at from runs qualify row_number() over (partition by source_path order by saved_at desc, run_id desc) <= 20""")
def snapshot_retention(db: Tables):
    return P.retained_snapshots(runs(db)).select("source_path", "run_id", "saved_at")


STORED = """
select cast(event_id as varchar(20)) as id, event_id as seq, case when event_type = 'view' then 'sheet' else 'blog' end as type, 'file ' || event_id || '.docx' as filename,
  case when event_type = 'click' then null else 'https://site.example/' || event_id end as url, ts as created_at,
  case when event_type = 'error' then 'error' else 'completed' end as status, case when event_type = 'error' then 'failed to load' end as error,
  props as summary, case when event_type <> 'purchase' then props end as expected_content, value
from {events}
"""
STORE_COLUMNS = ["id", "type", "filename", "url", "created_at", "status", "error", "summary", "expected_content"]


def stored_runs(db: Tables):
    return db.sql(STORED)


@query(f"""with s as ({duck(STORED)}), old as (select * from s where seq % 3 <> 0), inc as (
  select id, seq, 'rewritten ' || filename as filename, status from s where seq % 2 = 0 union all select id, seq + 0.5, 'last ' || filename, 'completed' from s where seq % 4 = 0),
new as (select * from inc qualify row_number() over (partition by id order by seq desc) = 1)
select id, filename, status from old where id not in (select id from new) union all select id, filename, status from new""")
def run_upsert(db: Tables):
    s = stored_runs(db)
    columns = ["id", "filename", "status"]
    first = s.where("seq % 2 = 0").select("id", F.concat(F.lit("rewritten "), "filename").alias("filename"), "status", F.col("seq").cast("double").alias("seq"))
    second = s.where("seq % 4 = 0").select("id", F.concat(F.lit("last "), "filename").alias("filename"), F.lit("completed").alias("status"), (F.col("seq") + 0.5).alias("seq"))
    return P.upsert_runs(s.where("seq % 3 <> 0").select(*columns), first.unionByName(second))


@query(f"""with s as ({duck(STORED)}) select id, type, filename, url, status, error, summary, expected_content is not null as has_expected_content from s""")
def history_list(db: Tables):
    return P.list_runs(stored_runs(db)).drop("created_at")


@query(f"""with s as ({duck(STORED)}) select id, filename from s order by created_at desc, id limit 6""")
def latest_runs(db: Tables):
    return P.latest_runs(stored_runs(db)).select("id", "filename")


@query(f"""with s as ({duck(STORED)}) select id, type, filename from s where type = 'blog' and (contains(lower(filename), '77') or contains(lower(coalesce(url, '')), '77'))""")
def history_search(db: Tables):
    return P.search_runs(stored_runs(db), "77", "blog").select("id", "type", "filename")


@query(f"""with s as ({duck(STORED)}) select id, filename, status from s where id = '42'""")
def run_lookup(db: Tables):
    return P.get_run(stored_runs(db), "42").select("id", "filename", "status")


@query(f"""with s as ({duck(STORED)}), t as (select cast(floor(value) as bigint) as passed, cast(seq % 9 as bigint) as failed, created_at, id from s order by created_at desc, id limit 6)
select cast(sum(passed) as bigint) as passed, cast(sum(failed) as bigint) as failed from t""")
def home_totals(db: Tables):
    s = stored_runs(db).select("id", "created_at", F.floor("value").alias("passed"), (F.col("seq") % 9).alias("failed"))
    return R.home_totals(s).drop("last_run")


@query(f"""with {RES} select run_id, seq, url, check_type, status from res where status = 'failed' and (contains(lower(url), 'site3') or contains(lower(check_type), 'site3') or contains(lower(expected), 'site3') or contains(lower(coalesce(actual, '')), 'site3'))""")
def result_search(db: Tables):
    return R.search_results(db.sql(I.CHECK_RESULTS), "SITE3", "failed").select("run_id", "seq", "url", "check_type", "status")


@query(f"""with {RES} select run_id, seq, url, check_type, status from res
order by case status when 'failed' then 0 when 'warning' then 1 when 'skipped' then 2 else 3 end, url, check_type, seq limit 25 offset 50""")
def result_page(db: Tables):
    return R.result_page(db.sql(I.CHECK_RESULTS), 2).select("run_id", "seq", "url", "check_type", "status")


@query(f"""with {RES} select run_id, seq, url, check_type, status from res order by url desc, check_type, seq limit 25 offset 25""")
def result_page_by_url(db: Tables):
    return R.result_page(db.sql(I.CHECK_RESULTS), 1, by="url", descending=True).select("run_id", "seq", "url", "check_type", "status")


BATCH = """
select cast(floor(event_id / 8) as bigint) as batch_id, cast(event_id % 8 as int) as index, 'post ' || event_id || '.docx' as filename,
  case when event_type = 'error' then 'error' when event_type = 'view' then 'pending' else 'done' end as status,
  case when event_type = 'error' then null else cast(event_id as varchar(20)) end as audit_id,
  case when event_type = 'error' and value < 50 then 'page timed out' end as error,
  case when event_type in ('error', 'view') then null else cast(floor(value / 30) as bigint) end as failed
from {events}
"""


@query(f"""with b as ({duck(BATCH)}) select batch_id, count(*) as total, count(*) filter (status = 'done' and failed = 0) as passed, count(*) filter (status = 'done' and failed > 0) as failed,
  count(*) filter (status = 'error') as errored, cast(coalesce(sum(failed), 0) as bigint) as total_mismatches from b group by 1""")
def batch_summary(db: Tables):
    return R.batch_summary(db.sql(BATCH))


NOTES = f"""b as ({duck(BATCH)}), k as (select cast(event_id as varchar) as id from events where event_id % 5 <> 2),
notes as (select b.*, case when status = 'error' or audit_id is null then 'This blog could not be tested: ' || coalesce(error, 'unknown error') || '.' when k.id is null then 'This blog''s audit record could not be found.' end as note
  from b left join k on k.id = b.audit_id)"""


def batch_items(db: Tables):
    known = db.events.where("event_id % 5 <> 2").select(F.col("event_id").cast("string").alias("id"), F.lit("completed").alias("status"))
    return P.batch_item_lookup(db.sql(BATCH), known)


@query(f"with {NOTES} select batch_id, index, filename, note from notes")
def batch_item_lookup(db: Tables):
    return batch_items(db).select("batch_id", "index", "filename", "note")


@query(f"""with {RES}, {RUNS}, c as (select run_id, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'warning') as warning from res group by 1)
select run_id, failed, warning as new_issues, failed = 0 and warning = 0 as gate from c""")
def exit_gate(db: Tables):
    counts = R.check_counts(db.sql(I.CHECK_RESULTS), ["run_id"])
    return R.exit_gate(counts.select("run_id", "failed", F.col("warning").alias("new_issues")))


@query("""with s as (select user_id as sheet_id, case when user_id % 2 = 0 then 'faq' else 'issueBased' end as mode, count(*) as row_count, count(*) filter (event_type = 'view') as faq_count, count(*) filter (event_type = 'click') as unresolved_count from events group by 1)
select sheet_id, case when mode = 'faq' then faq_count + unresolved_count else row_count end as total_rows from s""")
def run_total_rows(db: Tables):
    s = db.events.groupBy(F.col("user_id").alias("sheet_id")).agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("event_type") == "view").alias("faq_count"),
        F.count_if(F.col("event_type") == "click").alias("unresolved_count"),
    )
    s = s.withColumn("mode", F.when(F.col("sheet_id") % 2 == 0, "faq").otherwise("issueBased"))
    return R.run_total_rows(s).select("sheet_id", "total_rows")


# ---- exports and reports ----------------------------------------------------


@query(f"""with {FAMILIES}
select run_id, seq, 1 as family, url, check_type as "fieldChecked", coalesce(expected, '') as "expectedValue", coalesce(actual, '') as "actualValue", upper(status) as status,
  case when status in ('failed', 'warning') then message else '' end as recommendation from rk
union all select run_id, seq, 2, original_url, 'Redirect', '2xx/3xx, no broken redirect chain', status_code || ' (final: ' || final_url || ', ' || redirect_count || ' redirect(s))', result, case when result = 'PASS' then '' else recommendation end from rr
union all select run_id, seq, 3, page_url, 'Link (' || case when starts_with(link, {d.origin('page_url')}) then 'Internal' else 'External' end || '): ' || link, '2xx-3xx', cast(status_code as varchar), status, case when status = 'PASS' then '' else message end from rl
union all select run_id, seq, 4, url, 'Accessibility Scan (axe-core)', '0 violations', n || ' violation(s)', case when n = 0 then 'PASS' else 'FAIL' end, case n when 0 then '' when 1 then v1 else v1 || '; ' || v2 end from ra""")
def export_rows(db: Tables):
    return S.export_rows(check_rows(db), redirects(db), link_rows(db), scan_rows(db))


def md(*cells: str) -> str:
    one = [f"replace(replace(replace(coalesce(cast({c} as varchar), ''), '\\', '\\\\'), '|', '\\|'), chr(10), '<br>')" for c in cells]
    return "'| ' || " + " || ' | ' || ".join(one) + " || ' |'"


def report_runs(db: Tables):
    ids = db.events.select(F.concat(F.lit("r"), (F.col("event_id") % 20).cast("string")).alias("run_id")).distinct()
    return ids.select(
        "run_id",
        F.when(F.length("run_id") == 2, "sheet").otherwise("blog").alias("kind"),
        F.concat(F.lit("sheets/My file - "), "run_id", F.lit(".xlsx")).alias("source_path"),
        F.lit("2024-02-01T10:00:00.000Z").alias("generated_at"),
        F.lit(1234).alias("duration_ms"),
        F.lit(99).alias("total_rows"),
    )


RR = """rruns as (select distinct 'r' || (event_id % 20) as run_id, case when length('r' || (event_id % 20)) = 2 then 'sheet' else 'blog' end as kind from events)"""


@query(f"""with {FAMILIES}, {RR},
rows as (select run_id, 1 as section, seq, {md('url', 'check_type', 'expected', 'actual', 'upper(status)', "case when status = 'failed' then message else '' end", "''")} as line from rk
  union all select run_id, 2, seq, {md('original_url', 'final_url', 'status_code', 'redirect_count', 'recommendation')} from rr where result <> 'PASS'
  union all select run_id, 3, seq, {md('page_url', 'link', f"case when starts_with(link, {d.origin('page_url')}) then 'Internal' else 'External' end", 'status_code', 'message')} from rl where status <> 'PASS')
select run_id, section, seq, line from rows""")
def detail_report_rows(db: Tables):
    """The table rows of the detail document, as the line table holds them."""
    none = db.events.select(F.lit("x").alias("run_id"), F.lit(0).alias("seq"), F.lit("u").alias("url"), F.lit("c").alias("check_type"), F.lit("r").alias("reason")).where("false")
    scores = none.select("run_id", "seq", "url", F.struct(*[F.lit(None).cast("int").alias(c) for c in ("performance", "accessibility", "bestPractices", "seo")]).alias("scores"), F.lit("").alias("error"))
    lines = S.detail_report_lines(report_runs(db), check_rows(db), redirects(db), link_rows(db), scan_rows(db), scores, none)
    rows = lines.where((F.col("section").between(1, 3)) & F.col("line").startswith("| ") & (F.col("seq") > 0))
    return rows.select("run_id", "section", (F.col("seq") - 1).alias("seq"), "line")


@query(f"""with {FAMILIES}, {RR}, n as (select run_id, count(distinct url) as urls, min(url) as one from rk group by 1)
select rk.run_id, cast(case status when 'failed' then 1 else 2 end as int) as section, seq + 1 as seq, cast(k.k as int) as line_no,
  case k.k when 0 then '### ' || check_type || case when n.urls > 1 then ' — ' || url else '' end when 1 then 'Expected: ' || coalesce(expected, '(none)') when 2 then 'Actual: ' || coalesce(actual, '(missing from the live page)') else '' end as line
from rk join n using (run_id), range(0, 4) k(k) where status in ('failed', 'warning')""")
def bug_report_issues(db: Tables):
    lines = S.bug_report_lines(report_runs(db), check_rows(db))
    return lines.where("section in (1, 2) and seq > 0")


@query(f"""with {FAMILIES}, {RR}, n as (select run_id, count(distinct url) as urls, count(*) filter (status = 'failed') as f, count(*) filter (status = 'warning') as w, count(*) filter (status = 'passed') as p from rk group by 1)
select run_id, cast(k.k as int) as line_no, case k.k when 0 then case when kind = 'blog' then '# Blog Content Bug Report' else '# SEO Audit Bug Report' end when 1 then '' when 2 then 'Pages tested: ' || urls
  when 3 then case when kind = 'blog' then 'Approved source document' else 'Audit sheet' end || ': My file - ' || run_id || '.xlsx' when 4 then 'Tested: 2024-02-01T10:00:00.000Z'
  when 5 then 'Result: ' || f || ' Failed, ' || w || ' Warning' || case when w = 1 then '' else 's' end || ', ' || p || ' Passed' else '' end as line
from n join rruns using (run_id), range(0, 7) k(k)""")
def bug_report_head(db: Tables):
    lines = S.bug_report_lines(report_runs(db), check_rows(db))
    return lines.where("section = 0").select("run_id", "line_no", "line")


@query(f"""with {NOTES}, u as (select batch_id, index, filename, note, unnest(['---', '', '## ' || filename, '', coalesce(note, '~'), '']) as line, generate_subscripts([1, 2, 3, 4, 5, 6], 1) as k from notes)
select batch_id, index, line from u where note is not null or k <= 4""")
def batch_report_sections(db: Tables):
    """Item headings and notes of the combined batch documents."""
    empty = db.events.select(F.lit("").alias("run_id"), F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("line_no"), F.lit("").alias("line")).where("false")
    return S.batch_report_lines(batch_items(db), empty).where("section = -1").select("batch_id", "index", "line")


@query(f"""with {RUNS}, n as (select run_id, regexp_replace(left(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(source_path, '^.*/', ''), '[.][^.]*$', ''), '[^a-zA-Z0-9]', ' ', 'g'), ' +', ' ', 'g')), ' ', '-', 'g'), 60), '-+$', '')
  || '-' || left(replace(generated_at, ':', '-'), 19) as prefix from runs)
select run_id, f.f as format, f.lead || prefix || '.' || f.f as file_name from n, (values ('audit-report-', 'json'), ('audit-report-', 'csv'), ('developer-report-', 'md'), ('qa-report-', 'md'), ('developer-report-', 'html'), ('qa-report-', 'html')) f(lead, f)""")
def report_paths(db: Tables):
    return S.report_paths(runs(db))


@query(f"""with {FAMILIES}, {RR}, n as (select run_id, count(*) filter (status = 'passed') as p, count(*) filter (status = 'failed') as f, count(*) filter (status = 'warning') as w, count(*) as t from rk group by 1)
select run_id, '| SEO Checks | ' || p || ' | ' || f || ' | ' || w || ' | ' || t || ' |' as line from n""")
def summary_report_counts(db: Tables):
    counts = R.check_counts(check_rows(db), ["run_id"])
    as_struct = lambda: F.struct("passed", "failed", "warning", "total")
    zero = lambda: F.struct(*[F.lit(0).alias(c) for c in ("passed", "failed", "warning", "total")])
    r = report_runs(db).join(counts.select("run_id", as_struct().alias("checks")), "run_id").withColumns(
        {
            "redirects": zero(), "links": zero(), "accessibility": zero(), "violations": F.lit(0), "skipped": F.lit(0),
            "scores": F.struct(*[F.lit(0).alias(c) for c in ("audited_pages", "errors", "performance", "accessibility", "best_practices", "seo")]),
            "content": F.lit(None).cast("struct<total_checks:bigint,passed:bigint,failed:bigint,missing_content:bigint,modified_content:bigint,metadata_issues:bigint>"),
        }
    )
    lines = S.summary_report_lines(r, R.category_breakdown(check_rows(db), ["run_id"]))
    return lines.where(F.col("line").startswith("| SEO Checks")).select("run_id", "line")


@query(ORACLES["result_page"])
def result_page_after(db: Tables):
    """The page after the fiftieth row, found from that row alone."""
    results = db.sql(I.CHECK_RESULTS)
    last = R.page_after(results, size=50).collect()
    page = R.page_after(results, last[-1].asDict() if last else None)
    return page.select("run_id", "seq", "url", "check_type", "status")


@query(f"""with {RES}, c as (select run_id, seq, status, {issue_case("check_type")} as category from res),
n as (select run_id, category, count(*) filter (status = 'passed') as passed, count(*) filter (status = 'failed') as failed,
  count(*) filter (status not in ('passed', 'failed')) as skipped, count(*) as total, min(seq) as first_seq from c group by 1, 2)
select run_id, category, passed, failed, skipped, total, cast(row_number() over (partition by run_id order by total desc, first_seq, category) as int) as position from n""")
def categories_in_order(db: Tables):
    return R.ordered_categories(db.sql(I.CHECK_RESULTS), ["run_id"])


# Records to import: every other run anew, some of them broken or without an id.
# Braces are written as characters, as the input SQL is a format string.
RECORDS = f"""
select seq, chr(123) || case when seq % 10 = 4 then '"id": "' || id || '", ' when seq % 10 = 6 then '"type":"blog","filename":"' || filename || '"' || chr(125)
  else '"id":"' || id || '","type":"' || type || '","filename":"imported ' || filename || '","createdAt":"2030-01-01","status":"' || status || '"' || chr(125) end as line
from ({STORED}) s where seq % 2 = 0
"""


@query(f"""with s as ({duck(STORED)}), inc as (select * from s where seq % 2 = 0 and seq % 10 not in (4, 6)),
failed as (select case when seq % 10 = 4 then 'not readable' else 'no id' end as reason, line from ({duck(RECORDS)}) r where seq % 10 in (4, 6))
select 'stored' as kind, id, filename, status from s where seq % 3 <> 0 and id not in (select id from inc)
union all select 'stored', id, 'imported ' || filename, status from inc
union all select 'failed', null, line, reason from failed
union all select 'count', 'migrated', cast(count(*) as varchar), null from inc union all select 'count', 'failed', cast(count(*) as varchar), null from failed""")
def history_import(db: Tables):
    """Records read, stored in the buckets that their ids touch, and failures kept."""
    folder = f"{shared_folder(db.spark).rstrip('/')}/{uuid.uuid4()}"
    columns = ["id", "type", "filename", "created_at", "status"]
    stored = db.sql(STORED).withColumn("created_at", F.col("created_at").cast("string"))
    T.create_store(stored.where("seq % 3 <> 0").select(*columns), f"{folder}/runs")
    db.sql(RECORDS).select("line").write.text(f"{folder}/records")
    runs, failures = T.import_records(read_run_records(db.spark, f"{folder}/records", lines=True))
    schema = stored.select(*columns).schema
    T.upsert_store(T.read_store(db.spark, f"{folder}/runs", schema), runs, f"{folder}/runs")
    now = T.read_store(db.spark, f"{folder}/runs", schema)
    text = lambda v: F.lit(v).cast("string")
    count = lambda df, name: df.agg(F.count("*").cast("string").alias("filename")).select(
        F.lit("count").alias("kind"), F.lit(name).alias("id"), "filename", text(None).alias("status")
    )
    return (
        now.select(F.lit("stored").alias("kind"), "id", "filename", "status")
        .unionByName(failures.select(F.lit("failed").alias("kind"), text(None).alias("id"), F.col("record").alias("filename"), F.col("reason").alias("status")))
        .unionByName(count(runs, "migrated"))
        .unionByName(count(failures, "failed"))
    )


@query(f"""with s as ({duck(STORED)}) select id, filename, status from s where id = '42'""")
def stored_run_lookup(db: Tables):
    """A run by its id from a stored table: one bucket is read."""
    folder = f"{shared_folder(db.spark).rstrip('/')}/{uuid.uuid4()}"
    stored = db.sql(STORED).select("id", "filename", "status", F.col("created_at").cast("string").alias("created_at"))
    T.create_store(stored, folder)
    return T.find_run(T.read_store(db.spark, folder, stored.schema), "42").select("id", "filename", "status")
