"""Rule checks over pages and probe logs, and their counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageproof.catalog import duck as d
from pageproof.catalog import inputs as I
from pageproof.catalog.base import Tables, duck, query
from pageproof.catalog.page_queries import TITLED
from pageproof.functions import text as t
from pageproof.operators import checks as C
from pageproof.operators import html as H
from pageproof.operators import rollups as R

NUM = "page_id"
DESCRIPTION = f"case when {NUM} % 4 in (0, 1) then '' else 'About page ' || {NUM} || ' & more' end"
CANONICAL = f"case when {NUM} % 3 = 0 then '' when {NUM} % 3 = 1 then {d.link_href('url', 'url')} else {d.origin('url')} || '/pages/' || {NUM} || '/' end"


def _presence(actual: str, name: str) -> str:
    return f"""
case when {actual} = '' then 'failed' when {d.norm('expected')} <> '' and {d.cmp('expected')} <> lower({actual}) then 'failed' else 'passed' end as status,
{actual} as actual,
case when {actual} = '' then '{name} is missing.' when {d.norm('expected')} <> '' and {d.cmp('expected')} <> lower({actual}) then '{name} does not match the expected value.' else '{name} is valid.' end as message"""


def judged(db: Tables, kind: str):
    # Pages can share a URL: each is judged by its own row.
    facts = C.page_facts(db.sql(I.RICH_PAGES), ("page_id",))
    rows = db.sql(I.EXPECTATIONS).where(F.col("issue_type") == kind)
    one = C.check_registry()[kind]
    return (
        rows.join(facts, ["page_id", "url"])
        .withColumn("r", one)
        .select("page_id", "expected", "r.status", "r.actual", "r.message")
    )


def expectations(kind: str) -> str:
    return f"e as (select * from ({duck(I.EXPECTATIONS)}) where issue_type = '{kind}')"


@query(f"with {expectations('metaDescription')} select page_id, expected, {_presence(DESCRIPTION, 'Meta description')} from e")
def meta_description_check(db: Tables):
    return judged(db, "metaDescription")


@query(f"with {expectations('canonical')} select page_id, expected, {_presence(CANONICAL, 'Canonical URL')} from e")
def canonical_field_check(db: Tables):
    return judged(db, "canonical")


OG = f"""
{expectations('openGraph')},
v as (select *, case when {NUM} % 5 = 0 then '' else 'Title ' || {NUM} end as t, case when {NUM} % 5 < 3 then '' else 'd' end as de,
  case when {NUM} % 5 = 0 then '' else url end as ur, case when {NUM} % 5 < 3 then '' else 'i.png' end as im from e),
m as (select *, list_filter([case when t = '' then 'og:title' end, case when de = '' then 'og:description' end, case when ur = '' then 'og:url' end,
  case when im = '' then 'og:image' end], lambda x: x is not null) as missing,
  list_contains([lower(t), lower(de), lower(ur), lower(im)], {d.cmp('expected')}) as hit, {d.cmp('expected')} <> '' as asked from v)"""


@query(f"""with {OG}
select page_id, expected, case when asked then case when hit then 'passed' else 'failed' end when len(missing) = 0 then 'passed' else 'failed' end as status,
  'og:title=' || t || ' | og:description=' || de || ' | og:url=' || ur || ' | og:image=' || im as actual,
  case when asked and hit then 'Expected Open Graph value is present.' when asked then 'Expected Open Graph value was not found.'
    when len(missing) = 0 then 'Required Open Graph tags are present.' else 'Missing Open Graph tags: ' || array_to_string(missing, ', ') || '.' end as message
from m""")
def open_graph_check(db: Tables):
    return judged(db, "openGraph")


TW = f"""
{expectations('twitterCard')},
v as (select *, case when {NUM} % 2 = 0 then '' else 'summary' end as c, case when {NUM} % 2 = 0 then '' else 'Title ' || {NUM} end as t,
  case when {NUM} % 2 = 0 then '' else 'd' end as de, case when {NUM} % 7 = 1 then 't.png' else '' end as im from e),
m as (select *, list_filter([case when c = '' then 'twitter:card' end, case when t = '' then 'twitter:title' end, case when de = '' then 'twitter:description' end,
  case when im = '' then 'twitter:image' end], lambda x: x is not null) as missing,
  list_contains([lower(c), lower(t), lower(de), lower(im)], {d.cmp('expected')}) as hit, {d.cmp('expected')} <> '' as asked from v)"""


@query(f"""with {TW}
select page_id, expected, case when asked then case when hit then 'passed' else 'failed' end when len(missing) = 0 then 'passed' else 'failed' end as status,
  'twitter:card=' || c || ' | twitter:title=' || t || ' | twitter:description=' || de || ' | twitter:image=' || im as actual,
  case when asked and hit then 'Expected Twitter Card value is present.' when asked then 'Expected Twitter Card value was not found.'
    when len(missing) = 0 then 'Required Twitter Card tags are present.' else 'Missing Twitter Card tags: ' || array_to_string(missing, ', ') || '.' end as message
from m""")
def twitter_check(db: Tables):
    return judged(db, "twitterCard")


@query(f"""with {expectations('imageAlt')},
v as (select *, case when {NUM} % 6 = 0 then 0 when {NUM} % 6 = 2 then 4 else 2 end as images, case when {NUM} % 6 = 2 then 2 else 0 end as lacking,
  {d.cmp('expected')} in ('picture ' || {NUM}, 'chart') as hit, {d.cmp('expected')} <> '' as asked from e)
select page_id, expected,
  case when images = 0 then 'skipped' when asked then case when hit then 'passed' else 'failed' end when lacking = 0 then 'passed' else 'failed' end as status,
  case when images = 0 then '' else 'Picture ' || {NUM} || ' | Chart' end as actual,
  case when images = 0 then 'No images found on the page.' when asked and hit then 'Expected ALT text is present.'
    when asked then 'Expected ALT text was not found on any image.' when lacking = 0 then 'All images have ALT text.'
    else lacking || ' image(s) are missing ALT text.' end as message
from v""")
def image_alt_check(db: Tables):
    return judged(db, "imageAlt")


LOG = f"log as ({duck(I.HTTP_LOG)})"
REDIRECT = f"""
{LOG}, r as (select event_id, url as original_url, case when error is null then final_url else '' end as final_url,
  cast(case when error is null then status else 0 end as int) as status_code,
  cast(case when error is null and final_url <> url then 1 else 0 end as int) as redirect_count,
  cast(case when error is null then response_ms else 0 end as bigint) as response_time,
  case when error is not null then 'FAIL' when status in (200, 301) then 'PASS' when status = 302 then 'WARNING' when status = 404 or status >= 500 then 'FAIL' else 'WARNING' end as result,
  case when error is not null then error when status = 200 then 'Page is accessible.' when status = 301 then 'Permanent redirect working correctly.'
    when status = 302 then 'Temporary redirect found. Verify if a 301 redirect is expected.'
    when status = 404 then 'Page not found. Restore the page or configure a 301 redirect.'
    when status >= 500 then 'Server error detected. Check server configuration.' else 'Unexpected HTTP response.' end as recommendation from log)"""


@query(f"with {REDIRECT} select original_url, final_url, status_code, redirect_count, response_time, result, recommendation from r")
def redirect_class(db: Tables):
    return C.redirect_results(db.sql(I.HTTP_LOG))


def _links(db: Tables):
    log = db.sql(I.HTTP_LOG)
    return log.select(
        F.concat(F.lit("https://site"), (F.col("event_id") % 97).cast("string"), F.lit(".example/home")).alias("page_url"),
        F.when(F.col("event_id") % 11 == 0, F.concat("url", F.lit("/gone"))).otherwise(F.col("url")).alias("link"),
    )


@query(f"""with {LOG},
l as (select 'https://site' || (event_id % 97) || '.example/home' as page_url, case when event_id % 11 = 0 then url || '/gone' else url end as link from log)
select page_url, link, case when starts_with(link, {d.origin('page_url')}) then 'Internal' else 'External' end as link_type,
  cast(case when log.error is null then coalesce(log.status, 0) else 0 end as int) as status_code,
  case when log.error is null and log.status between 200 and 399 then 'PASS' else 'FAIL' end as status,
  case when log.error is null and log.status between 200 and 399 then 'Working' when log.error is not null or log.status is null then 'Unable to connect' else 'Broken Link' end as message
from l left join log on log.url = l.link""")
def broken_links(db: Tables):
    return C.link_results(_links(db), db.sql(I.HTTP_LOG))


@query(f"""with {REDIRECT}
select cast(status_code as int) as status_code, count(*) filter (result = 'PASS') as passed, count(*) filter (result = 'FAIL') as failed,
  count(*) filter (result = 'WARNING') as warning, count(*) as total from r group by status_code""")
def status_counts(db: Tables):
    return R.module_counts(C.redirect_results(db.sql(I.HTTP_LOG)), ["status_code"], "result")


RESULTS = f"res as ({duck(I.CHECK_RESULTS)})"
CATEGORY = (
    "case check_type when 'Meta Title' then 'title' when 'H1' then 'h1' when 'Canonical URL' then 'canonical' "
    "when 'Meta Description' then 'metaDescription' else 'unknown' end"
)


@query(f"""with {RESULTS}
select run_id, count(*) filter (status = 'passed') as passed, count(*) filter (status = 'failed') as failed,
  count(*) filter (status = 'warning') as warning, count(*) as total from res group by run_id""")
def check_counts(db: Tables):
    return R.check_counts(db.sql(I.CHECK_RESULTS), ["run_id"])


@query(f"""with {RESULTS}
select run_id, {CATEGORY} as category, count(*) filter (status = 'passed') as passed, count(*) filter (status = 'failed') as failed,
  count(*) filter (status in ('warning', 'skipped')) as skipped, count(*) as total, min(seq) as first_seq from res group by 1, 2""")
def category_breakdown(db: Tables):
    return R.category_breakdown(db.sql(I.CHECK_RESULTS), ["run_id"])


@query(f"""with {RESULTS}
select run_id, count(*) filter (status <> 'skipped') as total_checks, count(*) filter (status = 'passed') as passed,
  count(*) filter (status = 'failed') as failed, count(*) filter (status = 'failed' and trim(coalesce(actual, '')) = '') as missing_content,
  count(*) filter (status = 'failed' and trim(coalesce(actual, '')) <> '') as modified_content,
  count(*) filter (status = 'failed' and check_type in ('Meta Title', 'Meta Description')) as metadata_issues,
  count(*) filter (status <> 'skipped' and check_type like 'Bold:%') as bold_total,
  count(*) filter (status = 'passed' and check_type like 'Bold:%') as bold_passed,
  count(*) filter (status = 'failed' and check_type like 'Bold:%') as bold_missing, cast(0 as bigint) as bold_modified,
  count(*) filter (status <> 'skipped' and check_type like 'Bold (extra)%') as bold_extra
from res group by run_id""")
def content_summary(db: Tables):
    return R.content_summary(db.sql(I.CHECK_RESULTS), ["run_id"])


SCORED = """
select user_id, event_id, value / 500 as performance, case when event_type = 'view' then null else value / 400 end as accessibility,
  case when event_type = 'error' then 'engine failed' end as error from {events}
"""


@query(f"""with s as ({duck(SCORED)}),
p as (select user_id, error, floor(performance * 100 + 0.5) as perf, floor(accessibility * 100 + 0.5) as acc from s)
select user_id, count(*) as audited_pages, count(error) as errors, cast(floor(avg(perf) filter (error is null) + 0.5) as int) as performance,
  cast(floor(avg(acc) filter (error is null) + 0.5) as int) as accessibility, cast(null as int) as best_practices, cast(null as int) as seo
from p group by user_id""")
def score_averages(db: Tables):
    raw = db.sql(SCORED)
    none = F.lit(None).cast("double")
    scores = F.struct("performance", "accessibility", none.alias("bestPractices"), none.alias("seo"))
    return R.score_averages(R.percent_scores(raw.withColumn("scores", scores)), ["user_id"])


SCANS = """
select user_id, event_id, case when event_type = 'view' then 0 when event_type = 'click' then 1 else 2 end as n,
  'https://site' || (user_id % 10) || '.example/u/' || user_id as url from {events}
"""


def scans(db: Tables):
    one = lambda i: F.struct(
        F.concat(F.lit(f"rule-{i}-"), (F.col("event_id") % 5).cast("string")).alias("id"),
        F.when(F.col("event_id") % 2 == 0, F.lit("serious")).alias("impact"),
        F.lit("described").alias("description"),
        F.lit("https://help.example/rule").alias("helpUrl"),
        (F.col("event_id") % 7).cast("int").alias("nodeCount"),
    )
    return R.accessibility_status(
        db.sql(SCANS).withColumn("violations", F.slice(F.array(one(1), one(2)), F.lit(1), F.col("n")))
    )


@query(f"""with s as ({duck(SCANS)})
select user_id, count(*) filter (n = 0) as passed, count(*) filter (n > 0) as failed, cast(0 as bigint) as warning, count(*) as total,
  cast(sum(n) as bigint) as violations from s group by user_id""")
def accessibility_counts(db: Tables):
    return R.accessibility_counts(scans(db), ["user_id"])


@query(f"""with {RESULTS}, f as (select run_id, passed, failed, warning, total from (select run_id, count(*) filter (status = 'passed') as passed,
  count(*) filter (status = 'failed') as failed, count(*) filter (status = 'warning') as warning, count(*) as total from res group by run_id))
select run_id, passed, failed, warning, total, cast(floor(passed * 100.0 / total + 0.5) as int) as passed_pct,
  cast(floor(failed * 100.0 / total + 0.5) as int) as failed_pct, cast(floor(warning * 100.0 / total + 0.5) as int) as warning_pct from f""")
def dashboard_totals(db: Tables):
    return R.dashboard_totals(R.check_counts(db.sql(I.CHECK_RESULTS), ["run_id"]), ["run_id"])


@query(f"""with {RESULTS}
select run_id, count(*) as "all", count(*) filter (status = 'failed') as failed, count(*) filter (status = 'warning') as warning,
  count(*) filter (status = 'passed') as passed, count(*) filter (status = 'skipped') as skipped from res group by run_id""")
def status_facets(db: Tables):
    return R.status_facets(db.sql(I.CHECK_RESULTS), ["run_id"])


@query(f"""with {RESULTS}, c as (select regexp_extract(url, '://([^/]+)', 1) as host, {CATEGORY} as category, status from res)
select host, category, cast(grouping_id(host, category) as int) as level, count(*) filter (status = 'passed') as passed,
  count(*) filter (status = 'failed') as failed, count(*) filter (status = 'warning') as warning, count(*) as total
from c group by rollup (host, category)""")
def site_rollup(db: Tables):
    return R.site_rollup(db.sql(I.CHECK_RESULTS))


@query(f"""with {TITLED}
select lower(title) as value, count(*) as pages, min(url) as first_url from titled where title <> '' group by 1 having count(*) > 1""")
def duplicate_titles(db: Tables):
    return R.duplicate_values(H.with_head(db.pages).select("url", "title"), "title")


@query(f"""
with a as (select event_id, user_id, event_type, value from events),
families as (select user_id, 'checks' as family, cast(count(*) filter (event_type = 'view') as bigint) as passed, cast(count(*) filter (event_type = 'error') as bigint) as failed, cast(count(*) filter (event_type = 'click') as bigint) as warning from a group by 1
  union all select user_id, 'redirects', count(*) filter (value < 40), count(*) filter (value >= 100), count(*) filter (value >= 40 and value < 100) from a group by 1),
t as (select user_id, cast(sum(passed) as bigint) as total_passed, cast(sum(failed) as bigint) as total_failed, cast(sum(warning) as bigint) as total_warning from families group by 1),
p as (select user_id, cast(floor(avg(floor(value / 500 * 100 + 0.5)) + 0.5) as int) as avg_performance from a group by 1)
select user_id, total_passed, total_failed, total_warning, avg_performance, case when avg_performance >= 90 then 'success' when avg_performance >= 50 then 'warning' else 'danger' end as tone
from t join p using (user_id)""")
def sheet_cards(db: Tables):
    e = db.events
    n = lambda c: F.count_if(c)
    checks = e.groupBy("user_id").agg(
        F.lit("checks").alias("family"),
        n(F.col("event_type") == "view").alias("passed"),
        n(F.col("event_type") == "error").alias("failed"),
        n(F.col("event_type") == "click").alias("warning"),
    )
    value = F.col("value")
    redirects = e.groupBy("user_id").agg(
        F.lit("redirects").alias("family"),
        n(value < 40).alias("passed"),
        n(value >= 100).alias("failed"),
        n((value >= 40) & (value < 100)).alias("warning"),
    )
    scans_ = e.groupBy("user_id").agg(
        F.lit("accessibility").alias("family"), n(value > 0).alias("passed"), n(value < 0).alias("failed"), F.lit(0).alias("warning")
    )
    scored = e.select("user_id", F.struct(t.score_pct(value / 500).alias("performance")).alias("scores"))
    return R.sheet_cards(checks.unionByName(redirects).unionByName(scans_), scored, ["user_id"])


@query(f"""with n as (select conv_id as batch_id, turn as idx, case when turn % 2 = 0 then 'https://Site.example/p/' || (turn % 4) || '/' else 'https://site.example/p/' || (turn % 4) || '?utm_source=x' end as url from conversations),
k as (select *, {d.normalize_url('url', 'url')} as page from n),
r as (select *, row_number() over (partition by batch_id, page order by idx) as rn from k)
select distinct batch_id, url from r where rn > 1""")
def batch_duplicates(db: Tables):
    items = db.sql(
        "select conv_id as batch_id, turn as idx, case when turn % 2 = 0 then 'https://Site.example/p/' || (turn % 4) || '/' "
        "else 'https://site.example/p/' || (turn % 4) || '?utm_source=x' end as url from {conversations}"
    )
    return C.duplicate_batch_urls(items)


BATCH_ITEMS = """
select conv_id as batch_id, turn as idx, case when conv_id % 9 = 1 and turn = 1 then 'notes.txt' else 'post-' || turn || '.docx' end as filename,
  case when conv_id % 7 = 2 and turn = 0 then ' ' when conv_id % 5 = 3 then 'https://site.example/same' else 'https://site.example/p/' || turn end as url
from {conversations}
"""


@query(f"""with i as ({duck(BATCH_ITEMS)}),
b as (select batch_id, count(*) as n_files, count(*) - case when batch_id % 11 = 4 then 1 else 0 end as n_urls,
  count(*) filter (not ends_with(filename, '.docx')) as bad, count(*) filter (trim(url) = '') as blank, count(*) - count(distinct trim(url)) as dup from i group by batch_id),
r as (select batch_id, case when bad > 0 then 'wrong extension' when n_urls <> n_files then 'count mismatch' when blank > 0 then 'blank url'
  when dup > 0 then 'duplicate url' when n_files > 6 then 'batch too large' end as reason from b)
select batch_id, reason from r where reason is not null""")
def batch_rejects(db: Tables):
    items = db.sql(BATCH_ITEMS)
    batches = items.groupBy("batch_id").agg(
        F.count("*").alias("n_files"),
        (F.count("*") - F.when(F.col("batch_id") % 11 == 4, 1).otherwise(0)).alias("n_urls"),
    )
    return C.batch_rejects(batches, items, max_size=6)


@query("""with f as (select conv_id as form_id, turn, case when turn % 2 = 0 then ' HTTPS://Site.example/A//' else 'https://site.example/a' end as url from conversations)
select form_id, 'https://site.example/a' as key, count(*) as n from f group by 1 having count(*) > 1""")
def upload_duplicates(db: Tables):
    forms = db.sql(
        "select conv_id as form_id, case when turn % 2 = 0 then ' HTTPS://Site.example/A//' else 'https://site.example/a' end as url from {conversations}"
    )
    return C.repeated_upload_urls(forms)


@query("""with r as (select cast(event_id as varchar) as id, case when event_type = 'view' then 'sheet' else 'blog' end as type, 'file ' || event_id as filename,
  case when event_type = 'click' then '' else 'https://site.example/' || event_id end as url, case when event_type <> 'error' then '{}' end as content from events where true),
i as (select cast(event_id as varchar) as id from events union all select 'x' || event_id from events)
select i.id, case when r.id is null then 'Audit ' || i.id || ' was not found.' when type <> 'blog' then '"' || filename || '" is not a blog audit.'
  when url = '' then '"' || filename || '" has no live URL on record.'
  when content is null then '"' || filename || '" was tested before re-running was supported — upload it once more to enable this.' end as reason
from i left join r using (id)""")
def rerun_eligibility(db: Tables):
    runs = db.events.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("event_type") == "view", "sheet").otherwise("blog").alias("type"),
        F.concat(F.lit("file "), F.col("event_id").cast("string")).alias("filename"),
        F.when(F.col("event_type") == "click", "")
        .otherwise(F.concat(F.lit("https://site.example/"), F.col("event_id").cast("string")))
        .alias("url"),
        F.when(F.col("event_type") != "error", "{}").alias("expected_content"),
    )
    ids = db.events.select(F.col("event_id").cast("string").alias("id"))
    strange = db.events.select(F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("id"))
    return C.rerun_eligibility(ids.unionByName(strange), runs)

