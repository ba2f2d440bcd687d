"""Inputs derived from the given tables in SQL both engines accept.

The tables hold no audit sheets, FAQ sheets, head tags or probe logs, so these
are built from their rows; every input grows with its table. Remainders of ids
only decide how a row looks or on which of two compared sides it appears, so
that matches, changes, gaps and extras all occur; whole tables are read.
"""

from __future__ import annotations

# Pages with head tags and images on most, varying by page.
RICH_PAGES = """
select page_id, url, replace(html, '</head>',
  case when page_id % 4 = 0 then '' when page_id % 4 = 1 then '<meta name="description" content="">'
    else '<meta name="description" content="About  page ' || page_id || ' &amp; more">' end ||
  case when page_id % 3 = 0 then '' when page_id % 3 = 1 then '<link rel="canonical" href="' || url || '">'
    else '<link href="/pages/' || page_id || '/" rel="canonical">' end ||
  case when page_id % 5 = 0 then '' else '<meta property="og:title" content="Old"><meta property="og:title" content="Title ' || page_id
    || '"><meta property="og:url" content="' || url || '">' end ||
  case when page_id % 5 < 3 then '' else '<meta property="og:description" content="d"><meta property="og:image" content="i.png">' end ||
  case when page_id % 2 = 0 then '' else '<meta name="twitter:card" content="summary"><meta name="twitter:title" content="Title ' || page_id
    || '"><meta name="twitter:description" content="d">' end ||
  case when page_id % 7 = 1 then '<meta name="twitter:image" content="t.png">' else '' end || '</head>'
  ) || case when page_id % 6 = 0 then '' else '<img src="a.png" alt="Picture ' || page_id || '"><img src="b.png" alt="Chart">' end
    || case when page_id % 6 = 2 then '<img src="c.png"><img alt="">' else '' end as html
from {pages}
"""

# One expected value per page and check; some blank, some in another case.
EXPECTATIONS = """
select page_id, url, 'metaDescription' as issue_type, case when page_id % 5 = 0 then null when page_id % 5 = 1 then 'Something else'
  else 'about PAGE ' || page_id || ' & more' end as expected from {pages}
union all select page_id, url, 'canonical', case when page_id % 2 = 0 then url else null end from {pages}
union all select page_id, url, 'openGraph', case when page_id % 3 = 0 then 'title ' || page_id when page_id % 3 = 1 then 'absent value' else '' end from {pages}
union all select page_id, url, 'twitterCard', case when page_id % 3 = 1 then 'Title ' || page_id else null end from {pages}
union all select page_id, url, 'imageAlt', case when page_id % 4 = 1 then 'picture ' || page_id when page_id % 4 = 2 then 'no such' else null end from {pages}
"""

# Probe log: one row per event's address, status by type and value.
HTTP_LOG = """
select event_id, 'https://site' || user_id || '.example/p/' || event_id as url,
  case when event_type = 'signup' then 'https://site' || user_id || '.example/login' else 'https://site' || user_id || '.example/p/' || event_id end as final_url,
  cast(case when event_type = 'view' then 200 when event_type = 'click' then 301 when event_type = 'signup' then 302
    when event_type = 'purchase' then 404 when value < 20 then 500 + cast(floor(value / 5) as int) when value < 60 then 418 else 200 end as int) as status,
  cast(floor(value * 10) as bigint) as response_ms,
  case when event_type = 'error' and value >= 60 then 'connect timeout after ' || cast(floor(value) as bigint) || ' ms' end as error
from {events}
"""

# Audit sheets: ten pages per sheet, three layouts, blank rows in between.
_SHEET = "cast(floor(page_id / 10) as bigint)"
_ROW = "cast(4 + 2 * (page_id - 10 * floor(page_id / 10)) as bigint)"
_LAYOUT = "(cast(floor(page_id / 10) as bigint) % 3)"


def _cells(columns: list[tuple[int, str, str]]) -> str:
    """(layout, header, value) triples to cells in one scan of the pages: each
    page meets its layout's columns (a fixed list) as a data and a blank row,
    and the first page of a sheet as the header row as well."""
    placed, seen = [], {}
    for layout, header, value in columns:
        col = seen.get(layout, 0)
        seen[layout] = col + 1
        placed.append((layout, col, header, value))
    names = ", ".join(f"({layout}, {col}, '{header}')" for layout, col, header, _ in placed)
    value = " ".join(f"when layout = {layout} and col_no = {col} then {v}" for layout, col, _, v in placed)
    return f"""
select {_SHEET} as sheet_id, case k.kind when 'data' then {_ROW} when 'blank' then {_ROW} + 1 else cast(3 as bigint) end as row_no, col_no,
  case k.kind when 'data' then case {value} end when 'blank' then '  ' else header end as value
from {{pages}} join (values {names}) c(layout, col_no, header) on {_LAYOUT} = layout
  join (values ('data'), ('blank'), ('header')) k(kind) on k.kind <> 'header' or page_id % 10 = 0
union all select {_SHEET}, cast(1 as bigint), 0, 'Quarterly review' from {{pages}} where page_id % 10 = 0
"""


ISSUE_COLUMNS = [
    (0, "Page URL", "case when page_id % 7 = 3 then '' else ' ' || url end"),
    (
        0,
        "Problem",
        "case page_id % 6 when 0 then 'Missing title' when 1 then 'Meta description too short' when 2 then 'Broken links' "
        "when 3 then 'Slow page speed' when 4 then 'hreflang' else 'Heading 1 absent' end",
    ),
    (0, "Recommended Value", "case when page_id % 3 = 0 then 'New value ' || page_id else '' end"),
    (0, "Current Value", "case when page_id % 2 = 0 then 'Old' else '' end"),
    (0, "Priority", "case page_id % 4 when 0 then 'HIGH' when 1 then 'medium ' when 2 then 'urgent' else '' end"),
    (0, "Details", "case when page_id % 5 = 0 then 'see the canonical tag' else '' end"),
    (1, "Current URL", "url"),
    (1, "Suggested Meta Title", "case when page_id % 2 = 0 then 'Title for ' || page_id else '' end"),
    (1, "Title Chars", "'60'"),
    (1, "Suggested Meta Description", "'Description for ' || page_id"),
    (1, "Redirect To", "case when page_id % 5 = 0 then 'https://new.example/' || page_id else '' end"),
    (1, "Recommendation", "'do it'"),
    (2, "Notes", "'row ' || page_id"),
    (2, "Where", "case when page_id % 4 = 0 then 'n/a' else url end"),
    (2, "Severity", "'Critical'"),
    (2, "", "'x'"),
]
SHEET_CELLS = _cells(ISSUE_COLUMNS)

# FAQ sheets of the same pages, two pairs each with a blank row after; some
# labels without a link. The pages answer them in markup, in text or not at all.
FAQ_SHEET_ROWS = f"""
select page_id, url, 1000000 + {_SHEET} as sheet_id, 2 + 3 * (page_id - 10 * cast(floor(page_id / 10) as bigint)) + k as row_no, k,
  case when k = 0 then 'Page ' || page_id else '' end as label, case when k = 0 and page_id % 8 <> 7 then url end as link,
  case k when 0 then 'What is page ' || page_id || '?' when 1 then 'Who wrote page ' || page_id || '?' else '' end as question,
  case k when 0 then 'Page ' || page_id || ' is about numbers' when 1 then 'Somebody wrote all of it' else '' end as answer
from {{pages}} join (values (0), (1), (2)) n(k) on true
"""
FAQ_SHEET_CELLS = f"""
select sheet_id, row_no, col_no, case col_no when 0 then label when 1 then question else answer end as value, case when col_no = 0 then link end as hyperlink
from ({FAQ_SHEET_ROWS}) r join (values (0), (1), (2)) c(col_no) on true
union all select 1000000 + {_SHEET}, cast(1 as bigint), col_no, case col_no when 0 then 'URL' when 1 then 'FAQs' else 'Answer' end, cast(null as varchar(10))
from {{pages}} join (values (0), (1), (2)) c(col_no) on true where page_id % 10 = 0
"""
_PAIR = "'<details><summary>What is page ' || page_id || '?</summary><p>Page ' || page_id || ' is about numbers</p></details>'"
FAQ_SHEET_PAGES = f"""
select page_id, url, replace(html, '</body>', '') || case page_id % 3 when 2 then '<p>What is page ' || page_id || '? Page ' || page_id || ' is about numbers</p>'
  when 1 then {_PAIR} else {_PAIR} || '<details><summary>Who wrote page ' || page_id || '?</summary><p>Nobody wrote it</p></details>' ||
  case when page_id % 6 = 3 then '<details><summary>Extra question?</summary><p>Yes</p></details>' else '' end end || '</body>' as html
from {{pages}}
"""

# FAQ sheets from conversations: twenty per sheet; a question is a user turn,
# its answer the turn after, some rows blank, some labels linked.
FAQ_ROWS = """
select cast(floor(u.conv_id / 20) as bigint) as sheet_id, (u.conv_id % 20) * 100 + u.turn + 2 as row_no,
  case when u.turn = 0 and u.conv_id % 3 <> 2 then 'Page ' || cast(floor(u.conv_id / 2) as bigint) else '' end as url_text,
  case when u.turn = 0 and u.conv_id % 3 = 0 then 'https://faq.example/' || cast(floor(u.conv_id / 6) as bigint) end as hyperlink,
  u.text as question, coalesce(a.text, '') as answer
from {conversations} u left join {conversations} a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
where u.role = 'user'
union all
select distinct cast(floor(conv_id / 20) as bigint), (conv_id % 20) * 100 + 99, '', cast(null as varchar(10)), '', ''
from {conversations} where conv_id % 4 = 1
"""

# Published pairs: every page of the FAQ sheets answers most of its questions.
EXPECTED_FAQS = """
select 'https://faq.example/' || cast(floor(u.conv_id / 6) as bigint) as url, u.conv_id * 100 + u.turn as pos, u.text as question, a.text as answer
from {conversations} u join {conversations} a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
where u.role = 'user' and u.conv_id % 5 <> 4
"""
PUBLISHED_FAQS = """
select 'https://faq.example/' || cast(floor(u.conv_id / 6) as bigint) as url, u.conv_id * 100 + u.turn as pos, translate(u.text, 'aeiot', 'AEIOT') || '?' as question,
  case when u.turn = 2 then 'Changed. ' || a.text || ' Read more' when u.turn = 4 then 'An entirely different answer' else a.text end as answer
from {conversations} u join {conversations} a on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
where u.role = 'user' and u.conv_id % 7 <> 3
"""

# Check results of runs: one run per day and source, from events.
CHECK_RESULTS = """
select 'run-' || cast(user_id % 10 as bigint) || '-' || substring(cast(ts as varchar(40)), 1, 10) as run_id,
  event_id as seq, 'https://site' || (user_id % 10) || '.example/u/' || user_id as url,
  case event_type when 'view' then 'Meta Title' when 'click' then 'H1' when 'signup' then 'Bold: "x"' when 'purchase' then 'Canonical URL' else 'Meta Description' end as check_type,
  case event_type when 'view' then 'passed' when 'click' then 'warning' when 'signup' then 'skipped'
    when 'purchase' then case when value < 30 then 'passed' else 'failed' end else 'failed' end as status,
  'want ' || user_id as expected, case when value < 15 then null when value < 25 then ' ' else 'got ' || cast(floor(value) as bigint) end as actual,
  'Value ' || cast(floor(value) as bigint) || ' of ' || event_type as message
from {events}
"""
RUNS = """
select 'run-' || cast(user_id % 10 as bigint) || '-' || substring(cast(ts as varchar(40)), 1, 10) as run_id,
  case when user_id % 2 = 0 then 'sheets/site ' || (user_id % 10) || ' - fixes.xlsx' else 'briefs/post_' || (user_id % 10) || '.docx' end as source_path,
  case when user_id % 2 = 0 then 'sheet' else 'blog' end as kind,
  substring(cast(ts as varchar(40)), 1, 10) as saved_at,
  min(substring(cast(ts as varchar(40)), 1, 10)) || 'T09:30:00.123Z' as generated_at,
  count(*) as total_rows
from {events} group by 1, 2, 3, 4
"""

# ---- content briefs ---------------------------------------------------------
DOC_OF_PAGE = "cast(regexp_extract(p.url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) as bigint)"
_LAST = "split_part(d.text, chr(10), -1)"

# The paired document's text as a writer might have changed it: moved last
# line, joined clauses, an added closing line, or as published.
DRAFTS = f"""
select p.page_id, p.url, split_part(d.text, chr(10), 1) as headline, d.lang,
  case when p.page_id % 4 = 1 and d.text like '%' || chr(10) || '%' then {_LAST} || chr(10) || substring(d.text, 1, length(d.text) - length({_LAST}) - 1)
    when p.page_id % 4 = 2 then replace(d.text, ', ', ' and so ')
    when p.page_id % 4 = 3 then d.text || chr(10) || 'An entirely new closing paragraph written for page ' || p.page_id || ' alone.'
    else d.text end as draft
from {{pages}} p join {{documents}} d on d.doc_id = {DOC_OF_PAGE}
"""


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# Brief markup around each draft; the place of the title varies by page.
BRIEFS = f"""
select page_id as doc_id, url,
  case page_id % 5 when 0 then '<h3>' || {escaped('headline')} || ' - H3</h3>' else '' end ||
  '<p>{chr(8203)}<strong>Meta Title:</strong> ' || {escaped('headline')} || '<br/>Slug &ndash; x</p>' ||
  '<p>SEO Slug: page-' || page_id || ' Focus Keyword: anything</p>' ||
  case page_id % 3 when 0 then '<table><tr><th>Meta Description</th><td>About <b>page</b> ' || page_id || '</td></tr><tr><td>Other</td><td>x</td></tr></table>'
    when 1 then '<p>Met Description:<br>About page ' || page_id || '</p>' else '<p>Description &#8211;</p>' end ||
  case page_id % 5 when 1 then '<p>H1:</p><p>' || {escaped('headline')} || '</p>' when 2 then '<h1>' || {escaped('headline')} || '</h1>' else '' end ||
  '<p>-------</p><p>' || replace({escaped('draft')}, chr(10), case when page_id % 2 = 0 then '</p><p>' else '<br>' end) || '</p>' ||
  '<h2>Questions (H2)</h2><p>What is it? (H4)<br>An answer with <b>bold words</b> and <a class="x" href="https://Links.example/a/?utm_source=q&amp;b=' || page_id || '">a link</a></p>' ||
  '<ul><li>First item</li><li>----</li><li>Second <strong>item</strong></li></ul>' as html
from ({DRAFTS}) t
"""

# Documents with their lines published as headings, one way or another.
HEADED = f"""
select doc_id, 'https://docs.example/' || doc_id as url, '<html><body><article><h1>Document ' || doc_id || '</h1>' ||
  case doc_id % 5 when 1 then '<h3>' || replace({escaped('text')}, chr(10), '</h3><h3>') || '</h3>'
    when 2 then '<p><b>' || replace({escaped('text')}, chr(10), '</b></p><p><b>') || '</b></p>'
    when 3 then '<h2>+ ' || replace({escaped('text')}, chr(10), ' +</h2><h2>+ ') || ' +</h2>'
    when 4 then '<h2>' || replace({escaped("replace(text, ', ', ' and so ')")}, chr(10), '</h2><h2>') || '</h2>'
    else '<h2>' || replace({escaped('text')}, chr(10), '</h2><h2>') || '</h2>' end || '</article></body></html>' as html
from {{documents}}
"""
HEADING_BRIEFS = f"""
select doc_id, 'https://docs.example/' || doc_id as url, '<h2>' || replace({escaped('text')}, chr(10), '</h2><h2>') || '</h2>' as html from {{documents}}
"""

# Links and bold phrases per user and day, repeats included.
_WHO = "user_id * 100 + cast(substring(cast(ts as varchar(40)), 9, 2) as bigint)"
LINKS = f"""
select {_WHO} as pair_id, 'https://site.example/' || user_id as url, event_id as idx,
  case event_type when 'view' then 'See plans' when 'click' then 'Read  More' when 'error' then 'Contact' when 'signup' then 'Sign up' else 'Buy' end as text,
  'https://site.example/t/' || cast(floor(value / 12) as bigint) as link
from {{events}}
"""
