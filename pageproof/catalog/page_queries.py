"""Text functions, URLs and element extraction over the page table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageproof.catalog import duck as d
from pageproof.catalog.base import Tables, query
from pageproof.functions import text as t
from pageproof.functions import urls as u
from pageproof.functions.sql import register_sql_functions
from pageproof.operators import checks as C
from pageproof.operators import html as H

# Expected titles: the paired document's first line.
# The document id is the first number in the page's URL path.
PAIRED = r"""
paired as (select p.page_id, p.url, p.title,
    split_part(doc.text, chr(10), 1) as expected
  from titled p left join documents doc
    on doc.doc_id = try_cast(regexp_extract(p.url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) as bigint))
"""


def titled_pages(db: Tables):
    pages = H.with_head(db.pages).select("page_id", "url", "title")
    keyed = pages.withColumn(
        "doc_id", F.regexp_extract("url", r"^https?://[^/]+/[a-z]+/([0-9]+)", 1).try_cast("bigint")
    )
    lines = db.documents.select("doc_id", F.substring_index("text", "\n", 1).alias("line"))
    return keyed.join(lines, "doc_id", "left").select(
        "page_id", "url", "title", F.col("line").alias("expected")
    )


TITLED = rf"titled as (select page_id, url, {d.norm(d.decode('''regexp_extract(html, '(?i)<title[^>]*>([^<]*)', 1)'''))} as title from pages)"


@query(rf"""
with {TITLED}, {PAIRED}
select page_id, url, expected, title as actual,
  case when title = '' then 'failed'
       when {d.norm('expected')} <> '' and {d.cmp('expected')} <> {d.cmp('title')} then 'failed' else 'passed' end as status,
  case when title = '' then 'Meta title is missing.'
       when {d.norm('expected')} <> '' and {d.cmp('expected')} <> {d.cmp('title')} then 'Meta title does not match the expected value.'
       else 'Meta title is valid.' end as message
from paired
""")
def title_check(db: Tables):
    judged = titled_pages(db).withColumn(
        "r", C.expected_or_presence(F.col("title"), F.col("expected"), C.FIELD_NAMES["title"])
    )
    return judged.select("page_id", "url", "expected", F.col("r.actual"), F.col("r.status"), F.col("r.message"))


@query(f"""
select doc_id, md5({d.norm('text')}) as norm_md5, md5({d.key('text')}) as key_md5,
  md5({d.display('text')}) as display_md5, md5({d.faq_key('text')}) as faq_md5,
  regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') as label, cast(length({d.key('text')}) as int) as key_length
from documents
""")
def text_keys(db: Tables):
    return db.documents.select(
        "doc_id",
        F.md5(t.normalize_text("text")).alias("norm_md5"),
        F.md5(t.content_key("text")).alias("key_md5"),
        F.md5(t.content_display("text")).alias("display_md5"),
        F.md5(t.faq_key("text")).alias("faq_md5"),
        t.normalize_label("text").alias("label"),
        F.length(t.content_key("text")).alias("key_length"),
    )


@query(f"""
select doc_id, {d.preview10('text')} as preview, {d.question_preview('text')} as question,
  regexp_replace(left(replace(trim(regexp_replace(regexp_replace(source || '_' || lang || ' - ' || text, '[^a-zA-Z0-9]', ' ', 'g'), '\\s+', ' ', 'g')), ' ', '-'), 60), '-+$', '') as slug,
  replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), chr(10), '<br>') as cell,
  replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as escaped
from documents
""".replace("\\\\s", "\\s"))
def text_previews(db: Tables):
    head = F.col("text")
    name = F.concat("source", F.lit("_"), "lang", F.lit(" - "), F.replace(F.replace(F.col("text"), F.lit("/"), F.lit(" ")), F.lit("\\"), F.lit(" ")), F.lit(".docx"))
    return db.documents.select(
        "doc_id",
        t.preview10("text").alias("preview"),
        t.question_preview("text").alias("question"),
        t.source_slug(name).alias("slug"),
        t.md_cell(head).alias("cell"),
        t.html_escape(head).alias("escaped"),
    )


@query(f"""
with w as (select doc_id, {d.words(d.key('text'))} as words from documents)
select doc_id, cast(len(words) as int) as n_words, md5(array_to_string(list_sort(words), ' ')) as words_md5 from w
""")
def content_words(db: Tables):
    words = db.documents.select("doc_id", t.content_words(t.content_key("text")).alias("words"))
    return words.select(
        "doc_id", F.size("words").alias("n_words"), F.md5(F.array_join(F.sort_array("words"), " ")).alias("words_md5")
    )


@query(r"""
select page_id, md5(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"')) as decoded_md5,
  md5(replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&')) as markup_md5
from pages
""")
def entity_decode(db: Tables):
    return db.pages.select(
        "page_id", F.md5(t.decode_entities("html")).alias("decoded_md5"), F.md5(t.decode_markup("html")).alias("markup_md5")
    )


@query(f"""
with {d.pieces()},
a as (select url, unnest(regexp_extract_all({d.live()}, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) as href from pages)
select distinct href, url as base, {d.normalize_url('href', 'url')} as clean from a
union all
select url, url, {d.normalize_url('url', 'url')} from pages
""")
def normalize_urls(db: Tables):
    links = H.with_body(db.pages).select(F.explode("anchors.href").alias("href"), F.col("url").alias("base")).distinct()
    own = db.pages.select(F.col("url").alias("href"), F.col("url").alias("base"))
    return links.unionByName(own).select("href", "base", u.normalize_url("href", "base").alias("clean"))


@query(f"""
with n as (select page_id, url, {d.normalize_url('url', 'url')} as clean from pages)
select clean, count(*) as spellings, min(page_id) as first_page from n group by clean
""")
def equivalent_urls(db: Tables):
    return (
        db.pages.withColumn("clean", u.normalize_url("url", "url"))
        .groupBy("clean")
        .agg(F.count("*").alias("spellings"), F.min("page_id").alias("first_page"))
    )


@query(f"""
with {d.pieces()},
b as (select page_id, kind, {d.tagless('piece')} as text, null as href, in_scope, n from piece
      where regexp_matches(kind, '^(h[1-6]|p|li|blockquote|figcaption)$')),
bold as (select page_id, 'b' as kind, unnest(regexp_extract_all(piece, '(?i)<(?:strong|b)(?:\\s[^>]*)?>([\\s\\S]*?)(?:</(?:strong|b)\\s*>|$)', 1)) as raw, in_scope, n from piece),
link as (select page_id, unnest(regexp_extract_all({d.live()}, '(?i)<a\\s[^>]*>[\\s\\S]*?</a\\s*>')) as raw from pages),
alls as (
  select page_id, kind, text, in_scope from b where text <> ''
  union all select page_id, kind, {d.tagless('raw')}, in_scope from bold where {d.tagless('raw')} <> ''
  union all select page_id, 'a', {d.tagless('raw')}, false from link
  union all select page_id, 'title', {d.norm(d.decode('''regexp_extract(html, '(?i)<title[^>]*>([^<]*)', 1)'''))}, false from pages)
select page_id, kind, in_scope, count(*) as n, cast(sum(length(text)) as bigint) as chars, md5(min(text) || max(text)) as edge_md5
from alls group by page_id, kind, in_scope
""")
def page_elements(db: Tables):
    return (
        H.element_rows(db.pages)
        .groupBy("page_id", "kind", "in_scope")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.length("text")).alias("chars"),
            F.md5(F.concat(F.min("text"), F.max("text"))).alias("edge_md5"),
        )
    )


@query(f"""
with {d.pieces()}, h as (select page_id, n, kind, {d.tagless('piece')} as text from piece where kind in ('h1', 'h2'))
select p.page_id, coalesce(string_agg(h.text, ' | ' order by h.n) filter (h.kind = 'h1' and h.text <> ''), '') as h1,
  coalesce(string_agg(h.text, ' | ' order by h.n) filter (h.kind = 'h2' and h.text <> ''), '') as h2
from pages p left join h using (page_id) group by p.page_id
""")
def heading_text(db: Tables):
    body = H.with_body(db.pages)
    return body.select("page_id", H.joined_headings(1).alias("h1"), H.joined_headings(2).alias("h2"))


@query(f"""
with c as (select page_id, cast(len(regexp_extract_all({d.live()}, '(?i)<h1[\\s>]')) as int) as n from pages)
select page_id, n, case when n = 0 then 'skipped' when n = 1 then 'passed' else 'failed' end as status from c
""")
def h1_count(db: Tables):
    n = F.col("n")
    return db.pages.select("page_id", H.h1_count().alias("n")).withColumn(
        "status", F.when(n == 0, "skipped").when(n == 1, "passed").otherwise("failed")
    )


@query(f"""
with a as (select page_id, url, unnest(regexp_extract_all({d.live()}, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) as href from pages),
l as (select page_id, url as page_url, {d.link_href('href', 'url')} as link from a)
select page_id, page_url, link, case when starts_with(link, {d.origin('page_url')}) then 'Internal' else 'External' end as link_type
from l
""")
def link_types(db: Tables):
    links = H.with_body(db.pages).select("page_id", F.col("url").alias("page_url"), F.explode("anchors.href").alias("href"))
    return links.withColumn("link", u.link_href("href", "page_url")).select(
        "page_id", "page_url", "link", u.link_type("link", "page_url").alias("link_type")
    )


# Paragraphs of the pages with links put in: one to keep, two that lead nowhere else.
LINKED = """replace(html, '<p>', '<p><a class="x" href="/l/' || page_id || '?utm_source=a#f">Link <i>' || page_id || '</i></a> ' ||
  '<a href="mailto:a@b.example">Mail</a> <a href="#top">Top</a> ')"""


@query(f"""
with pages as (select page_id, url, {LINKED} as html from main.pages), {d.pieces()},
link as (select page_id, url, n, unnest(regexp_extract_all(piece, '(?i)<a\\s[^>]*>[\\s\\S]*?</a\\s*>')) as raw from piece where in_scope),
aim as (select *, regexp_extract(raw, 'href="([^"]*)"', 1) as href from link)
select page_id, {d.tagless('raw')} as text, {d.normalize_url('href', 'url')} as url from aim
where not starts_with(href, '#') and not starts_with(href, 'mailto:')
""")
def link_extract(db: Tables):
    body = H.with_body(db.pages.withColumn("html", F.expr(LINKED)))
    return body.select("page_id", F.explode(H.scoped_links()).alias("l")).select("page_id", "l.text", "l.url")


@query(f"""
with {d.pieces()},
bold as (select page_id, unnest(regexp_extract_all(piece, '(?i)<(?:strong|b)(?:\\s[^>]*)?>([\\s\\S]*?)(?:</(?:strong|b)\\s*>|$)', 1)) as raw from piece where in_scope)
select page_id, {d.tagless('raw')} as phrase from bold where {d.tagless('raw')} <> ''
""")
def bold_extract(db: Tables):
    return H.with_body(db.pages).select("page_id", F.explode(H.scoped_bolds()).alias("phrase"))


@query(f"""
with {d.pieces()},
t as (select page_id, kind, in_scope, n, {d.tagless('piece')} as text from piece),
best as (select page_id, min(n) filter (kind = 'h1' and in_scope and text <> '') as scoped, min(n) filter (kind = 'h1' and text <> '') as every from t group by page_id)
select b.page_id, case when regexp_matches(p.html, '(?i)<article[\\s>]') then 'article' when regexp_matches(p.html, '(?i)<main[\\s>]') then 'main' else 'body' end as scope,
  t.text as title
from best b join pages p using (page_id) left join t on t.page_id = b.page_id and t.n = coalesce(b.scoped, b.every)
""")
def content_scope(db: Tables):
    return H.with_body(db.pages).select("page_id", "scope", H.page_title_h1().alias("title"))


@query(f"""
with {d.pieces()},
u as (select page_id, n, {d.tagless('piece')} as text from piece where kind in ('p', 'blockquote', 'figcaption') or (kind = 'li' and in_scope)),
k as (select page_id, text, cast(row_number() over (partition by page_id order by n) - 1 as int) as pos from u where text <> '')
select page_id, pos, text from k
""")
def paragraph_units(db: Tables):
    return H.with_body(db.pages).select("page_id", F.posexplode(H.paragraph_units()).alias("pos", "text"))


@query(f"""
select page_id, md5({d.tagless('''regexp_extract(regexp_replace(html, '<!--[\\s\\S]*?-->', '', 'g'), '(?i)<body[^>]*>([\\s\\S]*)$', 1)''')}) as text_md5
from pages
""")
def full_page_text(db: Tables):
    return db.pages.select("page_id", F.md5(H.full_text()).alias("text_md5"))


@query(f"""
select doc_id, md5({d.norm('text')}) as norm_md5, {d.preview10('text')} as preview,
  regexp_matches(text, '(?i)^https?://\\S+$') as is_link
from documents
""")
def sql_function_calls(db: Tables):
    register_sql_functions(db.spark)
    return db.sql(
        "select doc_id, md5(pp_normalize_text(text)) as norm_md5, pp_preview10(text) as preview, pp_is_url(text) as is_link"
        " from {documents}"
    )


@query(f"""
with {d.pieces()},
a as (select page_id, url, unnest(regexp_extract_all({d.live()}, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) as href from pages),
l as (select page_id, url, href, {d.link_href('href', 'url')} as link, {d.normalize_url('href', 'url')} as clean from a)
select page_id, href, clean, link, case when starts_with(link, {d.origin('url')}) then 'Internal' else 'External' end as link_type,
  case when regexp_matches(href, '(?i)^https?://') then href else link end as resolved
from l
""")
def sql_link_functions(db: Tables):
    """Every link of every page through functions called by name in SQL."""
    register_sql_functions(db.spark)
    links = H.with_body(db.pages).select("page_id", "url", F.explode("anchors").alias("a"))
    return db.spark.sql(
        "select page_id, href, pp_normalize_url(href, url) as clean, pp_link_href(href, url) as link,"
        " pp_link_type(pp_link_href(href, url), url) as link_type, pp_resolve_url(href, url) as resolved from {links}",
        links=links.select("page_id", "url", F.col("a.href").alias("href")),
    )
