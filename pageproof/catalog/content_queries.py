"""Content briefs and their comparison with published pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageproof.catalog import duck as d
from pageproof.catalog import inputs as I
from pageproof.catalog.base import Tables, duck, query
from pageproof.functions import text as t
from pageproof.functions.align import diff_words, lcs_align
from pageproof.operators import briefs as B
from pageproof.operators import content as K
from pageproof.operators import html as H
from pageproof.operators import rollups as R
from pageproof.operators.similar import best_similar, similar_across_corpus
from pageproof.plans import audits
from pageproof.session import materialized

BRIEFS = f"briefs as ({duck(I.BRIEFS)})"
DRAFTS = f"drafts as ({duck(I.DRAFTS)})"


@query(rf"""with {BRIEFS}, b as (select doc_id, regexp_extract_all(html, '(?i)<(?:h1|h2|h3|h4|p|table|ul|ol)[^>]*>[\s\S]*?</(?:h1|h2|h3|h4|p|table|ul|ol)>') as parts from briefs),
x as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as pos from b)
select doc_id, cast(pos as int) as block_pos, lower(regexp_extract(part, '^<([a-zA-Z0-9]+)', 1)) as tag, md5(regexp_replace(regexp_replace(part, '^<[^>]*>', ''), '</[a-zA-Z0-9]+>$', '')) as inner_md5 from x""")
def brief_blocks(db: Tables):
    return B.brief_blocks(db.sql(I.BRIEFS)).select("doc_id", "block_pos", "tag", F.md5("inner").alias("inner_md5"))


# What the markup of BRIEFS must yield, derived from the drafts themselves.
# Lines of a draft are dropped when empty or mere dividers.
LINE_TEXT = rf"regexp_replace({d.norm('line')}, '{d.INVISIBLE}', '', 'g')"
SUFFIX = r"(?i)\s*(?:\(\s*h\s*[1-4]\s*\)|[-–—]\s*h\s*[1-4])\s*$"
DIV = r"""^[-=*_~|"''\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2015}\x{2212}\x{FE58}\x{FE63}\x{FF0D}\x{2018}\x{2019}\x{201A}\x{201B}\x{201C}\x{201D}\x{201E}\x{201F}\s]+$"""
LABEL = B.LABEL_LINE
DRAFT_LINES = rf"""{DRAFTS},
l0 as (select page_id, headline, string_split(draft, chr(10)) as parts from drafts),
l1 as (select page_id, headline, unnest(parts) as line, generate_subscripts(parts, 1) as n from l0),
l2 as (select page_id, headline, n, {LINE_TEXT} as text from l1),
kept as (select * from l2 where text <> '' and not regexp_matches(text, '{DIV}') and not regexp_matches(text, '{LABEL}')),
joined as (select page_id, case when page_id % 2 = 0 then n else 0 end as grp, string_agg(text, ' ' order by n) as text from kept group by 1, 2),
extra as (select page_id, -1 as grp, 'Slug &ndash; x' as text from drafts union all select page_id, 1000000, 'An answer with bold words and a link' from drafts union all select page_id, 1000001, 'First item' from drafts union all select page_id, 1000002, 'Second item' from drafts),
paras as (select page_id, grp, text from joined union all select * from extra),
num as (select page_id, text, row_number() over (partition by page_id order by grp) as rn from paras)"""
# Without a labelled or real title the first heading or first paragraph names it.
NAMED = "page_id % 5 in (0, 1, 2)"


@query(rf"""with {DRAFT_LINES}, h as (select page_id, regexp_replace({d.norm('headline')}, '{d.INVISIBLE}', '', 'g') as headline from drafts),
first as (select page_id, text from num where rn = 1)
select h.page_id as doc_id, case when {NAMED.replace('page_id', 'h.page_id')} then headline else first.text end as title, headline as meta_title,
  case when h.page_id % 3 in (0, 1) then 'About page ' || h.page_id end as meta_description, cast(null as varchar) as canonical, 'page-' || h.page_id as slug
from h join first using (page_id)""")
def brief_fields(db: Tables):
    c = B.brief_content(db.sql(I.BRIEFS))
    return c.select("doc_id", "title", "meta_title", "meta_description", "canonical", "slug")


@query(rf"""with {DRAFT_LINES}
select page_id as doc_id, 'p' as kind, cast(rn - case when {NAMED} then 1 else 2 end as int) as pos, text from num where {NAMED} or rn > 1
union all select page_id, 'h2', 0, 'Questions' from drafts union all select page_id, 'h4', 0, 'What is it?' from drafts""")
def brief_items(db: Tables):
    c = B.brief_content(db.sql(I.BRIEFS))
    kinds = {"p": "paragraphs", "h2": "h2", "h3": "h3", "h4": "h4"}
    tag = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("pos"), x.alias("text"))
    tagged = [F.transform(F.col(column), tag(kind)) for kind, column in kinds.items()]
    return c.select("doc_id", F.explode(F.concat(*tagged)).alias("i")).select("doc_id", "i.kind", "i.pos", "i.text")


@query(f"""with {DRAFTS}
select page_id as doc_id, 'link' as kind, 'a link' as text, 'https://links.example/a?b=' || page_id as url from drafts
union all select page_id, 'bold', 'bold words', null from drafts union all select page_id, 'bold', 'item', null from drafts""")
def brief_links_and_bold(db: Tables):
    c = B.brief_content(db.sql(I.BRIEFS))
    links = F.transform("links", lambda x: F.struct(F.lit("link").alias("kind"), x["text"].alias("text"), x["url"].alias("url")))
    bolds = F.transform("bolds", lambda x: F.struct(F.lit("bold").alias("kind"), x.alias("text"), F.lit(None).cast("string").alias("url")))
    return c.select("doc_id", F.explode(F.concat(links, bolds)).alias("i")).select("doc_id", "i.kind", "i.text", "i.url")


# ---- single values ----------------------------------------------------------

# upper() as the SQL has it, code point by code point: Spark's makes two of one here and there.
UPPER = "array_join(transform(split({}, ''), c -> case when c = 'ß' then 'ẞ' when length(upper(c)) = 1 then upper(c) when length(initcap(c)) = 1 then initcap(c) else c end), '')"
VALUES = r"""
select p.page_id as pair_id, p.url, split_part(d.text, chr(10), 1) as e_meta_title,
  case p.page_id % 6 when 0 then split_part(d.text, chr(10), 1) || ' | Site Name' when 1 then '' when 2 then upper(substring(split_part(d.text, chr(10), 1), 1, 12)) || substring(split_part(d.text, chr(10), 1), 13) || '.'
    when 3 then 'Another title' when 4 then null else split_part(d.text, chr(10), 1) || ' - ' end as a_meta_title,
  case p.page_id % 4 when 0 then p.url || '?utm_source=x#top' when 1 then null when 2 then 'https://other.example/' else '/x/' || p.page_id end as a_canonical,
  case when p.page_id % 3 = 0 then p.url || '/' end as e_canonical,
  case p.page_id % 4 when 0 then null when 1 then '/' || p.page_id || '/' else cast(d.doc_id as varchar(20)) end as e_slug,
  cast(p.page_id % 4 as int) as a_h1_count
from {pages} p join {documents} d on d.doc_id = cast(regexp_extract(p.url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) as bigint)
"""


def values(db: Tables):
    plain = "upper(substring(split_part(d.text, chr(10), 1), 1, 12))"
    return db.sql(VALUES.replace(plain, UPPER.replace("{}", plain[len("upper(") : -1])))


def _sep(a: str, e: str) -> str:
    return "(" + " or ".join(f"(starts_with({a}, {e} || '{s}') and length({a}) > length({e}) + {len(s)})" for s in (" - ", " – ", " — ", " | ")) + ")"


@query(f"""with v as ({duck(VALUES)}), k as (select *, {d.norm('e_meta_title')} as ne, {d.norm('a_meta_title')} as na, {d.key('e_meta_title')} as ek, {d.key('a_meta_title')} as ak from v),
c as (select *, case when ne = '' then 'none' when na = '' then 'missing' when ek = ak then 'same' when ek <> '' and {_sep('ak', 'ek')} then 'suffix' else 'changed' end as c from k)
select pair_id, url, 'Meta Title' as check_type, case c when 'none' then 'skipped' when 'same' then 'passed' when 'suffix' then 'passed' else 'failed' end as status,
  e_meta_title as expected, a_meta_title as actual,
  case c when 'none' then 'No expected value provided in the document.' when 'missing' then 'Meta title is missing from the live page.' when 'same' then 'Meta Title matches the approved document.'
    when 'suffix' then 'Meta Title matches the approved document (a trailing site-name suffix was ignored).'
    else 'Meta Title has changed. Expected "' || ne || '" but found "' || na || '".' end as message from c""")
def content_single_value(db: Tables):
    out = K.value_rows(values(db), [K.single_value("Meta Title", "meta_title", "Meta title is missing from the live page.", True)])
    return out.select("pair_id", "url", "check_type", "status", "expected", "actual", "message")


@query(f"""with v as ({duck(VALUES)}), k as (select *, coalesce(e_canonical, url) as shown, {d.normalize_url('coalesce(e_canonical, url)', 'url')} as want, {d.normalize_url('a_canonical', 'url')} as have from v)
select pair_id, url, 'Canonical URL' as check_type, case when a_canonical is null or want <> have then 'failed' else 'passed' end as status, shown as expected, a_canonical as actual,
  case when a_canonical is null then 'Canonical URL is missing from the live page.' when want <> have then 'Canonical URL does not match. Expected it to point to "' || shown || '" but found "' || a_canonical || '".'
    else 'Canonical URL matches the expected target.' end as message from k""")
def canonical_check(db: Tables):
    return K.value_rows(values(db), [K.canonical_check()]).select("pair_id", "url", "check_type", "status", "expected", "actual", "message")


@query(f"""with v as ({duck(VALUES)}), k as (select *, trim(lower(trim(coalesce(e_slug, ''))), '/') as want, trim(lower({d.enc("regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)")}), '/') as path from v)
select pair_id, url, 'Blog URL / Slug' as check_type, case when want = '' then 'skipped' when ends_with(path, want) then 'passed' else 'failed' end as status, e_slug as expected,
  case when want <> '' then path end as actual, case when want = '' then 'No expected URL/slug was specified in the approved document.' when ends_with(path, want) then 'Live URL matches the expected slug/structure.'
    else 'The live URL does not match the expected slug. Expected "' || e_slug || '" but the live URL path is "' || path || '".' end as message from k""")
def slug_check(db: Tables):
    return K.value_rows(values(db), [K.slug_check()]).select("pair_id", "url", "check_type", "status", "expected", "actual", "message")


@query(f"""with v as ({duck(VALUES)}) select pair_id, url, 'H1 Tag Count' as check_type, case a_h1_count when 0 then 'skipped' when 1 then 'passed' else 'failed' end as status,
  '1' as expected, cast(a_h1_count as varchar) as actual from v""")
def h1_count_check(db: Tables):
    return K.value_rows(values(db), [K.h1_count_check()]).select("pair_id", "url", "check_type", "status", "expected", "actual")


# ---- paragraphs -------------------------------------------------------------


def paragraph_pairs(db: Tables):
    expected = db.sql(I.DRAFTS).select(
        "page_id", F.filter(F.transform(F.split("draft", "\n"), lambda x: t.normalize_text(x)), lambda x: x != "").alias("e_paragraphs")
    )
    actual = H.with_body(db.pages).select("page_id", "url", H.paragraph_units().alias("a_paragraphs"))
    return materialized(expected.join(actual, "page_id").withColumnRenamed("page_id", "pair_id"))


SIDES = f"""{DRAFTS}, e0 as (select page_id, unnest(string_split(draft, chr(10))) as line, generate_subscripts(string_split(draft, chr(10)), 1) as n from drafts),
e1 as (select page_id, {d.norm('line')} as text, n from e0), e as (select page_id, text, {d.key('text')} as key, row_number() over (partition by page_id order by n) - 1 as idx from e1 where text <> ''),
{d.pieces()},
u as (select page_id, n, {d.tagless('piece')} as text from piece where kind in ('p', 'blockquote', 'figcaption') or (kind = 'li' and in_scope)),
a as (select page_id, text, {d.key('text')} as key, row_number() over (partition by page_id order by n) - 1 as idx from u where text <> '' and page_id in (select page_id from drafts))"""
SIMILAR = f"""ew0 as (select page_id, idx, {d.words('key')} as w from e), aw0 as (select page_id, idx, {d.words('key')} as w from a),
ew as (select page_id, idx, len(w) as n, unnest(w) as w from ew0), aw as (select page_id, idx, len(w) as n, unnest(w) as w from aw0),
hit as (select ew.page_id, ew.idx as e_id, aw.idx as a_id, count(*) as shared, count(*) / greatest(min(ew.n), min(aw.n)) as score from ew join aw using (page_id, w) group by 1, 2, 3),
best as (select * from hit where shared >= 3 and score >= 0.65 qualify row_number() over (partition by page_id, e_id order by score desc, a_id) = 1)"""


@query(f"with {SIDES}, {SIMILAR} select page_id as pair_id, cast(e_id as int) as e_id, cast(a_id as int) as a_id, round(score, 6) as score from best")
def paragraph_similarity(db: Tables):
    p = paragraph_pairs(db)
    side = lambda c, x: p.select("pair_id", F.posexplode(c).alias(f"{x}_id", "text")).select("pair_id", f"{x}_id", t.content_key("text").alias(f"{x}_key"))
    best = best_similar(side("e_paragraphs", "e"), side("a_paragraphs", "a"), ["pair_id"])
    return best.withColumn("score", F.round("score", 6))


@query(f"""with {SIDES}, {SIMILAR}, x as (select page_id, key, min(idx) as idx from a group by 1, 2)
select e.page_id as pair_id, cast(e.idx as int) as idx, e.text as expected, case when x.idx is not null then 'present' when b.a_id is not null then 'changed' else 'missing' end as tier,
  case when x.idx is not null then x.idx when b.a_id is not null then b.a_id end as partner
from e left join x on x.page_id = e.page_id and x.key = e.key left join best b on b.page_id = e.page_id and b.e_id = e.idx""")
def paragraph_tiers(db: Tables):
    """Present (first equal position), changed (best similar) or missing."""
    p = paragraph_pairs(db)
    items = K.aligned_items(p, (K.PARAGRAPHS,))
    first = p.select("pair_id", F.posexplode(F.transform("e_paragraphs", lambda x: t.content_key(x))).alias("idx", "key"), "a_paragraphs").select(
        "pair_id", "idx", F.array_position(F.transform("a_paragraphs", lambda x: t.content_key(x)), F.col("key")).alias("at")
    )
    open_ = F.col("lcs").isNull() & F.col("exact").isNull()
    sim = K.similar_items(p, items, (K.PARAGRAPHS,)).drop("kind")
    return (
        items.join(first, ["pair_id", "idx"])
        .join(sim, ["pair_id", "idx"], "left")
        .select(
            "pair_id",
            "idx",
            F.col("text").alias("expected"),
            F.when(~open_, "present").when(F.col("sim").isNotNull(), "changed").otherwise("missing").alias("tier"),
            F.coalesce(F.when(~open_, F.col("at") - 1), F.col("sim")).cast("bigint").alias("partner"),
        )
    )


@query(f"""with {SIDES}, n as (select page_id, count(*) as items from e group by 1)
select page_id as pair_id, items, cast(0 as bigint) as unequal, cast(0 as bigint) as out_of_order from n""")
def lcs_align_invariants(db: Tables):
    """Alignment holds equal items only and is strictly increasing."""
    keys = lambda c: F.transform(c, lambda x: t.content_key(x))
    p = paragraph_pairs(db).withColumns({"ek": keys("e_paragraphs"), "ak": keys("a_paragraphs")}).withColumn("al", lcs_align("ek", "ak"))
    used = F.filter("al", lambda j: j.isNotNull())
    return p.select(
        "pair_id",
        F.size("ek").cast("bigint").alias("items"),
        F.size(F.filter(F.transform("al", lambda j, i: j.isNotNull() & (F.get("ek", i) != F.get("ak", j))), lambda b: b)).cast("bigint").alias("unequal"),
        F.size(F.filter(F.transform(used, lambda j, i: (i > 0) & (j <= F.get(used, i - 1))), lambda b: F.coalesce(b, F.lit(False)))).cast("bigint").alias("out_of_order"),
    )


# The table of longest common subsequences, row by row: a cell is the best of the
# row above and, where the items are equal, one more than its upper left, carried
# on to the right.
LCS_TABLE = f"""with recursive {SIDES},
ek as (select page_id, list(key order by idx) as ek from e group by 1), ak as (select page_id, list(key order by idx) as ak from a group by 1),
both_sides as (select d.page_id, coalesce(ek, []) as ek, coalesce(ak, []) as ak from drafts d left join ek using (page_id) left join ak using (page_id)),
grown(page_id, i, ek, ak, cells) as (
  select page_id, 0, ek, ak, list_transform(range(1, len(ak) + 1), lambda j: 0) from both_sides
  union all
  select page_id, i + 1, ek, ak, list_transform(range(1, len(ak) + 1), lambda j: list_max(list_transform(range(1, j + 1),
    lambda k: greatest(cells[k], case when ak[k] = ek[i + 1] then coalesce(cells[k - 1], 0) + 1 else 0 end))))
  from grown where i < len(ek)),
lengths as (select page_id, len(ek) as n, len(ak) as m, coalesce(list_max(cells), 0) as aligned from grown where i = len(ek))"""


@query(f"""{LCS_TABLE}
select page_id as pair_id, cast(n as int) as n, cast(m as int) as m, cast(aligned as int) as aligned from lengths""")
def lcs_align_lengths(db: Tables):
    keys = lambda c: F.transform(c, lambda x: t.content_key(x))
    p = paragraph_pairs(db).withColumns({"ek": keys("e_paragraphs"), "ak": keys("a_paragraphs")})
    al = p.select("pair_id", F.size("ek").alias("n"), F.size("ak").alias("m"), lcs_align("ek", "ak").alias("al"))
    return al.select("pair_id", "n", "m", F.size(F.filter("al", lambda j: j.isNotNull())).alias("aligned"))


# Changed paragraphs with the table of common subsequences of their words.
CHANGED_WORDS = f"""with recursive {SIDES}, {SIMILAR}, there as (select distinct page_id, key from a),
changed as (select e.page_id, e.idx, e.text as e_text, a.text as a_text, list_transform(string_split({d.display('e.text')}, ' '), lambda w: lower(w)) as ek,
  list_transform(string_split({d.display('a.text')}, ' '), lambda w: lower(w)) as ak
  from e join best b on b.page_id = e.page_id and b.e_id = e.idx join a on a.page_id = b.page_id and a.idx = b.a_id where not exists (select 1 from there t where t.page_id = e.page_id and t.key = e.key)),
grown(page_id, idx, i, ek, ak, cells) as (
  select page_id, idx, 0, ek, ak, list_transform(range(1, len(ak) + 1), lambda j: 0) from changed
  union all
  select page_id, idx, i + 1, ek, ak, list_transform(range(1, len(ak) + 1), lambda j: list_max(list_transform(range(1, j + 1),
    lambda k: greatest(cells[k], case when ak[k] = ek[i + 1] then coalesce(cells[k - 1], 0) + 1 else 0 end))))
  from grown where i < len(ek)),
words as (select page_id, idx, len(ek) as n, len(ak) as m, coalesce(list_max(cells), 0) as same from grown where i = len(ek))"""


@query(f"""{CHANGED_WORDS}
select page_id as pair_id, cast(idx as int) as seq, e_text as expected, a_text as actual, cast(n as int) as expected_words, cast(m as int) as actual_words, cast(same as int) as same_words
from words join changed using (page_id, idx)""")
def paragraph_word_diffs(db: Tables):
    """Diffs of changed paragraphs: both sides whole, and as many words kept as can be."""
    out = K.paragraph_results(paragraph_pairs(db)).where("diff is not null")
    count = lambda keep: F.size(F.filter("diff", keep))
    return out.select(
        "pair_id",
        "seq",
        "expected",
        "actual",
        count(lambda x: x["expected"].isNotNull()).alias("expected_words"),
        count(lambda x: x["actual"].isNotNull()).alias("actual_words"),
        count(lambda x: x["type"] == "same").alias("same_words"),
    )


@query(f"""{CHANGED_WORDS} select page_id as pair_id, cast(sum(same) as bigint) as segments from words group by 1 having sum(same) > 0""")
def diff_kept_words(db: Tables):
    stats = R.diff_statistics(K.paragraph_results(paragraph_pairs(db)), ["pair_id"])
    return stats.where("type = 'same'").select("pair_id", "segments")


@query(f"""{LCS_TABLE}, {SIMILAR}, there as (select distinct page_id, key from a),
tier as (select e.page_id, case when t.key is not null then 'present' when b.a_id is not null then 'changed' else 'missing' end as tier
  from e left join there t on t.page_id = e.page_id and t.key = e.key left join best b on b.page_id = e.page_id and b.e_id = e.idx),
n as (select page_id, count(*) filter (tier = 'present') as present, count(*) filter (tier = 'changed') as changed, count(*) filter (tier = 'missing') as missing from tier group by 1)
select page_id as pair_id, cast(aligned as bigint) as passed, cast(present - aligned as bigint) as moved, changed, missing from n join lengths using (page_id)""")
def paragraph_outcomes(db: Tables):
    """Paragraphs of a page in place, moved, changed and missing."""
    out = K.paragraph_results(paragraph_pairs(db))
    missing = F.col("message") == "Paragraph is missing from the live page."
    count = lambda keep: F.count_if(keep)
    return out.groupBy("pair_id").agg(
        count(F.col("status") == "passed").alias("passed"),
        count(F.col("status") == "warning").alias("moved"),
        count((F.col("status") == "failed") & ~missing).alias("changed"),
        count(missing).alias("missing"),
    )


@query(f"""with {DRAFTS}, x as (select page_id, {d.display('draft')} as e, {d.display('d.text')} as a from drafts join documents d on d.doc_id = cast(regexp_extract(drafts.url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) as bigint))
select page_id, md5(e) as expected_md5, md5(a) as actual_md5, cast(len(string_split(e, ' ')) as bigint) as expected_tokens, cast(len(string_split(a, ' ')) as bigint) as actual_tokens from x""")
def word_diff_rebuilds(db: Tables):
    """Segments put back together give both texts."""
    pairs = db.sql(I.DRAFTS).withColumn("doc_id", F.regexp_extract("url", r"^https?://[^/]+/[a-z]+/([0-9]+)", 1).cast("bigint"))
    both = pairs.join(db.documents.select("doc_id", "text"), "doc_id").select(
        "page_id", t.content_display("draft").alias("e"), t.content_display("text").alias("a")
    )
    diff = both.select("page_id", diff_words("e", "a").alias("diff"))
    side = lambda s: F.filter(F.transform("diff", lambda x: x[s]), lambda x: x.isNotNull())
    # The alignment ignores case, so kept words are read from either side.
    return diff.select(
        "page_id",
        F.md5(F.array_join(side("expected"), " ")).alias("expected_md5"),
        F.md5(F.array_join(side("actual"), " ")).alias("actual_md5"),
        F.size(side("expected")).cast("bigint").alias("expected_tokens"),
        F.size(side("actual")).cast("bigint").alias("actual_tokens"),
    )


@query()
def paragraph_results(db: Tables):
    return K.paragraph_results(paragraph_pairs(db)).withColumn("diff", F.size("diff"))


@query()
def diff_stats(db: Tables):
    return R.diff_statistics(K.paragraph_results(paragraph_pairs(db)), ["pair_id"])


@query()
def content_audit(db: Tables):
    """Briefs against published pages, every check."""
    out = audits.audit_content(db.sql(I.BRIEFS), db.pages)
    return out.groupBy("pair_id", "family", "status").agg(F.count("*").alias("n"), F.max(F.coalesce(F.size("diff"), F.lit(0))).alias("longest_diff"))


# ---- headings ---------------------------------------------------------------

HEADS = f"""p as (select doc_id, {d.norm('text')} as whole, text from documents),
e0 as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from p),
e1 as (select doc_id, n, {LINE_TEXT} as text from e0),
e2 as (select doc_id, n, trim(regexp_replace(text, '{SUFFIX}', '')) as text from e1 where text <> '' and not regexp_matches(text, '{DIV}') and not regexp_matches(text, '{LABEL}')),
e as (select doc_id, row_number() over (partition by doc_id order by n) - 1 as idx, text, {d.key('text')} as key from e2 where text <> ''),
a0 as (select doc_id, n, case when doc_id % 5 = 3 then '+ ' || line || ' +' when doc_id % 5 = 4 then replace(line, ', ', ' and so ') else line end as line from e0),
a1 as (select doc_id, n, {d.norm('line')} as text from a0),
a as (select doc_id, row_number() over (partition by doc_id order by n) - 1 as idx, text, {d.key('text')} as key from a1 where text <> ''),
lvl as (select * from a where doc_id % 5 in (0, 3, 4)),
oth as (select doc_id, key from a where doc_id % 5 <> 2 union select doc_id, 'document ' || doc_id from documents),
bold as (select doc_id, key from a where doc_id % 5 = 2),
stripd as (select doc_id, idx, regexp_replace(regexp_replace(key, '^[^a-z0-9]+', ''), '[^a-z0-9]+$', '') as s from lvl),
estr as (select doc_id, idx, key, text, regexp_replace(regexp_replace(key, '^[^a-z0-9]+', ''), '[^a-z0-9]+$', '') as s from e),
ex as (select doc_id, key, min(idx) as at from lvl group by 1, 2),
ins as (select e.doc_id, e.idx, min(c.idx) as at from estr e join stripd c using (doc_id) where length(e.s) >= 4 and length(c.s) >= 4 and (contains(c.s, e.s) or contains(e.s, c.s)) group by 1, 2),
ew0 as (select doc_id, idx, {d.words('key')} as w from e), aw0 as (select doc_id, idx, {d.words('key')} as w from lvl),
ew as (select doc_id, idx, len(w) as n, unnest(w) as w from ew0), aw as (select doc_id, idx, len(w) as n, unnest(w) as w from aw0),
hit as (select ew.doc_id, ew.idx as e_id, aw.idx as a_id, count(*) as shared, count(*) / greatest(min(ew.n), min(aw.n)) as score from ew join aw using (doc_id, w) group by 1, 2, 3),
best as (select * from hit where shared >= 3 and score >= 0.65 qualify row_number() over (partition by doc_id, e_id order by score desc, a_id) = 1)"""


@query(f"""with {HEADS}
select e.doc_id as pair_id, cast(e.idx as int) as seq, case when ex.at is not null then 'present' when ins.at is not null then 'inside' when oth.key is not null then 'elsewhere'
  when bold.key is not null then 'bold' when best.a_id is not null then 'changed' else 'missing' end as tier
from e left join ex on ex.doc_id = e.doc_id and ex.key = e.key left join ins on ins.doc_id = e.doc_id and ins.idx = e.idx
left join oth on oth.doc_id = e.doc_id and oth.key = e.key left join (select distinct * from bold) bold on bold.doc_id = e.doc_id and bold.key = e.key
left join best on best.doc_id = e.doc_id and best.e_id = e.idx""")
def heading_tiers(db: Tables):
    expected = B.brief_content(db.sql(I.HEADING_BRIEFS).withColumn("html", F.concat(F.lit("<h1>Lead</h1>"), "html")))
    pages = db.sql(I.HEADED)
    pairs = materialized(K.pair_content(expected, K.published_content(pages)))
    out = K.heading_results(pairs, 2)
    m = F.col("message")
    tier = (
        F.when((F.col("status") == "passed") | m.contains("out of order"), "present")
        .when(m.contains("additional markup"), "inside")
        .when(m.contains("different level"), "elsewhere")
        .when(m.contains("bold-styled"), "bold")
        .when(m.endswith("is missing from the live page."), "missing")
        .otherwise("changed")
    )
    return out.select("pair_id", "seq", tier.alias("tier"))


# ---- links and bold ---------------------------------------------------------

LNK = f"""l as ({duck(I.LINKS)}), k as (select *, {d.cmp('text')} || '||' || link as key, {d.cmp('text')} as tkey, text || ' → ' || link as shown from l),
e as (select *, row_number() over (partition by pair_id, key order by idx) as occ from k where idx % 3 <> 0), a as (select * from k where idx % 4 <> 1),
have as (select pair_id, url, key, count(*) as n, min(idx) as idx, min_by(text, idx) as text, min_by(link, idx) as link, min_by(shown, idx) as shown from a group by 1, 2, 3),
bu as (select pair_id, link, min_by(shown, idx) as shown, min_by(text, idx) as text from a group by 1, 2), bt as (select pair_id, tkey, min_by(shown, idx) as shown, min_by(link, idx) as link from a group by 1, 2)"""


def links(db: Tables):
    all_links = db.sql(I.LINKS)
    return all_links.where("idx % 3 <> 0"), all_links.where("idx % 4 <> 1")


@query(f"""with {LNK}
select e.pair_id, e.url, cast(e.idx as int) as seq, 'Hyperlink: "' || {d.preview10('e.text')} || '"' as check_type, case when e.occ <= h.n then 'passed' else 'failed' end as status, e.shown as expected,
  case when e.occ <= h.n then e.shown when bu.shown is not null then bu.shown when bt.shown is not null then bt.shown end as actual,
  case when e.occ <= h.n then 'Hyperlink matches the approved document.'
    when bu.shown is not null then 'Hyperlink destination matches but anchor text differs. Expected "' || e.text || '" but found "' || bu.text || '".'
    when bt.shown is not null then 'Hyperlink text matches but destination URL differs. Expected "' || e.link || '" but found "' || bt.link || '".'
    else 'Hyperlink "' || e.text || '" (' || e.link || ') is missing from the live page.' end as message
from e left join have h on h.pair_id = e.pair_id and h.key = e.key left join bu on bu.pair_id = e.pair_id and bu.link = e.link left join bt on bt.pair_id = e.pair_id and bt.tkey = e.tkey""")
def link_multiset(db: Tables):
    return K.match_links(*links(db)).where("family = 'link'").select("pair_id", "url", "seq", "check_type", "status", "expected", "actual", "message")


@query(f"""with {LNK}, w as (select pair_id, key, count(*) as m from e group by 1, 2)
select h.pair_id, h.url, cast(h.idx as int) as seq, 'Hyperlink (extra): "' || {d.preview10('h.text')} || '"' as check_type, 'warning' as status, h.shown as actual,
  'Hyperlink "' || h.text || '" (' || h.link || ') is present on the live page but not in the approved document.' as message
from have h left join w using (pair_id, key) where h.n > coalesce(w.m, 0)""")
def link_extras(db: Tables):
    return K.match_links(*links(db)).where("family = 'link_extra'").select("pair_id", "url", "seq", "check_type", "status", "actual", "message")


@query(f"""with b as (select pair_id, url, idx, text || ' ' || link as text, text = 'Buy' as head, text = 'Contact' as link from ({duck(I.LINKS)})),
k as (select *, {d.cmp('text')} as key from b), e as (select *, row_number() over (partition by pair_id, key order by idx) as occ from k where idx % 3 <> 0), a as (select * from k where idx % 4 <> 1),
have as (select pair_id, url, key, count(*) as n, min(idx) as idx, min_by(text, idx) as text from a group by 1, 2, 3), w as (select pair_id, key, count(*) as m from e group by 1, 2)
select e.pair_id, e.url, cast(e.idx as int) as seq, 'Bold: "' || {d.preview10('e.text')} || '"' as check_type, case when e.occ <= h.n or head then 'passed' when link then 'skipped' else 'failed' end as status,
  e.text as expected, case when e.occ <= h.n or head then e.text end as actual from e left join have h on h.pair_id = e.pair_id and h.key = e.key
union all select h.pair_id, h.url, cast(h.idx as int), 'Bold (extra): "' || {d.preview10('h.text')} || '"', 'warning', null, h.text from have h left join w using (pair_id, key) where h.n > coalesce(w.m, 0)""")
def bold_multiset(db: Tables):
    b = db.sql(I.LINKS).select(
        "pair_id", "url", "idx", F.concat("text", F.lit(" "), "link").alias("text"), (F.col("text") == "Buy").alias("head"), (F.col("text") == "Contact").alias("link")
    )
    out = K.match_bolds(b.where("idx % 3 <> 0"), b.where("idx % 4 <> 1").drop("head", "link"))
    return out.select("pair_id", "url", "seq", "check_type", "status", "expected", "actual")


# ---- corpus similarity ------------------------------------------------------



@query(f"""with b as (select item_id as e_id, {d.words(d.key('text'))} as w from benchmark),
l0 as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents),
l as (select struct_pack(doc_id := doc_id, n := n) as a_id, {d.words(d.key('line'))} as w from l0),
ew as (select e_id, len(w) as n, unnest(w) as w from b), aw as (select a_id, len(w) as n, unnest(w) as w from l),
hit as (select e_id, a_id, count(*) as shared, count(*) / greatest(min(ew.n), min(aw.n)) as score from ew join aw using (w) group by 1, 2)
select e_id, a_id.doc_id as doc_id, a_id.n as line_no, round(score, 6) as score from hit where shared >= 3 and score >= 0.65 qualify row_number() over (partition by e_id order by score desc, a_id) = 1""")
def similar_paragraphs_corpus(db: Tables):
    e = db.benchmark.select(F.col("item_id").alias("e_id"), t.content_key("text").alias("e_key"))
    a = db.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select(
        F.struct("doc_id", F.col("n").cast("long").alias("n")).alias("a_id"), t.content_key("line").alias("a_key")
    )
    found = similar_across_corpus(e, a)
    return found.select("e_id", F.col("a_id.doc_id").alias("doc_id"), F.col("a_id.n").alias("line_no"), F.round("score", 6).alias("score"))
