"""Registered queries of the operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageproof.llm import bpe, centroids, fingerprints, langid, minhash, mixing, packing, prefixes, quality, secrets, substrings, toxicity, urlrules
from pageproof.llm.common import held_out, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return add


@query()
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


@query("""
with recursive cut as (
    select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
    from documents),
shingled as (
    select doc_id, list_distinct(case when len(w) < 2 then case when len(w) = 1 then [w[1]] else [] end
        else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s
    from cut),
one as (select min(doc_id) as rep, list_sort(s) as s from shingled where len(s) > 0 group by list_sort(s)),
items as (select rep, len(s) as n, unnest(s) as x from one),
pairs as (
    select a.rep as a, b.rep as b
    from items a join items b on a.x = b.x and a.rep < b.rep
    where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    group by a.rep, b.rep, a.n, b.n
    having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links as (select a, b from pairs union select b, a from pairs),
reach(a, b) as (select rep, rep from one union select r.a, l.b from reach r join links l on r.b = l.a),
least_of as (select a as rep, min(b) as component_id from reach group by a)
select d.doc_id, cast(len(d.s) as bigint) as n_shingles, coalesce(l.component_id, d.doc_id) as component_id,
    coalesce(l.component_id, d.doc_id) = d.doc_id as kept
from shingled d left join one o on len(d.s) > 0 and list_sort(d.s) = o.s left join least_of l on o.rep = l.rep
""")
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), size=2, percent=80)


@query()
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


@query("""
with cut as (
    select page_id,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
    from pages),
based as (
    select *, '.' || host as dotted, '|' || lower(regexp_replace(host || path, '[^A-Za-z0-9]+', '|', 'g')) || '|' as words,
        case
            when '.' || host like '%.example.net' and path like '/en/%' then 'example.net/en/'
            when '.' || host like '%.example.com' and path like '/de/%' then 'example.com/de/'
            when '.' || host like '%.org' and path like '/fr/%' then 'org/fr/'
            when '.' || host like '%.net' and path like '/%' then 'net/'
        end as rule
    from cut),
judged as (
    select *, case
        when rule is not null then null
        when regexp_matches(dotted || path, '^[^/]*[.]spam-farm[0-9]*[.]') then 'spam-farm'
        when regexp_matches(dotted || path, '^[^/]*[.]link-(farm|exchange)[0-9]*[.]') then 'link-farm'
        when regexp_matches(host || path, '^(ads?|adserver|doubleclick)[0-9]*[.][^/]+/(click|track|banner)') then 'ad-server'
        when regexp_matches(lower(path), '/(wp-login|wp-admin)([.]php|/|$)') then 'login-page'
        when regexp_matches(lower(path), '/[^/]*[.](exe|msi|apk)$') then 'download'
        else (select max('word:' || w) from unnest(['casino', 'porn', 'xxx', 'viagra', 'torrent', 'payday', 'escorts']) t(w)
              where contains(words, '|' || w || '|'))
    end as pattern_rule
    from based)
select page_id, host, path, rule,
    case when rule in ('net/', 'example.com/de/') or pattern_rule is not null then 'block' else 'allow' end as verdict,
    pattern_rule
from judged
""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"))


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = docs.select("doc_id", toxicity.score(F.col("text"), toxicity.learn(docs, labels)).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", langid.predict(F.col("text"), profiles).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@query("""
with cut as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
    from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 48)) as p from cut),
windows as (select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as h from starts),
seen as (select doc_id, p, min(doc_id) over (partition by h) as first_id from windows),
gone as (select distinct doc_id, unnest(range(p, p + 50)) as q from seen where first_id < doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as q from cut),
kept as (
    select doc_id, count(g.q) as n_removed,
        coalesce(string_agg(word, ' ' order by q) filter (g.q is null), '') as kept_text
    from words left join gone g using (doc_id, q) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
    sha256(coalesce(kept_text, '')) as kept_sha256
from cut left join kept using (doc_id)
""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query()
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def _rounds_sql(rounds: int) -> str:
    """Rounds of exact assignment and replacement, one pair of tables each."""
    gap = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(k.q, c.q)])"
    out = []
    for r in range(rounds + 1):
        out.append(f"""
a{r} as materialized (
    select row_id, vec_id, arg_min(c, (d, c)) as c, min(d) as d
    from (select k.row_id, k.vec_id, c.c, cast({gap} as bigint) as d from kept k, c{r} c) group by row_id, vec_id)""")
        if r < rounds:
            out.append(f"""
m{r} as (select c, i, sum(q[i]) as s, count(*) as n from a{r} join kept using (row_id), range(1, 65) t(i) group by c, i),
n{r} as (select c, list((s - (((s % n) + n) % n)) // n order by i) as q from m{r} group by c),
c{r + 1} as materialized (select c.c, coalesce(n{r}.q, c.q) as q from c{r} c left join n{r} using (c))""")
    return ",".join(out)


@query(f"""
with kept as materialized (
    select row_number() over () as row_id, vec_id, [cast(floor(256 * cast(x as double)) as hugeint) for x in embedding] as q
    from embeddings
    where len(embedding) = 64 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
c0 as materialized (
    select row_number() over (order by sha256('2:' || vec_id), q) - 1 as c, q
    from kept where vec_id is not null order by c limit 40),{_rounds_sql(5)},
final as (select c, sha256(array_to_string(q, ',')) as centroid_sha256 from c5)
select vec_id, cast(c as int) as cluster, d as distance,
    cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, centroid_sha256
from a5 join final using (c)
""")
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("""
with recursive ranked as (
    select conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as x,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
    from conversations where conv_id is not null),
convs as (select conv_id, list(x order by pos) as own, cast(conv_id as varchar) as digits from ranked group by conv_id),
crc as (
    select conv_id, digits, 1 as i, cast(4294967295 as bigint) as c from convs
    union all
    select conv_id, digits, i + 1, list_reduce([xor(c, cast(ascii(digits[i]) as bigint)), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, b: xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end))
    from crc where i <= length(digits)),
drawn as (select conv_id, xor(c, 4294967295) % 9 as h from crc where i = length(digits) + 1),
rebuilt as (
    select c.conv_id, coalesce(d.own[1:h], []) || coalesce(c.own[h + 1:], []) as turns
    from convs c join drawn using (conv_id) left join convs d on d.conv_id = c.conv_id - c.conv_id % 5),
members as (select conv_id, len(turns) as length, depth, turns[1:depth] as prefix from (select *, unnest(range(0, len(turns) + 1)) as depth from rebuilt)),
nodes as materialized (
    select md5(cast(prefix as varchar) || depth) as node, depth, any_value(prefix) as prefix, min(conv_id) as conv_id, count(*) as n_convs,
        sha256(coalesce(string_agg(conv_id, ',' order by conv_id) filter (length = depth), '')) as ends_sha256,
        coalesce(octet_length(encode(any_value(prefix)[depth].text)), 0) as bytes,
        md5(cast(any_value(prefix)[1:depth - 1] as varchar) || (depth - 1)) as parent
    from members group by prefix, depth),
counted as (
    select n.*, (select count(*) from nodes k where k.parent = n.node and k.depth = n.depth + 1) as n_children from nodes n),
above as (
    select node as spot, parent as up, depth, n_children = 0 as leaf, (n_convs - 1) * bytes as saved, node as of_node from counted
    union all
    select n.node, n.parent, n.depth, a.leaf, a.saved, a.of_node from above a join counted n on n.node = a.up where a.depth > 0),
sums as (select spot as node, count_if(leaf) as n_leaves, sum(saved) as saved_tokens from above group by spot)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, cast(s.n_leaves as bigint) as n_leaves,
    cast(s.saved_tokens as bigint) as saved_tokens, c.ends_sha256
from counted c join sums s using (node) left join nodes p on c.depth > 0 and p.node = c.parent
""")
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))
