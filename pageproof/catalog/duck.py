"""SQL fragments for the oracle engine, written independently of the library:
windows and plain string functions where the library works inside a row."""

from __future__ import annotations

from pageproof.functions.text import DOUBLE_QUOTES, SINGLE_QUOTES, STOPWORDS
from pageproof.functions.urls import TRACKING_PARAMS

WS = (
    r"[\s\x0b\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
)
INVISIBLE = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{180E}\x{FEFF}]"
BLOCKS = (
    "address|article|aside|blockquote|body|center|details|dialog|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "h[1-6]|header|hgroup|hr|html|legend|li|main|menu|nav|ol|p|pre|search|section|summary|table|tbody|td|tfoot|th|"
    "thead|tr|ul"
)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}', ' ', 'g'))"


def cmp(x: str) -> str:
    return f"lower({norm(x)})"


def quotes(x: str) -> str:
    to = "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES)
    return f"translate({x}, {lit(SINGLE_QUOTES + DOUBLE_QUOTES)}, {lit(to)})"


def edge(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[.,!?;:…]+', ''), '[.,!?;:…]+$', '')"


def key(x: str) -> str:
    return edge(quotes(cmp(x)))


def display(x: str) -> str:
    return edge(quotes(norm(x)))


def faq_key(x: str) -> str:
    return cmp(edge(quotes(f"coalesce({x}, '')")))


def preview10(x: str) -> str:
    words = f"string_split({norm(x)}, ' ')"
    return f"array_to_string({words}[1:10], ' ') || case when len({words}) > 10 then '…' else '' end"


def question_preview(x: str) -> str:
    q = f"replace({norm(x)}, '\"', '''')"
    cut = f"left({q}, 90)"
    whole = f"coalesce(nullif(regexp_replace({cut}, ' [^ ]*$', ''), ''), {cut})"
    return f"case when length({q}) <= 90 then {q} else {whole} || '…' end"


def words(k: str) -> str:
    stop = "[" + ", ".join(lit(w) for w in ["", *STOPWORDS]) + "]"
    bare = f"list_transform(string_split_regex({k}, '{WS}'), lambda w: regexp_replace(regexp_replace(w, '(?i)^[^a-z0-9]+', ''), '(?i)[^a-z0-9]+$', ''))"
    return f"list_filter(list_distinct({bare}), lambda w: not list_contains({stop}, w))"


def decode(x: str) -> str:
    """References found in the page table."""
    for ref, ch in (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {lit(ref)}, {lit(ch)})"
    return x


def tagless(x: str) -> str:
    return norm(decode(rf"regexp_replace({x}, '</?[a-zA-Z][^>]*>|<![^>]*>', '', 'g')"))


def live(x: str = "html") -> str:
    no_comments = rf"regexp_replace({x}, '<!--[\s\S]*?-->', '', 'g')"
    return (
        rf"regexp_replace({no_comments}, '(?i)<(?:script\b[^>]*>[\s\S]*?</script|style\b[^>]*>[\s\S]*?</style)\s*>', '', 'g')"
    )


def pieces(source: str = "pages") -> str:
    """CTEs cut and piece: page_id, url, n, piece, kind, in_scope."""
    return rf"""
cut0 as (select page_id, url, string_split(regexp_replace({live()}, '(?i)(</?(?:{BLOCKS})(?:[\s/][^>]*)?>)', chr(1) || '\1', 'g'), chr(1)) as parts from {source}),
cut as (select page_id, url, unnest(parts) as piece, generate_subscripts(parts, 1) as n from cut0),
kinds as (select *, lower(regexp_extract(piece, '^<(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) as kind from cut),
piece as (select *, sum(case kind when 'article' then 1 when '/article' then -1 else 0 end)
    over (partition by page_id order by n) > 0 as in_scope from kinds)"""


def origin(u: str) -> str:
    host = f"lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1))"
    return f"lower(regexp_extract({u}, '^([a-zA-Z]+)://', 1)) || '://' || {host}"


def enc(x: str) -> str:
    """Percent-encode non-ASCII and unsafe characters of a path."""
    chars = f"list_transform(string_split({x}, ''), lambda c: case when regexp_matches(c, '[^\\x21-\\x7E]|[\"<>`{{}}^]') then url_encode(c) else c end)"
    return f"array_to_string({chars}, '')"


def absolute(href: str, base: str) -> str:
    """Forms found in the page table: full, root-relative."""
    return f"case when regexp_matches({href}, '^https?://') then {href} when starts_with({href}, '/') then {origin(base)} || {href} else {href} end"


def link_href(href: str, base: str) -> str:
    a = absolute(href, base)
    return f"{origin(a)} || {enc(f'''coalesce(nullif(regexp_extract({a}, '^[a-zA-Z]+://[^/?#]*(.*)$', 1), ''), '/')''')}"


def normalize_url(href: str, base: str) -> str:
    a = absolute(f"trim({href})", base)
    path = f"coalesce(nullif(regexp_extract({a}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '/')"
    path = f"case when {path} <> '/' then regexp_replace({path}, '/$', '') else {path} end"
    query = f"regexp_extract({a}, '^[^?#]*\\?([^#]*)', 1)"
    tracking = "[" + ", ".join(lit(p) for p in TRACKING_PARAMS) + "]"
    kept = (
        f"list_filter(string_split({query}, '&'), lambda p: p <> '' and not list_contains({tracking}, lower(split_part(p, '=', 1))))"
    )
    q = f"array_to_string(list_sort({kept}), '&')"
    return (
        f"case when regexp_matches(trim({href}), '^(mailto:|tel:|javascript:|#)') then trim({href}) else "
        f"{origin(a)} || {enc(path)} || case when {q} = '' then '' else '?' || {q} end end"
    )
