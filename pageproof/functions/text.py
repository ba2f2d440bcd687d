"""Text normalisation as Column expressions (no Python runs per row)."""

from __future__ import annotations

import functools
import html.entities
import json

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: must equal the audited tool's for equal results ----------
# ECMAScript white space, spelled out because Java's \s misses NBSP and friends.
WS = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
SINGLE_QUOTES = "‘’‚‛"
DOUBLE_QUOTES = "“”„‟"
EDGE_PUNCT = r"[.,!?;:…]+"
INVISIBLE = r"[\u200B\u200C\u200D\u2060\u180E\uFEFF]"
SITE_SEPARATORS = (" - ", " – ", " — ", " | ")
STOPWORDS = (
    "a an and are as at be been but by can did do for from get has have here "
    "i in is it its just my no not of on or our out so that the their them "
    "there these they this to up us was we were which who will with you your"
).split()
# -----------------------------------------------------------------------------


def by_name(builder):
    """Build an expression once per process when all arguments are plain
    values (column names, numbers): unresolved expressions can be shared, and
    building large ones costs more driver time than running small jobs."""
    cache: dict = {}

    @functools.wraps(builder)
    def wrapped(*args, **kwargs):
        plain = all(isinstance(a, (str, int, float, bool, type(None))) for a in (*args, *kwargs.values()))
        if not plain:
            return builder(*args, **kwargs)
        key = (id(SparkContext._jvm), args, tuple(sorted(kwargs.items())))
        if key not in cache:
            cache[key] = builder(*args, **kwargs)
        return cache[key]

    return wrapped


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """Bind a value to a lambda variable, so an expression that reads it many
    times is computed once and its tree stays small."""
    return F.get(F.transform(F.array(_col(value)), body), F.lit(0))


@by_name
def normalize_text(c) -> Column:
    """Collapse white space to single spaces and trim; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), WS + "+", " "))


@by_name
def normalize_cmp(c) -> Column:
    return F.lower(normalize_text(c))


def normalize_quotes(c) -> Column:
    return F.translate(
        _col(c),
        SINGLE_QUOTES + DOUBLE_QUOTES,
        "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES),
    )


def strip_edge_punct(c) -> Column:
    return F.regexp_replace(_col(c), f"^{EDGE_PUNCT}|{EDGE_PUNCT}$", "")


@by_name
def content_key(c) -> Column:
    """Equality key of headings, paragraphs and single values."""
    return strip_edge_punct(normalize_quotes(normalize_cmp(c)))


@by_name
def content_display(c) -> Column:
    """Case-preserving counterpart of :func:`content_key`, used in diffs."""
    return strip_edge_punct(normalize_quotes(normalize_text(c)))


@by_name
def faq_key(c) -> Column:
    """Question/answer key: punctuation is stripped before white space."""
    return normalize_cmp(strip_edge_punct(normalize_quotes(F.coalesce(_col(c), F.lit("")))))


def code_point(n) -> Column:
    """Character for a code point; NULL outside Unicode's range."""
    n = _col(n)
    return F.when(
        (n >= 0) & (n <= 0x10FFFF),
        F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"),
    )


def _replace_refs(c: Column, cut: str, marker: str, find, char) -> Column:
    """Cut at each reference marker and decode the pieces one by one; the
    piece keeps its marker when ``char`` finds nothing for it."""

    def piece(p: Column, i: Column) -> Column:
        def decode(ref: Column) -> Column:
            decoded = F.concat(char(ref), F.substring(p, F.length(ref) + 2, F.length(p)))
            return F.coalesce(F.when(ref != "", decoded), F.concat(F.lit(marker), p))

        return F.when(i == 0, p).otherwise(let(find(p), decode))

    return F.array_join(F.transform(F.split(c, cut), piece), "")


def _numeric_refs(c: Column, marker: str, digits: str, base: int) -> Column:
    cut = marker.replace("x", "[xX]")
    find = lambda p: F.regexp_extract(p, f"^(0*{digits}{{1,9}});", 1)
    char = lambda ref: let(F.conv(ref, base, 10).cast("bigint"), code_point)
    return let(
        c,
        lambda v: F.when(v.rlike(f"{cut}{digits}+;"), _replace_refs(v, cut, marker, find, char)).otherwise(v),
    )


@by_name
def decode_entities(c) -> Column:
    """Five named references in fixed order, then decimal, then hexadecimal."""
    out = _col(c)
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(name), F.lit(char))
    out = _numeric_refs(out, "&#", "[0-9]", 10)
    return _numeric_refs(out, "&#x", "[0-9a-fA-F]", 16)


# Named references come from the Python standard library's HTML 4 table.
_NAMED = json.dumps({**{k: chr(v) for k, v in html.entities.name2codepoint.items()}, "apos": "'"})


@by_name
def decode_markup(c) -> Column:
    """Single-pass reference decoding, the way a page's DOM text reads."""
    named = F.from_json(F.lit(_NAMED), "map<string,string>")
    find = lambda p: F.regexp_extract(p, "^(#0*[0-9]{1,8}|#[xX]0*[0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);", 1)

    def char(ref: Column) -> Column:
        n = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, F.lit(3), F.length(ref)), 16, 10)).otherwise(F.substring(ref, F.lit(2), F.length(ref)))
        return F.when(ref.startswith("#"), let(n.try_cast("bigint"), code_point)).otherwise(named[ref])

    return let(c, lambda v: F.when(v.contains("&"), _replace_refs(v, "&", "&", find, char)).otherwise(v))


def strip_tags(c) -> Column:
    return F.regexp_replace(_col(c), "<[^>]+>", "")


@by_name
def html_to_text(c) -> Column:
    """Rendered text of a brief fragment; invisible characters go last."""
    body = strip_tags(F.regexp_replace(_col(c), r"(?i)<br\s*/?>", " "))
    return F.regexp_replace(normalize_text(decode_entities(body)), INVISIBLE, "")


@by_name
def markup_text(c) -> Column:
    """Text content of a page fragment: tags vanish, references decode."""
    return normalize_text(decode_markup(strip_tags(c)))


def normalize_label(c) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "")


def is_url(c) -> Column:
    return _col(c).rlike(r"(?i)^https?://\S+$")


@by_name
def preview10(c) -> Column:
    def cut(words: Column) -> Column:
        head = F.array_join(F.slice(words, 1, 10), " ")
        return F.when(F.size(words) > 10, F.concat(head, F.lit("…"))).otherwise(head)

    return let(F.split(normalize_text(c), " "), cut)


@by_name
def question_preview(c, limit: int = 90) -> Column:
    def cut(text: Column) -> Column:
        head = F.substring(text, 1, limit)
        kept = F.coalesce(F.nullif(F.regexp_replace(head, " [^ ]*$", ""), F.lit("")), head)
        return F.when(F.length(text) <= limit, text).otherwise(F.concat(kept, F.lit("…")))

    return let(F.replace(normalize_text(c), F.lit('"'), F.lit("'")), cut)


def strip_decoration(c) -> Column:
    return F.regexp_replace(_col(c), "(?i)^[^a-z0-9]+|[^a-z0-9]+$", "")


@by_name
def heading_contained(a, b) -> Column:
    either = lambda x: lambda y: (F.length(x) >= 4) & (F.length(y) >= 4) & (y.contains(x) | x.contains(y))
    return let(strip_decoration(a), lambda x: let(strip_decoration(b), either(x)))


@by_name
def content_words(key) -> Column:
    """Distinct words of a normalised text, edge symbols and stopwords gone."""
    words = F.transform(F.split(_col(key), WS + "+"), strip_decoration)
    stop = F.array(*[F.lit(w) for w in ["", *STOPWORDS]])
    return F.array_except(F.array_distinct(words), stop)


@by_name
def has_site_suffix(expected_key, actual_key) -> Column:
    e, a = _col(expected_key), _col(actual_key)
    hits = [a.startswith(F.concat(e, F.lit(s))) & (F.length(a) > F.length(e) + len(s)) for s in SITE_SEPARATORS]
    any_hit = hits[0]
    for h in hits[1:]:
        any_hit = any_hit | h
    return (e != "") & any_hit


@by_name
def answer_contains(haystack, needle) -> Column:
    return let(faq_key(needle), lambda n: (n != "") & faq_key(haystack).contains(n))


def slug_segment(c) -> Column:
    return F.regexp_replace(F.lower(F.trim(_col(c))), "^/+|/+$", "")


def basename(path) -> Column:
    return F.element_at(F.split(F.replace(_col(path), F.lit("\\"), F.lit("/")), "/"), -1)


@by_name
def source_slug(path) -> Column:
    """File stem as a hyphenated name of at most 60 characters."""
    stem = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    spaced = F.trim(F.regexp_replace(F.regexp_replace(stem, "[^a-zA-Z0-9]", " "), r"\s+", " "))
    return F.regexp_replace(F.substring(F.replace(spaced, F.lit(" "), F.lit("-")), 1, 60), "-+$", "")


def download_slug(filename) -> Column:
    bare = F.regexp_replace(_col(filename), r"\.[^.]+$", "")
    return F.substring(F.regexp_replace(bare, "[^a-zA-Z0-9_-]+", "-"), 1, 60)


def history_file_name(path) -> Column:
    return F.regexp_replace(basename(path), "[^a-zA-Z0-9._-]+", "_")


def compact_timestamp(iso) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(iso), "[:.]", "-"), r"-\d{3}-?\w*$", "")


def score_pct(score) -> Column:
    """0-1 score as a whole percentage, halves rounded up; NULL stays NULL."""
    return F.floor(_col(score) * 100 + 0.5).cast("int")


@by_name
def md_cell(c) -> Column:
    out = F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(out, r"\r?\n", "<br>")


def md_row(*cells) -> Column:
    cols = [md_cell(c.cast("string") if isinstance(c, Column) else c) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |"))


def html_escape(c) -> Column:
    out = _col(c)
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(ref))
    return out
