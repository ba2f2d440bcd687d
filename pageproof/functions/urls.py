"""URL resolution and canonical form as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageproof.functions.text import WS, _col, by_name, let

# ---- fixed values: campaign parameters that never change the destination ----
TRACKING_PARAMS = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id fbclid "
    "gclid msclkid mc_cid mc_eid ref source _ga yclid twclid"
).split()
NON_NAVIGATIONAL = "^(mailto:|tel:|javascript:|#)"
# Absolute, lower-case host without a port, a path of plain characters without a
# slash at its end: with no segment that starts with a dot, this is its own
# canonical form.
CANONICAL = r"^https?://[a-z0-9.-]+/[A-Za-z0-9._~/-]*[A-Za-z0-9._~-]\z"
# -----------------------------------------------------------------------------

_HTTP = r"^([a-zA-Z]+):/*([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _HTTP, group)


@by_name
def origin(url) -> Column:
    """scheme://host[:port], lower case, default port dropped."""

    def build(v: Column) -> Column:
        host = F.lower(_part(v, 2))
        return F.when(
            v.rlike("(?i)^http:"), F.concat(F.lit("http://"), F.regexp_replace(host, ":(80)?$", ""))
        ).otherwise(F.concat(F.lower(_part(v, 1)), F.lit("://"), F.regexp_replace(host, ":(443)?$", "")))

    return let(url, build)


def _encode_unsafe(c: Column) -> Column:
    """Percent-encode what a URL path may not hold, leaving the rest alone."""
    unsafe = r'[^\x21-\x7E]|["<>`{}^]'
    encode = lambda ch: F.when(
        ch.rlike(unsafe), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))
    ).otherwise(ch)
    return let(
        c, lambda v: F.when(v.rlike(unsafe), F.array_join(F.transform(F.split(v, ""), encode), "")).otherwise(v)
    )


def _collapse_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments; runs only where a path holds one."""
    empty = F.array().cast("array<string>")

    def fold(segments: Column) -> Column:
        n = F.size(segments)
        indexed = F.transform(segments, lambda s, i: F.struct(s.alias("s"), (i == n - 1).alias("last")))

        def step(acc: Column, seg: Column) -> Column:
            up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
            tail = F.when(seg["last"], F.array(F.lit(""))).otherwise(empty)
            return (
                F.when(seg["s"] == "..", F.concat(up, tail))
                .when(seg["s"] == ".", F.concat(acc, tail))
                .otherwise(F.concat(acc, F.array(seg["s"])))
            )

        return F.concat(F.lit("/"), F.array_join(F.aggregate(indexed, empty, step), "/"))

    parts = lambda p: F.split(F.substring(p, F.lit(2), F.length(p)), "/")
    return let(path, lambda p: F.when(p.rlike(r"/\.\.?(/|$)"), let(parts(p), fold)).otherwise(p))


def _clean_path(path: Column) -> Column:
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return _encode_unsafe(_collapse_dots(F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))))


def _absolute(href: Column, base: Column) -> Column:
    """Reference resolution before any cleaning; NULL when impossible. Both
    arguments must be lambda variables or plain columns."""
    base_path = F.coalesce(F.nullif(_part(base, 3), F.lit("")), F.lit("/"))
    query = F.coalesce(_part(base, 4), F.lit(""))
    site = origin(base)
    relative = (
        F.when(href.rlike(r"^[/\\]{2}"), F.concat(_part(base, 1), F.lit(":"), href))
        .when(href.rlike(r"^[/\\]"), F.concat(site, href))
        .when(href == "", F.concat(site, base_path, query))
        .when(href.startswith("?"), F.concat(site, base_path, href))
        .when(href.startswith("#"), F.concat(site, base_path, query, href))
        .otherwise(F.concat(site, F.regexp_replace(base_path, "[^/]*$", ""), href))
    )
    other_scheme = href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")
    return F.when(href.rlike("(?i)^https?:"), href).when(
        ~other_scheme & base.rlike("(?i)^https?://[^/?#]"), relative
    )


def _valid(url: Column) -> Column:
    host = _part(url, 2)
    return (host != "") & ~host.rlike(r"[\s<>^|%]")


def _spell(full: Column) -> Column:
    return F.concat(
        origin(full), _clean_path(_part(full, 3)), _encode_unsafe(_part(full, 4)), _encode_unsafe(_part(full, 5))
    )


def _resolved(href, base, spell) -> Column:
    """Trim, resolve, then spell; the trimmed input where that fails."""
    on_base = lambda h: lambda b: let(_absolute(h, b), lambda full: F.when(_valid(full), spell(full)))
    return let(_trim(_col(href)), lambda h: F.coalesce(let(base, on_base(h)), h))


@by_name
def link_href(url, base) -> Column:
    """The address a browser reports for a link, fragment included."""
    return _resolved(url, base, _spell)


@by_name
def resolve_url(url, base) -> Column:
    """Absolute http(s) URLs stay as written; others resolve on the base."""
    return let(url, lambda v: F.when(v.rlike("(?i)^https?://"), v).otherwise(link_href(v, base)))


def _clean_query(query: Column) -> Column:
    """Drop campaign parameters and sort the others by name, stably."""

    def pair(p: Column, i: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        value = F.when(p.contains("="), F.substring(p, F.length(name) + 2, F.length(p))).otherwise(F.lit(""))
        return F.struct(
            F.coalesce(F.try_url_decode(name), name).alias("name"),
            i.alias("i"),
            F.coalesce(F.try_url_decode(value), value).alias("value"),
        )

    tracking = F.array(*[F.lit(p) for p in TRACKING_PARAMS])
    raw = F.filter(F.split(F.substring(query, F.lit(2), F.length(query)), "&"), lambda p: p != "")
    kept = F.filter(F.transform(raw, pair), lambda p: ~F.array_contains(tracking, F.lower(p["name"])))
    spelled = F.transform(
        F.array_sort(kept), lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))
    )
    return let(
        F.array_join(spelled, "&"), lambda text: F.when(text == "", text).otherwise(F.concat(F.lit("?"), text))
    )


@by_name
def normalize_url(href, base) -> Column:
    """Canonical form for comparison: absolute, campaign-free, sorted query,
    no trailing slash, lower-case host, no fragment. What cannot be parsed or
    is not navigational comes back trimmed."""

    def spell(full: Column) -> Column:
        path = let(
            _clean_path(_part(full, 3)),
            lambda p: F.when(p != "/", F.regexp_replace(p, "/$", "")).otherwise(p),
        )
        return F.concat(origin(full), path, let(F.coalesce(_part(full, 4), F.lit("")), _clean_query))

    canonical = lambda h: h.rlike(CANONICAL) & ~h.contains("/.")
    # The test comes before the trimming, which costs as much as it does.
    return let(
        _col(href),
        lambda raw: F.when(canonical(raw), raw).otherwise(
            let(
                _trim(raw),
                lambda h: F.when(h.rlike(NON_NAVIGATIONAL), h).otherwise(_resolved(h, base, spell)),
            )
        ),
    )


def urls_equivalent(a, b, base) -> Column:
    return normalize_url(a, base) == normalize_url(b, base)


@by_name
def url_path(url) -> Column:
    url = _col(url)
    return F.when(url.rlike("(?i)^https?://"), _clean_path(_part(url, 3))).otherwise(url)


@by_name
def url_host(url) -> Column:
    return F.lower(_part(_col(url), 2))


@by_name
def link_type(link, page_url) -> Column:
    """Internal is a plain prefix test on the page's origin."""
    return F.when(_col(link).startswith(origin(page_url)), F.lit("Internal")).otherwise(F.lit("External"))
