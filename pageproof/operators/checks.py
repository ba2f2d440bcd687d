"""Rule checks: one expected value, one page, one result row.

Check rows meet page facts in a single left join on the resolved URL; every
check type is then a CASE over the joined row, picked by issue type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageproof.functions import text as t
from pageproof.functions import urls as u
from pageproof.operators import html as H

# ---- fixed values: labels, required tags, messages --------------------------
OG_REQUIRED = ("og:title", "og:description", "og:url", "og:image")
TWITTER_REQUIRED = ("twitter:card", "twitter:title", "twitter:description", "twitter:image")
FIELD_NAMES = {
    "title": "Meta title",
    "metaDescription": "Meta description",
    "canonical": "Canonical URL",
    "h1": "H1",
    "h2": "H2",
}
MODULES = ("redirect", "brokenLink", "accessibility", "performance")
REDIRECT_ADVICE = {
    200: ("PASS", "Page is accessible."),
    301: ("PASS", "Permanent redirect working correctly."),
    302: ("WARNING", "Temporary redirect found. Verify if a 301 redirect is expected."),
    404: ("FAIL", "Page not found. Restore the page or configure a 301 redirect."),
}
SERVER_ERROR = ("FAIL", "Server error detected. Check server configuration.")
UNEXPECTED = ("WARNING", "Unexpected HTTP response.")
# -----------------------------------------------------------------------------

DIFF_NONE = "array<struct<type:string,expected:string,actual:string>>"


def _result(status: Column, actual: Column, message: Column) -> Column:
    return F.struct(status.alias("status"), actual.alias("actual"), message.alias("message"))


def expected_or_presence(actual: Column, expected: Column, name: str) -> Column:
    """Missing, differing from a given expected value, or fine."""
    want = t.normalize_text(expected)

    def judge(value: Column) -> Column:
        differs = (want != "") & (F.lower(value) != F.lower(want))
        return _result(
            F.when((value == "") | differs, "failed").otherwise("passed"),
            value,
            F.when(value == "", f"{name} is missing.")
            .when(differs, f"{name} does not match the expected value.")
            .otherwise(f"{name} is valid."),
        )

    return t.let(t.normalize_text(actual), judge)


def image_alt(images: Column, expected: Column) -> Column:
    want = t.normalize_cmp(expected)
    alts = F.transform(images, lambda i: i["alt"])

    def judge(a: Column) -> Column:
        none = F.size(a) == 0
        present = F.exists(a, lambda x: F.lower(x) == want)
        lacking = F.size(F.filter(a, lambda x: x == ""))
        return _result(
            F.when(none, "skipped")
            .when(want != "", F.when(present, "passed").otherwise("failed"))
            .otherwise(F.when(lacking == 0, "passed").otherwise("failed")),
            F.array_join(F.filter(a, lambda x: x != ""), " | "),
            F.when(none, "No images found on the page.")
            .when(
                want != "",
                F.when(present, "Expected ALT text is present.").otherwise("Expected ALT text was not found on any image."),
            )
            .when(lacking == 0, "All images have ALT text.")
            .otherwise(F.concat(lacking.cast("string"), F.lit(" image(s) are missing ALT text."))),
        )

    return t.let(alts, judge)


def required_tags(tags: Column, expected: Column, required, family: str) -> Column:
    want = t.normalize_cmp(expected)

    def judge(m: Column) -> Column:
        content = lambda name: F.coalesce(F.get(F.filter(m, lambda x: x["name"] == name), F.lit(0))["content"], F.lit(""))
        shown = F.concat_ws(" | ", *[F.concat(F.lit(f"{r}="), content(r)) for r in required])
        missing = F.filter(F.array(*[F.when(content(r) == "", F.lit(r)) for r in required]), lambda r: r.isNotNull())
        present = F.exists(m, lambda x: F.lower(x["content"]) == want)
        return _result(
            F.when(F.when(want != "", present).otherwise(F.size(missing) == 0), "passed").otherwise("failed"),
            shown,
            F.when(
                want != "",
                F.when(present, f"Expected {family} value is present.").otherwise(f"Expected {family} value was not found."),
            )
            .when(F.size(missing) == 0, f"Required {family} tags are present.")
            .otherwise(F.concat(F.lit(f"Missing {family} tags: "), F.array_join(missing, ", "), F.lit("."))),
        )

    return t.let(tags, judge)


@t.by_name
def _built_in_checks() -> dict[str, Column]:
    e = F.col("expected")
    one = lambda kind, actual: expected_or_presence(actual, e, FIELD_NAMES[kind])
    return {
        "title": one("title", F.col("title")),
        "metaDescription": one("metaDescription", F.col("meta_description")),
        "canonical": one("canonical", F.col("canonical")),
        "h1": one("h1", F.col("h1_text")),
        "h2": one("h2", F.col("h2_text")),
        "imageAlt": image_alt(F.col("images"), e),
        "openGraph": required_tags(F.col("og_tags"), e, OG_REQUIRED, "Open Graph"),
        "twitterCard": required_tags(F.col("twitter_tags"), e, TWITTER_REQUIRED, "Twitter Card"),
    }


def check_registry() -> dict[str, Column]:
    """Check expressions by issue type, over page facts and ``expected``.

    To add a check, add an entry to the returned dict and pass it on: any
    expression giving (status, actual, message) from the joined row.
    """
    return dict(_built_in_checks())


def page_facts(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The narrow table field checks need, with the columns ``keep``; pages'
    markup stays behind."""
    full = H.with_body(H.with_head(pages))
    return full.select(
        "url",
        *keep,
        "title",
        H.meta_description().alias("meta_description"),
        "canonical",
        H.joined_headings(1).alias("h1_text"),
        H.joined_headings(2).alias("h2_text"),
        "images",
        H.prefixed_tags("property", "og:").alias("og_tags"),
        H.prefixed_tags("name", "twitter:").alias("twitter_tags"),
    )


def dispatch(rows: DataFrame, registry=None) -> DataFrame:
    """Add ``family``: field, one of the modules, or unsupported."""
    names = list(registry or check_registry())
    kind = F.col("issue_type")
    return rows.withColumn(
        "family",
        F.when(kind.isin(*names), "field").when(kind.isin(*MODULES), kind).otherwise("unsupported"),
    )


def field_results(joined: DataFrame, registry=None) -> DataFrame:
    """Results of dispatched field rows joined with page facts; ``load_error``
    set means the page never loaded."""
    registry = registry or check_registry()
    picked = F
    for kind, judged in registry.items():
        picked = picked.when(F.col("issue_type") == kind, judged)
    failed = F.col("load_error").isNotNull()
    return joined.withColumn("_r", F.when(~failed, picked)).select(
        *[c for c in ("sheet_id", "source_row_number") if c in joined.columns],
        F.col("resolved_url").alias("url") if "resolved_url" in joined.columns else F.col("url"),
        "check_type",
        F.when(failed, "failed").otherwise(F.col("_r.status")).alias("status"),
        "expected",
        F.col("_r.actual").alias("actual"),
        F.when(failed, F.concat(F.lit("Unable to load the page for SEO validation: "), "load_error"))
        .otherwise(F.col("_r.message"))
        .alias("message"),
    )


def skipped_rows(dispatched: DataFrame, accessibility: bool = True, performance: bool = True) -> DataFrame:
    """Rows that produce no result, with the reason."""
    fam, failed = F.col("family"), F.col("load_error").isNotNull()
    why = (
        F.when((fam == "performance") & F.lit(not performance), F.lit("Lighthouse checks are disabled for this run."))
        .when(
            (fam == "brokenLink") & failed,
            F.concat(F.lit("Unable to load the page to scan for broken links: "), "load_error"),
        )
        .when(
            (fam == "accessibility") & failed,
            F.concat(F.lit("Unable to load the page to run an accessibility scan: "), "load_error"),
        )
        .when((fam == "accessibility") & F.lit(not accessibility), F.lit("Accessibility checks are disabled for this run."))
        .when(
            fam == "unsupported",
            F.concat(F.lit('No SEO check is implemented for issue type "'), "issue_type", F.lit('".')),
        )
    )
    return dispatched.withColumn("reason", why).where("reason is not null")


def module_urls(
    dispatched: DataFrame,
    accessibility: bool = True,
    performance: bool = True,
    always_redirect: bool = False,
    always_links: bool = False,
    always_accessibility: bool = False,
    performance_urls: DataFrame | None = None,
) -> DataFrame:
    """(url, module) once per URL: asked for by rows, or forced by options.

    A module needing a loaded page skips URLs with ``load_error``; a switch
    turns row requests off but not forced runs. ``performance_urls(url)``
    limits forced performance runs to listed URLs, trimmed on both sides.
    """
    loaded = F.col("load_error").isNull()
    asked = dispatched.where(F.col("family").isin(*MODULES)).where(
        F.when(F.col("family") == "performance", F.lit(performance))
        .when(F.col("family") == "accessibility", loaded & F.lit(accessibility))
        .when(F.col("family") == "brokenLink", loaded)
        .otherwise(F.lit(True))
    )
    wanted = asked.select("url", F.col("family").alias("module"))
    forced = [
        F.when(F.lit(always_redirect), "redirect"),
        F.when(F.lit(always_links) & loaded, "brokenLink"),
        F.when(F.lit(always_accessibility) & loaded, "accessibility"),
    ]
    every = dispatched.select("url", F.explode(F.array(*forced)).alias("module")).where("module is not null")
    wanted = wanted.unionByName(every)
    if performance_urls is not None:
        listed = performance_urls.select(F.trim("url").alias("_u")).distinct()
        chosen = dispatched.withColumn("_u", F.trim("url")).join(listed, "_u", "left_semi")
        wanted = wanted.unionByName(chosen.select("url", F.lit("performance").alias("module")))
    return wanted.distinct()


def redirect_results(log: DataFrame) -> DataFrame:
    """Classify probe log rows; an error is a failure with status 0."""
    s, err = F.col("status"), F.col("error").isNotNull()

    def pick(i: int) -> Column:
        out = F
        for code, values in REDIRECT_ADVICE.items():
            out = out.when(s == code, values[i])
        return out.when(s >= 500, SERVER_ERROR[i]).otherwise(UNEXPECTED[i])

    hops = F.when(F.col("final_url") != F.col("url"), 1).otherwise(0)
    zero = lambda c: F.when(err, 0).otherwise(c)
    return log.select(
        F.col("url").alias("original_url"),
        F.when(err, "").otherwise(F.col("final_url")).alias("final_url"),
        zero(s).cast("int").alias("status_code"),
        zero(hops).cast("int").alias("redirect_count"),
        zero(F.col("response_ms")).cast("bigint").alias("response_time"),
        F.when(err, "FAIL").otherwise(pick(0)).alias("result"),
        F.when(err, F.col("error")).otherwise(pick(1)).alias("recommendation"),
    )


def link_results(links: DataFrame, log: DataFrame) -> DataFrame:
    """Links (page_url, link) against the probe log (url, status, error). A
    link absent from the log counts as unreachable. Popular targets make a hot
    key on the links' side only; the log has one row per URL."""
    probed = log.select(F.col("url").alias("link"), F.when(F.col("error").isNull(), F.col("status")).alias("_s"))
    ok = F.col("_s").between(200, 399)
    return links.join(probed, "link", "left").select(
        "page_url",
        "link",
        u.link_type("link", "page_url").alias("link_type"),
        F.coalesce("_s", F.lit(0)).cast("int").alias("status_code"),
        F.when(ok, "PASS").otherwise("FAIL").alias("status"),
        F.when(ok, "Working").when(F.col("_s").isNull(), "Unable to connect").otherwise("Broken Link").alias("message"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Every a[href] as an absolute address, duplicates kept."""
    return H.with_body(pages).select("url", F.explode("anchors").alias("a")).select(
        F.col("url").alias("page_url"), u.link_href(F.col("a.href"), F.col("url")).alias("link")
    )


# ---- batch input and re-run rules -------------------------------------------


def duplicate_batch_urls(items: DataFrame) -> DataFrame:
    """Second and later spellings of one page within a batch:
    items(batch_id, idx, url). The first spelling per page is found by a
    partial minimum, so no batch is sorted in one task."""
    keyed = items.withColumn("url", F.trim("url")).withColumn("page", u.normalize_url("url", "url"))
    first = keyed.groupBy("batch_id", "page").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, ["batch_id", "page"]).where("idx > first_idx").select("batch_id", "url").distinct()


def batch_rejects(batches: DataFrame, items: DataFrame, max_size: int = 8, extension: str = ".docx") -> DataFrame:
    """First failing rule per batch: batches(batch_id, n_files, n_urls) and
    items(batch_id, idx, filename, url)."""
    bad_name = ~F.lower("filename").endswith(extension)
    per = items.groupBy("batch_id").agg(
        F.count_if(bad_name).alias("bad_names"), F.count_if(F.trim("url") == "").alias("blank_urls")
    )
    dup = duplicate_batch_urls(items).groupBy("batch_id").agg(F.count("*").alias("dup_urls"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = (
        F.when(F.col("n_files") == 0, "no files")
        .when(n("bad_names") > 0, "wrong extension")
        .when(F.col("n_urls") != F.col("n_files"), "count mismatch")
        .when(n("blank_urls") > 0, "blank url")
        .when(n("dup_urls") > 0, "duplicate url")
        .when(F.col("n_files") > max_size, "batch too large")
    )
    return (
        batches.join(per, "batch_id", "left")
        .join(dup, "batch_id", "left")
        .withColumn("reason", reason)
        .where("reason is not null")
        .select("batch_id", "reason")
    )


def rerun_eligibility(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """Why each asked id (ids: id) can not be re-run; NULL when it can. Only
    the flag of the stored content is read, not the content."""
    known = runs.select("id", "type", "filename", "url", F.col("expected_content").isNotNull().alias("_stored"))
    name = F.concat(F.lit('"'), "filename", F.lit('"'))
    reason = (
        F.when(F.col("type").isNull(), F.concat(F.lit("Audit "), "id", F.lit(" was not found.")))
        .when(F.col("type") != "blog", F.concat(name, F.lit(" is not a blog audit.")))
        .when(F.coalesce("url", F.lit("")) == "", F.concat(name, F.lit(" has no live URL on record.")))
        .when(
            ~F.col("_stored"),
            F.concat(name, F.lit(" was tested before re-running was supported — upload it once more to enable this.")),
        )
    )
    return ids.join(known, "id", "left").select("id", reason.alias("reason"))


def repeated_upload_urls(items: DataFrame) -> DataFrame:
    """Form check on (form_id, url): trimmed, lower case, no trailing slashes."""
    key = F.regexp_replace(F.lower(F.trim("url")), "/+$", "")
    return (
        items.withColumn("key", key).where("key <> ''").groupBy("form_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    )
