"""Schema inference and row normalisation over a table of sheet cells.

Cells are grouped into rows once, by (sheet, row): a group is as wide as one
row. Header and column roles come from each sheet's first ten filled rows and
make one small profile row per sheet; data rows meet their profile at
(sheet, segment), so a sheet holding a third of all rows still spreads.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageproof.functions import text as t
from pageproof.operators.ordered import SEGMENT_ROWS

# ---- fixed values: header aliases, detectors and issue patterns, in order ---
FAMILIES = {
    "url": "url|page url|source page url|page|address|landing page|target url|source url|current url|live url"
    "|url to check|url to audit",
    "checkType": "issue|issue type|check|check type|seo issue|problem|recommendation|task|fix",
    "expectedValue": "expected|expected value|expected result|new value|recommended value",
    "actualValue": "actual|actual value|current|current value|found value|existing value",
    "severity": "severity|priority|impact",
    "notes": "notes|note|comment|comments|details|description",
}
ISSUE_TYPES = [
    ("metaDescription", r"meta\s*description|\bdescription\b"),
    ("redirect", r"redirect|\b30[1278]\b"),
    ("brokenLink", r"broken\s*links?|dead\s*links?|link\s*rot|\b404\b|\b50[0234]\b"),
    ("statusCode", r"status\s*code"),
    ("accessibility", r"accessib|\baxe\b|\bwcag\b|\ba11y\b|screen\s*reader"),
    ("performance", r"performance|\blighthouse\b|page\s*speed|core\s*web\s*vitals?|\b(?:lcp|cls|ttfb|fcp|tbt)\b"),
    ("imageAlt", r"image\s*alt|\balt\s*text\b"),
    ("faq", r"\bfaq\b|faqs|accordion"),
    ("structuredData", r"structured\s*data|schema|json-ld"),
    ("openGraph", r"open\s*graph|\bog:"),
    ("twitterCard", r"twitter\s*card|twitter:"),
    ("internalLinks", r"internal\s*links?|\binlinks?\b"),
    ("canonical", r"canonical"),
    ("hreflang", r"hreflang"),
    ("sitemap", r"sitemap"),
    ("robots", r"robots"),
    ("noindex", r"noindex"),
    ("title", r"\btitle\b|title\s*tag"),
    ("h1", r"\bh1\b|heading\s*1"),
    ("h2", r"\bh2\b|heading\s*2"),
]
# Wherever a pattern of ISSUE_TYPES is found, so is one of these in the value in
# lower case: long texts are searched for them first, which costs far less.
NEEDLES = {
    "metaDescription": "description",
    "redirect": "redirect|30",
    "brokenLink": "link|404|50",
    "statusCode": "status",
    "accessibility": "accessib|axe|wcag|a11y|screen",
    "performance": "performance|lighthouse|speed|vital|lcp|cls|ttfb|fcp|tbt",
    "imageAlt": "alt",
    "faq": "faq|accordion",
    "structuredData": "structured|schema|json-ld",
    "openGraph": "graph|og:",
    "twitterCard": "twitter",
    "internalLinks": "link",
    "canonical": "canonical",
    "hreflang": "hreflang",
    "sitemap": "sitemap",
    "robots": "robots",
    "noindex": "noindex",
    "title": "title",
    "h1": "h1|heading",
    "h2": "h2|heading",
}
RECOMMENDATIONS = [
    ("metaDescription", "Meta Description", r"meta\s*description"),
    ("canonical", "Canonical Tag", r"canonical"),
    ("redirect", "Redirect", r"redirect"),
    ("brokenLink", "Broken Link Check", r"broken\s*links?|dead\s*links?|link\s*check"),
    ("openGraph", "Open Graph", r"open\s*graph|\bog[\s:_-]"),
    ("twitterCard", "Twitter Card", r"twitter"),
    ("imageAlt", "Image Alt Text", r"image\s*alt|alt\s*text|\balt\b"),
    ("h1", "H1", r"\bh1\b|heading\s*1"),
    ("h2", "H2", r"\bh2\b|heading\s*2"),
    ("title", "Meta Title", r"meta\s*title|title\s*tag|\btitle\b"),
]
MEASUREMENT = r"\b(?:chars?|count|length|current|existing)\b"
SEVERITIES = ("low", "medium", "high", "critical")
HEADER_ROWS = 10
# -----------------------------------------------------------------------------


def first_match(value: Column, table, default: str | None = None) -> Column:
    """Name of the first (name, pattern) entry found in the value."""
    out = F
    for name, pattern in table:
        out = out.when(value.rlike(f"(?i){pattern}"), F.lit(name))
    return out.otherwise(F.lit(default)) if default is not None else out


@t.by_name
def issue_type(value) -> Column:
    def build(v: Column, low: Column) -> Column:
        out = F
        for name, pattern in ISSUE_TYPES:
            likely = reduce(or_, [low.contains(needle) for needle in NEEDLES[name].split("|")])
            out = out.when(likely & v.rlike(f"(?i){pattern}"), F.lit(name))
        return out.otherwise(F.lit("unknown"))

    return t.let(value, lambda v: t.let(F.lower(v), lambda low: build(v, low)))


def alias_family(header: Column) -> Column:
    aliases = {a.replace(" ", ""): fam for fam, names in FAMILIES.items() for a in names.split("|")}
    table = F.from_json(F.lit(json.dumps(aliases)), "map<string,string>")
    return table[t.normalize_label(header)]


def recommended_field(header: Column) -> Column:
    """Issue type of a recommendation header, NULL for measurements."""
    found = first_match(header, [(k, p) for k, _, p in RECOMMENDATIONS])
    return F.when(~header.rlike(f"(?i){MEASUREMENT}"), found)


def recommended_label(kind: Column) -> Column:
    table = F.from_json(F.lit(json.dumps({k: label for k, label, _ in RECOMMENDATIONS})), "map<string,string>")
    return table[kind]


def severity(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(*SEVERITIES), low)


def sheet_rows(cells: DataFrame) -> DataFrame:
    """One row per sheet row with any filled cell; ``cells`` is ordered by
    column and holds trimmed text."""
    value = F.trim(F.coalesce("value", F.lit("")))
    item = F.struct(F.col("col_no").cast("int").alias("col"), value.alias("v"), F.col("hyperlink").alias("h"))
    return (
        cells.groupBy("sheet_id", "row_no")
        .agg(F.array_sort(F.collect_list(item)).alias("cells"))
        .where(F.exists("cells", lambda c: c["v"] != ""))
    )


@t.by_name
def header_score() -> Column:
    """Alias families named by a row, plus one for any recommendation."""
    families = F.filter(F.transform("cells", lambda c: alias_family(c["v"])), lambda f: f.isNotNull())
    recs = F.exists("cells", lambda c: (c["v"] != "") & recommended_field(c["v"]).isNotNull())
    return F.size(F.array_distinct(families)) + recs.cast("int")


def header_candidates(rows: DataFrame) -> DataFrame:
    """First ten filled rows of each sheet with index and header score. The
    row limit per sheet is applied before the shuffle as well as after."""
    top = Window.partitionBy("sheet_id").orderBy("row_no")
    early = rows.withColumn("_rn", F.row_number().over(top)).where(F.col("_rn") <= HEADER_ROWS)
    return early.select(
        "sheet_id",
        "row_no",
        (F.col("_rn") - 1).alias("header_index"),
        "cells",
        header_score().alias("score"),
    )


@t.by_name
def _profile_columns() -> list:
    roles = F.filter(
        F.transform("cells", lambda c: F.struct(alias_family(c["v"]).alias("role"), c["col"].alias("col"), c["v"].alias("v"))),
        lambda r: r["role"].isNotNull(),
    )
    recs = F.filter(
        F.transform(
            "cells",
            lambda c: F.struct(
                c["col"].alias("col"),
                c["v"].alias("header"),
                F.when(c["v"] != "", recommended_field(c["v"])).alias("issue_type"),
            ),
        ),
        lambda r: r["issue_type"].isNotNull(),
    )
    names = F.transform(
        "cells",
        lambda c: F.struct(
            F.when(c["v"] == "", F.concat(F.lit("Column "), (c["col"] + 1).cast("string"))).otherwise(c["v"]).alias("name"),
            c["col"].alias("col"),
        ),
    )
    later = lambda n, i: F.exists(F.slice("_names", i + 2, F.size("_names")), lambda m: m["name"] == n["name"])
    role = lambda r: F.get(F.filter("_roles", lambda x: x["role"] == r), F.lit(0))
    mode = (
        F.when(F.size("rec_fields") >= 2, "recommendation")
        .when(F.col("checkType_col").isNotNull(), "issueBased")
        .when((F.size("rec_fields") >= 1) & F.col("url_col").isNotNull(), "recommendation")
        .otherwise("issueBased")
    )
    shown = F.filter("_roles", lambda r: (F.col("mode") != "recommendation") | (r["role"] == "url"))
    first = F.filter(shown, lambda r: ~F.exists("_roles", lambda q: (q["role"] == r["role"]) & (q["col"] < r["col"])))
    return [
        {"_roles": roles, "rec_fields": recs, "_names": names},
        {
            **{f"{r}_col": role(r)["col"] for r in FAMILIES},
            # A repeated header keeps its last column.
            "raw_names": F.filter("_names", lambda n, i: ~later(n, i)),
        },
        {"mode": mode},
        {"detected": F.map_from_entries(F.transform(first, lambda r: F.struct(r["role"].alias("k"), r["v"].alias("v"))))},
    ]


def sheet_profiles(rows: DataFrame) -> DataFrame:
    """One row per sheet with a usable header: where it is, which column
    plays which role, and the sheet's mode."""
    picked = (
        header_candidates(rows)
        .where("score > 0")
        .groupBy("sheet_id")
        .agg(F.min_by(F.struct("row_no", "header_index", "cells", "score"), F.struct(-F.col("score"), F.col("row_no"))).alias("x"))
        .select("sheet_id", "x.*")
    )
    step = picked
    for columns in _profile_columns():
        step = step.withColumns(columns)
    return step.drop("_roles", "_names", "cells").withColumnRenamed("row_no", "header_row_no")


def data_rows(rows: DataFrame, profiles: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Rows below the header with their profile and ``source_row_number``,
    which counts filled rows only. Count and profile arrive in one join, on
    (sheet, segment)."""
    cut = rows.withColumn("_seg", F.floor(F.col("row_no") / segment_rows).cast("bigint"))
    before = Window.partitionBy("sheet_id").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    segments = (
        cut.groupBy("sheet_id", "_seg")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
        .join(profiles, "sheet_id")
    )
    local = F.row_number().over(Window.partitionBy("sheet_id", "_seg").orderBy("row_no"))
    return (
        cut.withColumn("_rn", local)
        .join(segments, ["sheet_id", "_seg"])
        .where(F.col("row_no") > F.col("header_row_no"))
        .withColumn("source_row_number", (F.col("_rn") + F.col("_before")).cast("int"))
        .drop("_seg", "_rn", "_before")
    )


def _cell(col: Column) -> Column:
    """Filled text of a column, else NULL."""
    return F.nullif(F.get(F.filter("cells", lambda c: c["col"] == col), F.lit(0))["v"], F.lit(""))


def _first_cell(test) -> Column:
    return F.get(F.filter("cells", test), F.lit(0))["v"]


@t.by_name
def raw_map() -> Column:
    return F.map_from_entries(
        F.transform(
            "raw_names",
            lambda n: F.struct(n["name"].alias("k"), F.coalesce(_cell(n["col"]), F.lit("")).alias("v")),
        )
    )


@t.by_name
def row_url() -> Column:
    """The URL column's cell; rows are searched only when no such column."""
    return F.when(F.col("url_col").isNotNull(), _cell(F.col("url_col"))).otherwise(_first_cell(lambda c: t.is_url(c["v"])))


def issue_rows(data: DataFrame) -> DataFrame:
    """Audit rows of issue-based sheets; needs a URL and a check name."""
    inferred = _first_cell(
        lambda c: (c["v"] != "") & ~t.is_url(c["v"]) & ~c["col"].eqNullSafe(F.col("url_col"))
    )
    step = data.where("mode = 'issueBased'").withColumns(
        {"raw": raw_map(), "url": row_url(), "check_type": F.coalesce(_cell(F.col("checkType_col")), inferred)}
    )
    step = step.where(F.col("url").isNotNull() & F.col("check_type").isNotNull())
    words = [F.nullif(F.col("raw")[k], F.lit("")) for k in ("Notes", "Description", "Details")]
    return step.select(
        "sheet_id",
        "url",
        "check_type",
        issue_type(F.concat_ws(" ", "check_type", *words)).alias("issue_type"),
        _cell(F.col("expectedValue_col")).alias("expected"),
        _cell(F.col("actualValue_col")).alias("actual"),
        severity(_cell(F.col("severity_col"))).alias("severity"),
        _cell(F.col("notes_col")).alias("notes"),
        "source_row_number",
        "raw",
    )


def recommendation_rows(data: DataFrame) -> DataFrame:
    """Audit rows of recommendation sheets: one per filled suggestion."""
    none = F.lit(None).cast("string")
    step = (
        data.where("mode = 'recommendation'")
        .withColumns({"raw": raw_map(), "url": row_url()})
        .where(F.col("url").isNotNull())
        .withColumn("f", F.explode("rec_fields"))
        .withColumn("expected", _cell(F.col("f.col")))
        .where(F.col("expected").isNotNull())
    )
    return step.select(
        "sheet_id",
        "url",
        recommended_label(F.col("f.issue_type")).alias("check_type"),
        F.col("f.issue_type").alias("issue_type"),
        "expected",
        none.alias("actual"),
        none.alias("severity"),
        none.alias("notes"),
        "source_row_number",
        "raw",
    )


def audit_rows(cells: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Cells to audit rows, whatever each sheet's layout."""
    rows = sheet_rows(cells)
    data = data_rows(rows, sheet_profiles(rows), segment_rows)
    return issue_rows(data).unionByName(recommendation_rows(data))


def sheet_preview(rows: DataFrame) -> DataFrame:
    """Distinct URLs and row count per sheet, URLs as rows."""
    return rows.groupBy("sheet_id", "url").agg(F.count("*").alias("row_count"))
