"""The scalar functions under SQL names, for use in ``spark.sql``."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pageproof.functions import text as t
from pageproof.functions import urls as u

_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*')")
_OPERATOR = re.compile(r"(?<![\w`.])(and|or|not|<=>|<>|[<>!=]=|[=<>!+\-*/%])\(")


def sql_text(column: Column) -> str:
    """A column expression as SQL that gives the same expression again. The text
    is Spark's own, where operators are written as calls; as calls, their names
    need quotes. String literals stay as they are."""
    parts = _LITERAL.split(column._jc.node().sql())
    return "".join(p if i % 2 else _OPERATOR.sub(r"`\1`(", p) for i, p in enumerate(parts))


def column_bodies() -> dict[str, str]:
    """Functions whose one definition is the column expression: addresses as
    written, in canonical form and as a browser resolves them, and the type of a
    link on a page."""
    link, base = F.col("link"), F.col("base")
    return {
        "pp_normalize_url(link STRING, base STRING)": sql_text(u.normalize_url(link, base)),
        "pp_resolve_url(link STRING, base STRING)": sql_text(u.resolve_url(link, base)),
        "pp_link_href(link STRING, base STRING)": sql_text(u.link_href(link, base)),
        "pp_link_type(link STRING, base STRING)": sql_text(u.link_type(link, base)),
        "pp_faq_key(s STRING)": sql_text(t.faq_key(F.col("s"))),
        "pp_decode_entities(s STRING)": sql_text(t.decode_entities(F.col("s"))),
    }


def sql_bodies() -> dict[str, str]:
    """Bodies written in SQL for the functions that stay short in SQL."""
    ws = t.WS.replace("\\", "\\\\")
    norm = f"trim(regexp_replace(coalesce(s, ''), '{ws}+', ' '))"
    return {
        "pp_normalize_text(s STRING)": norm,
        "pp_normalize_cmp(s STRING)": f"lower({norm})",
        "pp_is_url(s STRING)": r"s rlike '(?i)^https?://\\S+$'",
        "pp_normalize_label(s STRING)": "regexp_replace(lower(s), '[^a-z0-9]+', '')",
        "pp_slug_segment(s STRING)": "regexp_replace(lower(trim(s)), '^/+|/+$', '')",
        "pp_strip_edge_punct(s STRING)": "regexp_replace(s, '^[.,!?;:…]+|[.,!?;:…]+$', '')",
        "pp_preview10(s STRING)": (
            f"array_join(slice(split({norm}, ' '), 1, 10), ' ') || if(size(split({norm}, ' ')) > 10, '…', '')"
        ),
        # Absolute http(s) addresses.
        "pp_url_host(s STRING)": "lower(regexp_extract(s, '^[a-zA-Z]+:/*([^/?#]*)', 1))",
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """CREATE TEMPORARY FUNCTION for each body; Catalyst inlines them."""
    names = []
    for signature, body in {**sql_bodies(), **column_bodies()}.items():
        kind = "BOOLEAN" if "is_url" in signature else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
        names.append(signature.split("(")[0])
    return names
