"""URL filter: pattern rules behind an index of literal tokens.

A rule is a regular expression over ``host + path`` with the literal tokens
that any match must contain. It is filed under the rarest of its tokens, as
counted over all URLs, or, where a match holds one of several, under each of
these. A URL's tokens fetch the rules filed under them, and only
these run their expression. Verdicts belong to URLs, so each distinct URL is
judged once, and rows take the verdict of theirs by one join, in which Spark
can split a frequent URL.

Null URLs and those without ``://`` have an empty host and path, match no rule
and are allowed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a token is: the longest runs of letters and of digits, in lower case.
TOKEN = "[a-z]+|[0-9]+"
_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``name`` and ``verdict`` of a rule, its pattern over ``host + path`` (the
    path as it stands, the host in lower case), the tokens each match holds (of
    the lower-cased URL), and its rank: of the rules that match, the one of
    highest rank wins, in a tie the last by name. ``base`` rules are reported.
    ``any_of`` is for patterns with alternatives: each match holds one of these
    tokens, and the rule is filed under all of them."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    base: bool = False
    any_of: tuple[str, ...] = ()


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with all its subdomains, and how the path starts: the longer the
    rule, the higher its rank, above all plain patterns."""
    # A path that stops inside a token promises only the tokens before it.
    whole = path if re.fullmatch("[^A-Za-z0-9]?", path[-1:]) else re.sub("[A-Za-z0-9]+$", "", path)
    tokens = re.findall(TOKEN, f"{host}{whole}".lower())
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, verdict, pattern, tuple(tokens), 1000 + len(host + path), True)


def word_rule(verdict: str, word: str) -> Rule:
    """A token anywhere in host or path."""
    return Rule(f"word:{word}", verdict, rf"(?i)(?<![a-z0-9]){word}(?![a-z0-9])", (word,), 10)


# The given rules.
BASE_RULES = (
    prefix_rule("block", "net", "/"),
    prefix_rule("allow", "example.net", "/en/"),
    prefix_rule("block", "example.com", "/de/"),
    prefix_rule("allow", "org", "/fr/"),
)
# End of the fixed values.

PATTERN_RULES = (
    Rule("spam-farm", "block", r"^(?:[^/]*\.)?spam-farm\d*\.", ("spam", "farm"), 20),
    Rule("link-farm", "block", r"^(?:[^/]*\.)?link-(?:farm|exchange)\d*\.", ("link",), 20),
    Rule("ad-server", "block", r"^(?:ads?|adserver|doubleclick)\d*\.[^/]+/(?:click|track|banner)", (), 20, any_of=("ad", "ads", "adserver", "doubleclick")),
    Rule("download", "block", r"(?i)/[^/]*\.(?:exe|msi|apk)$", (), 15, any_of=("exe", "msi", "apk")),
    Rule("login-page", "block", r"(?i)/(?:wp-login|wp-admin)(?:\.php|/|$)", ("wp",), 15),
    *(word_rule("block", w) for w in ("casino", "porn", "xxx", "viagra", "torrent", "payday", "escorts")),
)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is: patterns fold no other letters."""
    return F.translate(c, _A_TO_Z, _A_TO_Z.lower())


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_frame(spark, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(r.name, r.verdict, r.pattern, list(r.tokens), r.rank, r.base, list(r.any_of)) for r in rules]
    return spark.createDataFrame(
        rows, "rule_name string, rule_verdict string, pattern string, tokens array<string>, rank int, base boolean, any_of array<string>"
    )


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rules with ``token``: the one of theirs that the fewest URLs hold (a tie:
    the first by name). ``tokens`` has a row per URL and token; only tokens that
    some rule names are counted. Rules with alternatives get a row for each of
    these, rules without a token get null."""
    named = rules.select("rule_name", F.explode_outer("tokens").alias("token"))
    counted = tokens.join(F.broadcast(named.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = named.join(counted, "token", "left").groupBy("rule_name")
    rarest = ranked.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    filed = rules.join(rarest.select("rule_name", "best.token"), "rule_name")
    places = F.when(F.size("any_of") > 0, F.col("any_of")).otherwise(F.array("token"))
    return filed.withColumn("token", F.explode(places)).drop("tokens", "any_of")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + PATTERN_RULES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, the base rule
    that decides (null if none does), the verdict (``allow`` if nothing matches)
    and the pattern rule that decides, if one does.

    The rule list is a parameter held on the driver, so its frame is as small as
    that list; it is the only thing that is broadcast."""
    urls = pages.select("url").where(F.col("url").contains("://")).distinct()
    urls = urls.select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("place"))
    urls = urls.withColumn("token", F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("place")), F.lit(TOKEN), F.lit(0))))
    tokens = urls.select("url", "place", F.explode("token").alias("token"))
    index = rule_index(rule_frame(pages.sparkSession, rules), tokens.select("token"))
    filed = tokens.join(F.broadcast(index.where("token is not null")), "token").drop("token")
    # Rules that hold no literal can't be filed: every URL is a candidate for them.
    unfiled = index.where("token is null").drop("token")
    open_rules = [r for r in rules if not (r.tokens or r.any_of)]
    if open_rules:
        each = urls.select("url", "place", F.explode(F.array(*[F.lit(r.name) for r in open_rules])).alias("rule_name"))
        filed = filed.unionByName(each.join(F.broadcast(unfiled), "rule_name"))
    matched = filed.where(F.regexp("place", "pattern"))
    won = matched.groupBy("url").agg(
        F.max_by(F.struct("rule_name", "rule_verdict", "base"), F.struct("rank", "rule_name")).alias("won")
    )
    rows = pages.select("page_id", "url").join(won, "url", "left")
    return rows.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.when(F.col("won.base"), F.col("won.rule_name")).alias("rule"),
        F.coalesce("won.rule_verdict", F.lit("allow")).alias("verdict"),
        F.when(~F.col("won.base"), F.col("won.rule_name")).alias("pattern_rule"),
    )
