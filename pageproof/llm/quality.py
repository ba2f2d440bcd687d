"""Weak supervision of document quality, in DataFrame functions alone.

Rules look at counts of one text and vote for good, vote for bad or abstain.
Their votes are reduced to how often each pattern of votes occurs (at most
3 to the power of the number of rules, whatever the corpus size), on which
expectation-maximisation estimates the share of good documents and, for each
rule, how often it is right on good and on bad ones. A document's posterior
follows from its own votes and these figures, as a plain expression; it decides
instead of every rule having to pass. Null and empty texts have no words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageproof.llm.common import stored

WINDOW = 5
_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _repeat_starts(by_hash: str) -> Column:
    """Starts, ascending, of the windows found more than once: in the column of
    (hash, start) sorted by hash, equal hashes are neighbours."""
    rows = F.col(by_hash)
    own = lambda k: F.get(rows, k)["h"]
    found = F.transform(
        F.sequence(F.lit(0), F.size(rows) - 1),
        lambda k: F.when((own(k - 1) == own(k)) | (own(k + 1) == own(k)), F.get(rows, k)["i"]),
    )
    return F.sort_array(F.filter(found, lambda i: i.isNotNull()))


def _covered(starts: str) -> Column:
    """Words that windows at these starts cover: each WINDOW of them, or as far
    as the next start."""
    rows = F.col(starts)
    return F.aggregate(
        rows,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def counts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and counts over its whole text."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = text.select(
        "doc_id",
        "text",
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("words")
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = split.withColumn("windows", windows)
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    # A column of its own for each step: inside a lambda it would run anew for each element.
    by_hash = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashed = hashed.withColumn("by_hash", F.when(repeated, by_hash))
    hashed = hashed.withColumn("starts", F.when(F.col("by_hash").isNotNull(), _repeat_starts("by_hash")))
    return hashed.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("starts").isNotNull(), _covered("starts")).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
    )


@dataclass(frozen=True)
class Rule:
    """Votes good or bad where its condition holds, else abstains."""

    name: str
    good: Column
    bad: Column


def default_rules() -> tuple[Rule, ...]:
    n, chars = F.col("n_words"), F.col("word_chars")
    symbols, repeats, upper = F.col("n_symbols"), F.col("n_repeat_words"), F.col("n_upper")
    return (
        Rule("length", n >= 40, n < 10),
        Rule("symbols", symbols <= 0.02 * n, symbols > 0.25 * n),
        Rule("dup_lines", F.col("n_dup_lines") == 0, F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        Rule("repeats", repeats <= 0.02 * n, repeats > 0.15 * n),
        Rule("word_length", chars.between(3 * n, 9 * n), (chars < 2 * n) | (chars > 14 * n)),
        Rule("upper", upper <= 0.12 * chars, upper > 0.4 * chars),
    )


def votes(frame: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``frame`` with a column per rule: 1 good, -1 bad, 0 abstains (also where
    the condition is null)."""
    vote = {f"vote_{r.name}": F.when(r.bad, -1).when(r.good, 1).otherwise(0) for r in rules}
    return frame.withColumns(vote)


@dataclass(frozen=True)
class Accuracies:
    """``share`` of good documents; for each rule how often it votes good on a
    good document and bad on a bad one, given that it votes."""

    share: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


def posterior_of(pattern: tuple[int, ...], found: Accuracies) -> float:
    odds = math.log(found.share / (1 - found.share))
    for vote, a, b in zip(pattern, found.on_good, found.on_bad, strict=True):
        if vote:
            odds += math.log(a / (1 - b)) if vote > 0 else math.log((1 - a) / b)
    return 1 / (1 + math.exp(-odds))


#: Where expectation-maximisation starts: a good document passes a rule that
#: votes nearly always, a bad one has some defect but passes most rules.
START = (0.8, 0.995, 0.2)
#: Bounds of the estimates. Rules watch for different defects, which seldom come
#: together, so votes for bad agree little. Without bounds, one frequent defect
#: would become what bad means, and the others noise: a vote for bad on a good
#: document stays rare, and passing one rule stays weak evidence of being good.
LEAST_ON_GOOD = 0.995
MOST_ON_BAD = 0.5


def estimate(
    patterns: list[tuple[tuple[int, ...], int]],
    n_rules: int,
    iterations: int = 100,
    start: tuple[float, float, float] = START,
    belief: float = 0.1,
) -> Accuracies:
    """Expectation-maximisation over vote patterns with their numbers of
    documents. ``start`` has the share of good documents, which is held, and how
    often rules are right on good and on bad ones; these figures are drawn towards
    it with ``belief`` of the weight of the documents, so rules that seldom vote
    stay sensible. Without documents the starting figures remain."""
    total = sum(n for _, n in patterns)
    share, on_good, on_bad = start
    found = Accuracies(share, (on_good,) * n_rules, (on_bad,) * n_rules)
    if not total:
        return found

    def drawn(right: float, of: float, to: float) -> float:
        return (right + (belief * of + 1) * to) / (of + belief * of + 1)

    for _ in range(iterations):
        good = [(p, n, n * posterior_of(p, found)) for p, n in patterns]
        right_good, right_bad = [], []
        for j in range(n_rules):
            voted = [(p[j], n, g) for p, n, g in good if p[j]]
            passed = drawn(sum(g for v, _, g in voted if v > 0), sum(g for _, _, g in voted), on_good)
            right_good.append(max(LEAST_ON_GOOD, passed))
            caught = drawn(sum(n - g for v, n, g in voted if v < 0), sum(n - g for _, n, g in voted), on_bad)
            right_bad.append(min(MOST_ON_BAD, caught))
        found = Accuracies(share, tuple(right_good), tuple(right_bad))
    return found


def posterior(rules: tuple[Rule, ...], found: Accuracies) -> Column:
    """The posterior of being good as an expression over the vote columns."""
    odds = F.lit(math.log(found.share / (1 - found.share)))
    for rule, a, b in zip(rules, found.on_good, found.on_bad, strict=True):
        vote = F.col(f"vote_{rule.name}")
        odds = odds + F.when(vote > 0, math.log(a / (1 - b))).when(vote < 0, math.log((1 - a) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] | None = None, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: its counts, whether a base rule fails, the
    posterior, and whether it is kept: no base rule fails and the posterior is
    ``least`` or more. The counts are stored once, narrow, and read twice."""
    rules = rules or default_rules()
    voted = votes(stored(counts(docs)), rules)
    names = [f"vote_{r.name}" for r in rules]
    patterns = [(tuple(row[:-1]), row[-1]) for row in voted.groupBy(*names).count().collect()]
    scored = voted.withColumn("posterior", posterior(rules, estimate(patterns, len(rules))))
    return scored.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("posterior") >= least)).alias("kept"),
        "posterior",
    )
