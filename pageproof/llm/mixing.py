"""Mixing documents to target weights of domains, in DataFrame functions alone.

Domains come from the table ``labels``: toxic, low (of low quality), good. A
classifier (naive Bayes over the terms that tell domains apart best, learnt from
a bounded sample of labelled rows) gives every document a posterior for each
domain, so it belongs to several softly. Each document then gets a rate, from 0
to ``most``, such that the tokens expected of each domain, the sum over documents
of rate * tokens * posterior, come as near to the targets as rates can, in the
sense of least squares.

The fit is projected gradient descent: every step is one aggregate over all
documents (as many sums as domains) and one expression over a document's own
posteriors; nothing else travels. Steps are scaled by the inverse of each
domain's own second moment, so that small domains settle as fast as large ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageproof.llm.common import stored

DOMAINS = ("good", "low", "toxic")
#: Token shares aimed at.
WEIGHTS = {"good": 0.93, "low": 0.05, "toxic": 0.02}
#: The domain of which nothing is thinned out where documents are drawn once at most.
KEPT = "good"
#: Labelled rows that the classifier learns from at most.
SAMPLE_ROWS = 6000
#: Terms of the classifier at most; each occurs in LEAST_ROWS rows of the sample
#: and leans to some domain (chi-square).
TERMS, LEAST_ROWS, LEAST_LEANING = 300, 4, 20.0
#: Least rate that counts as 1 where documents are drawn once at most.
SURE = 0.9
#: Steps after which the rates so far are stored, which keeps plans short.
STORED_STEPS = 10

_SPACE = r"[\x20\x09-\x0D]+"
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def domain_of() -> Column:
    """The domain of a row of ``labels``; null where a label is missing."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


def featured(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, n_tokens, terms, and columns in ``also``) of every row: tokens between white space, and as
    terms the lower-cased words and marks of form. Null texts have neither."""
    text = docs.select("doc_id", *also, F.coalesce("text", F.lit("")).alias("text"))
    parts = text.select(
        "doc_id",
        *also,
        F.size(F.array_remove(F.split("text", _SPACE), "")).cast("long").alias("n_tokens"),
        F.array_remove(F.split(F.lower("text"), _BREAKS), "").alias("words"),
        F.length("text").alias("n_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"),
        F.filter(F.split("text", "\n"), lambda line: line != "").alias("lines"),
    )
    marks = {
        "#symbols": 4 * F.col("n_symbols") > F.col("n_tokens"),
        "#upper": 10 * F.col("n_upper") > 3 * F.col("n_chars"),
        "#lines": 10 * F.size(F.array_distinct("lines")) < 8 * F.size("lines"),
        "#short": F.col("n_tokens") < 12,
    }
    shown = F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in marks.items()]), lambda m: m.isNotNull())
    return parts.select("doc_id", *also, "n_tokens", F.concat("words", shown).alias("terms"))


@dataclass(frozen=True)
class Classifier:
    """``start`` is the log odds of each domain for a document without terms,
    ``weights`` what each term adds to them; ``known`` are the domains that some
    row of the sample is labelled with."""

    start: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    known: tuple[str, ...] = DOMAINS


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """From documents and labels (doc_id, quality, toxic): the first
    SAMPLE_ROWS labelled ids by a hash, which are all that is broadcast. A domain
    without a labelled row has no document; without labels, no domain is likelier
    than another."""
    labelled = labels.select("doc_id", domain_of().alias("domain")).where("doc_id is not null and domain is not null")
    sample = F.broadcast(labelled.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "domain").limit(SAMPLE_ROWS))
    # Texts of the sample alone are split into terms.
    rows = featured(docs.select("doc_id", "text").join(sample, "doc_id"), "domain")
    known = stored(rows.select("domain", F.array_distinct("terms").alias("terms")))
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    n = [sizes.get(d, 0) for d in DOMAINS]
    total = sum(n)
    if not total:
        return Classifier((0.0,) * len(DOMAINS), {}, ())
    found = known.select("domain", F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS]
    )
    leaning = F.lit(0.0)
    for d, size in zip(DOMAINS, n, strict=True):
        if size:
            expected = F.col("n") * size / total
            leaning = leaning + (F.col(d) - expected) ** 2 / expected
    best = found.where(F.col("n") >= LEAST_ROWS).withColumn("leaning", leaning).where(F.col("leaning") >= LEAST_LEANING)
    start = [math.log((size + 1) / (total + len(DOMAINS))) for size in n]
    weights = {}
    for row in best.orderBy(F.desc("leaning"), "term").limit(TERMS).collect():
        share = [(row[d] + 0.5) / (size + 1) for d, size in zip(DOMAINS, n, strict=True)]
        weights[row["term"]] = tuple(math.log(p / (1 - p)) for p in share)
        start = [s + math.log(1 - p) for s, p in zip(start, share, strict=True)]
    start = [s if size else -math.inf for s, size in zip(start, n, strict=True)]
    return Classifier(tuple(start), weights, tuple(d for d, size in zip(DOMAINS, n, strict=True) if size))


def posteriors(rows: DataFrame, fitted: Classifier) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>...) of ``featured`` rows."""
    terms = list(fitted.weights)
    held = F.array_intersect("terms", F.array(*map(F.lit, terms))) if terms else F.array().cast("array<string>")
    rows = rows.select("doc_id", "n_tokens", held.alias("held"))

    def log_odds(k: int) -> Column:
        if not terms:
            return F.lit(fitted.start[k])
        own = F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(fitted.weights[t][k]))])
        return F.aggregate("held", F.lit(fitted.start[k]), lambda acc, t: acc + F.element_at(own, t))

    odds = {d: log_odds(k) for k, d in enumerate(DOMAINS)}
    rows = rows.select("doc_id", "n_tokens", *[o.alias(f"o_{d}") for d, o in odds.items()])
    most = F.greatest(*[f"o_{d}" for d in DOMAINS])
    rows = rows.select("doc_id", "n_tokens", *[F.exp(F.col(f"o_{d}") - most).alias(f"e_{d}") for d in DOMAINS])
    every = sum(F.col(f"e_{d}") for d in DOMAINS)
    return rows.select("doc_id", "n_tokens", *[(F.col(f"e_{d}") / every).alias(f"p_{d}") for d in DOMAINS])


def _largest_eigenvalue(matrix: list[list[float]], steps: int = 100) -> float:
    """Of a symmetric matrix without negative entries, by power iteration."""
    v, size = [1.0] * len(matrix), 0.0
    for _ in range(steps):
        w = [sum(a * x for a, x in zip(row, v, strict=True)) for row in matrix]
        size = max(w)
        if not size:
            return 0.0
        v = [x / size for x in w]
    return size


def _targets(whole: dict[str, float], share: dict[str, float], most: float) -> dict[str, float]:
    """Tokens aimed at in each domain of ``share``, as shares of all tokens;
    ``whole`` are the tokens there are. Where ``most`` is 1 at most, every token of
    KEPT is wanted, and the shares of the others are upper ones: a domain that is
    rarer stays whole, and only those above their share are thinned out to it."""
    total = sum(whole.values())
    have = {d: whole[d] * most / total for d in share}
    if most > 1 or not share.get(KEPT) or not have[KEPT]:
        room = min((have[d] / share[d] for d in share if share[d] and have[d]), default=1.0)
        return {d: share[d] * min(1.0, room) for d in share}
    above: set[str] = set()
    while True:
        # Tokens of the mix if those above their share come down to it; that makes
        # the mix smaller, so others may now be above theirs.
        mixed = sum(have[d] for d in share if d not in above) / (1 - sum(share[d] for d in above))
        more = {d for d in share if d != KEPT and d not in above and have[d] > share[d] * mixed}
        if not more:
            return {d: share[d] * mixed if d in above else have[d] for d in share}
        above |= more


def rates(soft: DataFrame, weights: dict[str, float], most: float, tolerance: float = 1e-4, steps: int = 60) -> DataFrame:
    """``soft`` (doc_id, n_tokens, p_<domain>...) with ``rate``. The targets are
    shares of all tokens, for the domains in ``weights``; where ``most`` is 1, see
    ``_targets``. The fit ends when every domain's expected total is within
    ``tolerance`` of its target (as a share of all tokens), no longer moves, or
    after ``steps``. Without tokens or weights every rate is 1, or ``most`` if less."""
    p = {d: F.col(f"p_{d}") for d in DOMAINS}
    tokens = F.col("n_tokens").cast("double")
    pairs = {f"{a}_{b}": F.sum(tokens * p[a] * p[b]) for a in DOMAINS for b in DOMAINS}
    whole = soft.agg(*[F.sum(tokens * p[d]).alias(d) for d in DOMAINS], *[c.alias(k) for k, c in pairs.items()]).first()
    total = sum(whole[d] or 0.0 for d in DOMAINS)
    begin = min(1.0, most)
    state = soft.withColumn("rate", F.lit(begin))
    if not total or not weights:
        return state
    every = sum(weights.values())
    share = {d: w / every if every else 0.0 for d, w in weights.items()}
    targets = {d: 0.0 for d in DOMAINS} | _targets({d: whole[d] for d in DOMAINS}, share, most)
    own = {d: whole[f"{d}_{d}"] / total for d in DOMAINS}
    scale = {d: 1 / own[d] if own[d] > 0 else 0.0 for d in DOMAINS}
    moments = [[whole[f"{a}_{b}"] / total * math.sqrt(scale[a] * scale[b]) for b in DOMAINS] for a in DOMAINS]
    pace = 1 / (_largest_eigenvalue(moments) or 1.0)
    before: dict[str, float] = {}
    for step in range(1, steps + 1):
        sums = state.agg(*[F.sum(tokens * F.col("rate") * p[d]).alias(d) for d in DOMAINS]).first()
        apart = {d: sums[d] / total - targets[d] for d in DOMAINS}
        if max(map(abs, apart.values())) < tolerance:
            break
        if before and max(abs(apart[d] - before[d]) for d in DOMAINS) < tolerance / 100:
            break
        before = apart
        move = sum(p[d] * (pace * scale[d] * apart[d]) for d in DOMAINS)
        state = state.withColumn("rate", F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("rate") - move)))
        if step % STORED_STEPS == 0:
            state = stored(state)
    return state


def copies() -> Column:
    """How often a row is drawn: its rate, rounded up or down by a hash of its id
    with the odds that keep the rate."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, most: float = 4.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, posteriors, the likeliest
    domain, rate, and copies to draw. Null texts have no tokens; what the
    classifier makes of a document without terms holds for them."""
    model = learn(docs, labels)
    soft = stored(posteriors(featured(docs), model))
    wanted = weights or WEIGHTS
    fitted = rates(soft, {d: wanted[d] for d in model.known}, most)
    top = F.greatest(*[f"p_{d}" for d in DOMAINS])
    domain = F.coalesce(*[F.when(F.col(f"p_{d}") == top, F.lit(d)) for d in DOMAINS])
    return fitted.select(
        "doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS], domain.alias("domain"), "rate", copies().alias("copies")
    )


def mixed_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents drawn at rates of 1 at most, so none twice, with all their
    columns. Rates of SURE or more draw for certain, so that no document of a domain
    that stays whole is lost to rounding. Rows with a null id stay."""
    drawn = mix(docs, labels, weights, most=1.0).where((F.col("copies") > 0) | (F.col("rate") >= SURE))
    drawn = drawn.where("doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(drawn, "doc_id", "left_semi")
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
