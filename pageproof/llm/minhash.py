"""Near-duplicate documents by MinHash bands and odd sketches.

A document is the set of its distinct word shingles. MinHash samples are banded
to find candidates; the samples are also folded into an odd sketch, a parity
bitmap in which each sample flips one bit. The population count of the XOR of
two sketches estimates how many samples differ, precisely so at high similarity,
and turns away candidates that are clearly too far apart. What remains is
confirmed on the full sets.

Work follows the number of documents, not of pairs:

* Equal sets are one node of the links from the start.
* In a bucket, members are first held against one of them only, its hub: the one
  that shares most buckets with others, which is the one with the fewest edits of
  its own; then against HUB_SEEDS others, the first by a hash. Their links join
  nearly all of a family of copies.
* Where a bucket still holds more than one component, its members are joined on
  the rarest elements of their full sets: two sets of the similarity share one
  among as many of their rarest as their difference allows, so no link is lost.
  A member that was edited too much for any link has nothing but elements of its
  own there, and meets nobody.

With BANDS bands of BAND_ROWS samples, a pair at similarity 0.8 misses all bands
with probability (1 - 0.8^4)^32 = 5e-8. The sketch turns it away with about
1e-6: its bound lies at similarity 0.6, five standard deviations below.

Documents without words have an empty set and are linked with nothing. Rows with
a null id can't be linked: their component is null, and they are kept. Rows that
share an id are linked, whatever their texts.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageproof.llm.common import stored
from pageproof.llm.links import components

BANDS, BAND_ROWS = 32, 4
SKETCH_WORDS = 16
HUB_SEEDS = 2
SCREEN = 0.6
#: Elements of a set that are sampled at a time.
BLOCK = 512

_K = BANDS * BAND_ROWS
_BITS = 64 * SKETCH_WORDS


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix with full avalanche; wraps around by intent."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_NUMBERS = np.arange(1, _K + 1, dtype=np.uint64)
_FACTORS = mixed(_NUMBERS) | np.uint64(1)
_TERMS = mixed(_NUMBERS + np.uint64(1 << 32))
_BAND_FACTORS = (mixed(np.arange(BAND_ROWS, dtype=np.uint64) + np.uint64(1 << 33)) | np.uint64(1))[None, :]
_BAND_TERMS = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(1 << 34))


def shingles(text: str | None, size: int = 2) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending: of ``size`` neighbouring
    words with A-Z lower-cased, or of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    joined = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(joined)


def minhashes(elements: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a set."""
    least = np.full(_K, 2**64 - 1, np.uint64)
    for at in range(0, len(elements), BLOCK):
        values = elements[at : at + BLOCK, None] * _FACTORS + _TERMS
        np.minimum(least, values.min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words: each flips the bit that a
    hash of its number and value points to."""
    bits = mixed(samples + _TERMS) % np.uint64(_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def most_apart(similarity: float) -> int:
    """Differing sketch bits to expect at a similarity."""
    return math.ceil(_BITS / 2 * (1 - math.exp(-(1 - similarity) * 4 * _K / _BITS)))


def estimated_similarity(differing_bits: int) -> float:
    """Similarity of two sets whose sketches differ in so many bits."""
    inside = 1 - 2 * differing_bits / _BITS
    return 0.0 if inside <= 0 else max(0.0, 1 + _BITS / (4 * _K) * math.log(inside))


SIGNED = "n_shingles long, node binary, bands array<long>, sketch array<long>"


def signatures(text: Column, size: int) -> Column:
    """Struct of set size, digest of the set, band keys and odd sketch; all but
    the size are null for an empty set."""

    @F.pandas_udf(SIGNED)
    def signed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            elements = shingles(value, size)
            if not len(elements):
                rows.append((0, None, None, None))
                continue
            samples = minhashes(elements)
            folded = (mixed(samples).reshape(BANDS, BAND_ROWS) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
            digest = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
            keys = mixed(folded + _BAND_TERMS)
            rows.append((len(elements), digest, keys.view(np.int64), odd_sketch(samples).view(np.int64)))
        return pd.DataFrame(rows, columns=["n_shingles", "node", "bands", "sketch"])

    return signed(text)


def shingle_sets(text: Column, size: int) -> Column:
    """Struct of the digest of a set and its elements."""

    @F.pandas_udf("node binary, elements array<long>")
    def sets(texts: pd.Series) -> pd.DataFrame:
        found = [shingles(t, size) for t in texts]
        digests = [hashlib.blake2b(e.tobytes(), digest_size=16).digest() if len(e) else None for e in found]
        return pd.DataFrame({"node": digests, "elements": [e.view(np.int64) for e in found]})

    return sets(text)


def _near_enough(percent: int) -> Column:
    """Whether sizes and sketches of rows a and b allow the similarity."""
    apart = sum(F.bit_count(F.get("a.sketch", F.lit(i)).bitwiseXOR(F.get("b.sketch", F.lit(i)))) for i in range(SKETCH_WORDS))
    sizes = [F.col("a.n_shingles"), F.col("b.n_shingles")]
    return (100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & (apart <= most_apart(SCREEN))


def _screened(pairs: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose set sizes and sketches allow the similarity."""
    sides = [traits.select(F.col("node").alias(k), F.struct("n_shingles", "sketch").alias(f"of_{k}")) for k in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    flat = both.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return flat.where(_near_enough(percent)).select(F.col("left").alias("a"), F.col("right").alias("b"))


def _across(rest: DataFrame, sets: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be near, among ``rest``
    (node, component). Elements in one set alone can't be shared and go at once;
    they count as the rarest of their set."""
    short = F.xxhash64("node").alias("short")
    elements = rest.join(sets, "node").select(short, F.explode("elements").alias("element"))
    spread = elements.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    common = elements.join(spread, "element").groupBy("short")
    common = common.agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("common"))
    rows = rest.join(traits, "node").withColumn("short", short).join(common, "short")
    # Of n elements, so many rarest hold one that a set of the similarity shares.
    rarest = F.expr(f"n_shingles - ({percent} * n_shingles + 99) div 100 + 1").cast("int")
    room = rarest - (F.col("n_shingles").cast("int") - F.size("common"))
    rows = rows.withColumn("room", room).where("room > 0")
    rarest = F.posexplode(F.slice("common", F.lit(1), F.col("room"))).alias("at", "c")
    rows = rows.select("node", "component", F.size("common").alias("shared"), rarest)
    # From an element on, a set has so many that others may share.
    rows = rows.select("node", "component", F.col("c.element").alias("element"), (F.col("shared") - F.col("at")).alias("left"))
    rows = stored(rows)
    ends = rows.groupBy("element").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rows = rows.join(ends.where("low < high").select("element"), "element", "left_semi").join(traits, "node")
    apart = (F.col("a.element") == F.col("b.element")) & (F.col("a.node") < F.col("b.node"))
    # At the first element that two sets share, what is left of both bounds all they share.
    left, sizes = F.least("a.left", "b.left"), F.col("a.n_shingles") + F.col("b.n_shingles")
    apart = apart & ((100 + percent) * left >= percent * sizes)
    apart = apart & (F.col("a.component") != F.col("b.component")) & _near_enough(percent)
    pairs = rows.alias("a").join(rows.alias("b"), apart)
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    shared = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("shared")
    return shared.where(100 * F.col("shared") >= percent * union).select("a", "b")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket members (key, node) with their component so far."""
    own = labels.select(F.col("id").alias("node"), "component")
    return members.join(own, "node", "left").withColumn("component", F.coalesce("component", "node"))


def link(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest
    id that links reach) and kept (whether that is the row's own id). Documents
    are linked whose sets of ``size``-word shingles have a Jaccard similarity of
    ``percent`` per cent or more."""
    signed = docs.select("doc_id", signatures(F.col("text"), size).alias("s")).select("doc_id", "s.*")
    signed = stored(signed.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))))
    known = signed.where("node is not null")
    # Bands and sketch follow from the set, so any row of a node has them.
    first = {c: F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")}
    nodes = stored(known.groupBy("node").agg(F.min("doc_id").alias("rep"), *first.values()))

    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(rows.join(shared.select("key"), "key", "left_semi").distinct())
    near = nodes.join(members.select("node").distinct(), "node", "left_semi")
    near = stored(near.select("node", "rep", "n_shingles", "sketch"))
    traits = near.drop("rep")
    # These ids grow with the corpus, so they are never broadcast, however few they are here.
    ids = near.select(F.col("rep").alias("doc_id")).hint("merge")
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    sets = texts.select(shingle_sets(F.col("text"), size).alias("s")).select("s.*").where("node is not null")
    sets = stored(sets.groupBy("node").agg(F.first("elements").alias("elements")))

    # How many others a node shares buckets with, each as often as it does.
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    degree = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = stored(members.join(degree, "node"))
    places = [F.max(F.struct("degree", "node"))["node"].alias("hub_0")]
    for seed in range(1, HUB_SEEDS + 1):
        first_by_hash = F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node"))["node"]
        places.append(first_by_hash.alias(f"hub_{seed}"))
    hubs = stored(ranked.groupBy("key").agg(*places))
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    links = known.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a < b")
    labels = components(links)
    for seeds in ([0], range(1, HUB_SEEDS + 1)):
        chosen = hubs.select("key", F.explode(F.array_distinct(F.array(*[f"hub_{s}" for s in seeds]))).alias("hub"))
        pairs = _labelled(members, labels).join(chosen, "key")
        of_hub = labels.select(F.col("id").alias("hub"), F.col("component").alias("hub_component"))
        pairs = pairs.join(of_hub, "hub", "left").where(F.col("component") != F.coalesce("hub_component", "hub"))
        pairs = pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        found = stored(_confirmed(_screened(pairs, traits, percent), sets, percent))
        links = links.unionByName(found)
        labels = components(links)
    at = stored(_labelled(members, labels))
    open_keys = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rest = at.join(open_keys.where("low < high").select("key"), "key", "left_semi").select("node", "component")
    pairs = stored(_across(stored(rest.distinct()), sets, traits, percent))
    found = stored(_confirmed(pairs, sets, percent))
    labels = components(links.unionByName(found))

    own = nodes.select("node", "rep").join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    own = own.withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    own = stored(own.join(least, "component").select("node", "component_id"))
    rows = signed.select("doc_id", "n_shingles", "node").join(own, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that ``link`` keeps, with all their columns; of rows that
    share an id, one."""
    kept = link(docs, size, percent).where("kept and doc_id is not null").select("doc_id")
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))
