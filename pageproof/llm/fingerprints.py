"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed
to a wide vector, and a document's fingerprint is the sum of its paragraphs'
vectors modulo powers of two: the order of paragraphs doesn't matter, and a
paragraph is inserted or deleted by adding or subtracting its vector.

A vector has two parts:

* ``EQUAL_LANES`` lanes modulo 2^32 from a hash of the whole paragraph: equal
  multisets of paragraphs have equal sums, others differ (512 bits).
* ``LIKE_LANES`` lanes modulo 2^32 that sum a random sign for each pair of
  neighbouring words (a paragraph of one word: that word). For the sums u, v of
  two texts, the mean square of u - v estimates the squared distance of their
  word-pair counts, so fingerprints alone tell how alike two texts are. A text
  holds less than 2^31 word pairs, so its sums, as signed numbers, are the true
  ones. They are stored in 2 bytes each where all of them fit, else in 4.

Null counts as empty. A paragraph without words adds nothing to the second part,
and a text without paragraphs, the empty one, has the zero vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUAL_LANES = 16
LIKE_LANES = 128
#: Of a packed fingerprint with 2 or 4 bytes for each lane of the second part.
NARROW_BYTES, WIDE_BYTES = 4 * EQUAL_LANES + 2 * LIKE_LANES, 4 * EQUAL_LANES + 4 * LIKE_LANES
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix with full avalanche; wraps around by intent."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paragraph_vector(paragraph: bytes) -> np.ndarray:
    """Both parts of one paragraph's vector, as 32-bit lanes."""
    equal = np.frombuffer(hashlib.blake2b(paragraph, digest_size=4 * EQUAL_LANES).digest(), dtype="<u4")
    return np.concatenate([equal, _signs([paragraph]).astype(np.uint32)])


def _signs(paragraphs: list[bytes]) -> np.ndarray:
    """Sum of the sign vectors of the word pairs within the paragraphs."""
    total = np.zeros(LIKE_LANES, dtype=np.int64)
    words: list[bytes] = []
    breaks = []
    for paragraph in paragraphs:
        own = paragraph.lower().split()
        if len(own) == 1:
            own.append(b"")
        if own:
            words += own
            breaks.append(len(words))
    if not words:
        return total
    h = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    pairs = (h[:-1] << np.uint64(32)) | h[1:]
    inner = np.ones(len(pairs), dtype=bool)
    inner[np.array(breaks[:-1], dtype=np.int64) - 1] = False
    pairs = pairs[inner]
    for at in range(0, len(pairs), 4096):
        block = _mixed(pairs[at : at + 4096, None] * np.uint64(0xD6E8FEB86659FD93) + _SEEDS[None, :])
        bits = np.unpackbits(block.view(np.uint8), axis=1)
        total += 2 * bits.sum(axis=0, dtype=np.int64) - len(block)
    return total


def vector(text: str | None) -> np.ndarray:
    """The sum of the vectors of a text's paragraphs, as 32-bit lanes."""
    total = np.zeros(EQUAL_LANES + LIKE_LANES, dtype=np.uint32)
    if not text:
        return total
    paragraphs = text.encode().split(b"\n")
    digests = b"".join([hashlib.blake2b(p, digest_size=4 * EQUAL_LANES).digest() for p in paragraphs])
    lanes = np.frombuffer(digests, dtype="<u4").reshape(-1, EQUAL_LANES)
    total[:EQUAL_LANES] = lanes.sum(axis=0, dtype=np.uint32)
    total[EQUAL_LANES:] = _signs(paragraphs).astype(np.uint32)
    return total


def packed(lanes: np.ndarray) -> bytes:
    """The lanes as bytes, the same for equal lanes: the second part in 2 bytes a
    lane where every lane fits."""
    like = lanes[EQUAL_LANES:].astype("<u4").view("<i4")
    narrow = like.astype("<i2")
    return lanes[:EQUAL_LANES].astype("<u4").tobytes() + (narrow if (narrow == like).all() else like).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return _rows([data])[0].astype(np.uint32)


def edited(data: bytes, insert: list[str] = (), delete: list[str] = ()) -> bytes:
    """A fingerprint after paragraphs were put in or taken out, without the text."""
    lanes = unpacked(data)
    for paragraph in insert:
        lanes = lanes + paragraph_vector(paragraph.encode())
    for paragraph in delete:
        lanes = lanes - paragraph_vector(paragraph.encode())
    return packed(lanes)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rowwise likeness (0 to 1) of fingerprints, the lanes of one a row:
    one less the squared distance over the sum of squared sizes. Equal
    fingerprints have 1; two that hold no word pair are alike only if equal."""
    u, v = (x[:, EQUAL_LANES:].astype(np.float64) for x in (a, b))
    apart = u - v
    size = (u * u).sum(1) + (v * v).sum(1)
    like = np.clip(1 - (apart * apart).sum(1) / np.where(size > 0, size, 1), 0, 1)
    return np.where((a == b).all(1), 1.0, np.where(size > 0, like, 0.0))


def _rows(values: Iterable[bytes]) -> np.ndarray:
    """The lanes of packed fingerprints, one a row; those of the second part signed."""
    values = list(values)
    lanes = np.empty((len(values), EQUAL_LANES + LIKE_LANES), dtype=np.int64)
    sizes = np.array([len(v) for v in values])
    for size, kind in ((NARROW_BYTES, "<i2"), (WIDE_BYTES, "<i4")):
        at = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join([values[i] for i in at]), dtype=np.uint8).reshape(len(at), size)
        offset = 4 * EQUAL_LANES
        lanes[at, :EQUAL_LANES] = np.ascontiguousarray(raw[:, :offset]).view("<u4")
        lanes[at, EQUAL_LANES:] = np.ascontiguousarray(raw[:, offset:]).view(kind)
    return lanes


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text, binary of NARROW_BYTES or WIDE_BYTES bytes."""

    @F.pandas_udf("binary")
    def computed(texts: pd.Series) -> pd.Series:
        return pd.Series([packed(vector(t)) for t in texts], dtype=object)

    return computed(text)


def likeness_of(a: Column, b: Column) -> Column:
    """Likeness of two packed fingerprints; null if either is null."""

    @F.pandas_udf("double")
    def computed(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.full(len(left), np.nan)
        known = (left.notna() & right.notna()).to_numpy()
        if known.any():
            out[known] = likeness(_rows(left[known]), _rows(right[known]))
        return pd.Series(out).where(known, None)

    return computed(a, b)


def with_next(docs: DataFrame, columns: list[str], spans: int | None = None) -> DataFrame:
    """Each row with ``next_<column>`` of the row that follows by ascending
    doc_id, the last row with those of the first.

    Ids are cut into spans at approximate quantiles, so each window sorts one
    span, whatever the ids are like. The row that begins the next span is added
    to each span as its last one: one row per span crosses. Rows with one id are
    ordered by text; null ids come first.
    """
    spark = docs.sparkSession
    spans = spans or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / spans for i in range(1, spans)], 0.25 / spans)
    cuts = sorted({int(c) for c in cuts})
    span = F.when(F.col("doc_id").isNull(), 0).otherwise(_bisected(F.col("doc_id"), cuts))
    rows = docs.select("doc_id", *columns, span.alias("span"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    heads = rows.groupBy("span").agg(
        F.min_by(
            F.struct("doc_id", *columns),
            F.struct(F.coalesce("doc_id", F.lit(-(2**63))), F.coalesce(F.col("text"), F.lit(""))),
        ).alias("head")
    )
    # One row per span: their order is a small window.
    around = Window.orderBy("span")
    first = F.last("span").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.withColumn("span", F.coalesce(F.lag("span").over(around), first))
    marked = rows.withColumn("real", F.lit(True)).unionByName(
        heads.select("head.*", "span").withColumn("real", F.lit(False))
    )
    within = Window.partitionBy("span").orderBy(F.col("real").desc(), *order)
    following = [F.lead(c).over(within).alias(f"next_{c}") for c in columns]
    return marked.select("doc_id", *columns, "real", *following).where("real").drop("real")


def _bisected(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or below the value, as a balanced
    tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= cuts[mid], tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(cuts))


def compare_edited(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text and
    how near they are, and how near the next document is. In the edited text the
    last half (rounded down) of the code points gives way to as many from the
    start of the next document, or all that it has."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", fingerprint(F.col("text")))
    paired = with_next(rows, ["text", "mark"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    paired = paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias(
            "edited"
        ),
        "mark",
        "next_mark",
    )
    paired = paired.withColumn("edited_mark", fingerprint(F.col("edited")))
    return paired.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.lower(F.hex("mark")).alias("fingerprint"),
        F.lower(F.hex("edited_mark")).alias("edited_fingerprint"),
        likeness_of(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        likeness_of(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )
