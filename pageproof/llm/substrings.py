"""Repeated passages, found by doubling the length of windows level by level.

A word window that repeats across documents consists of two halves that do.
Half-length windows are hashed first; those found in one document only are
dropped, and only windows around a surviving half are hashed at twice the
length. Hashes double likewise: that of a window is made of its halves'.

At the first level a document need not hand in every window. Of the half-length
windows inside any full one, the one with the smallest hash is handed in; it
depends on nothing but the words of the full window, so wherever that repeats,
the same half is handed in, and no repeat is lost. That is one window in thirteen
at 50 words.

Whole documents with the same words are one class: all but those with its
smallest id are covered from end to end, and only that id takes part in the
levels. A passage in a third of all documents makes hot keys; minima are taken
before the shuffle, and the joins are ones that Spark can split.

Rows with a null id neither lose words nor make others lose any. Rows that share
an id never make each other lose words. Null texts have no words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageproof.llm.common import stored
from pageproof.llm.minhash import mixed

WINDOW = 50
_TWO, _ONE_MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def doubled(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of windows of twice the length, from those of the length."""
    return mixed(hashes[:-length] * _TWO + hashes[length:]) if len(hashes) > length else hashes[:0]


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window that starts at each word, by doubling."""
    if length == 1:
        return h
    half = window_hashes(h, length // 2)
    even = doubled(half, length // 2)
    if length % 2 == 0:
        return even
    return mixed(even[: len(h) - length + 1] * _ONE_MORE + h[length - 1 :]) if len(h) >= length else even[:0]


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) over each run of ``width`` values."""
    reach, run = values, 1
    while 2 * run <= width:
        reach, run = least(reach[:-run], reach[run:]), 2 * run
    rest = width - run
    return least(reach[: len(reach) - rest], reach[rest:]) if rest else reach


def least_halves(halves: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest half-length hash inside each full window, and the distinct
    ones of these."""
    least = _sliding(halves, window - window // 2 + 1, np.minimum)
    return least, np.unique(least)


SIGNED = "n_words long, words_sha256 string, same binary, halves array<long>"


def signatures(text: Column, window: int) -> Column:
    """Struct of word count, digests of the words (``same``, in 128 bits, for
    texts of a window or more) and the half-length hashes handed in."""

    @F.pandas_udf(SIGNED)
    def signed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = words_of(text)
            joined = b" ".join(words)
            same, handed = None, np.zeros(0, np.uint64)
            if len(words) >= window:
                same = hashlib.blake2b(joined, digest_size=16).digest()
                handed = least_halves(window_hashes(word_hashes(words), window // 2), window)[1]
            rows.append((len(words), hashlib.sha256(joined).hexdigest(), same, handed.view(np.int64)))
        return pd.DataFrame(rows, columns=["n_words", "words_sha256", "same", "halves"])

    return signed(text)


def candidate_windows(text: Column, survivors: Column, window: int) -> Column:
    """Arrays of starts and hashes of the full windows whose smallest half survives."""

    @F.pandas_udf("starts array<int>, hashes array<long>")
    def windows(texts: pd.Series, kept: pd.Series) -> pd.DataFrame:
        rows = []
        for text, alive in zip(texts, kept, strict=True):
            halves = window_hashes(word_hashes(words_of(text)), window // 2)
            least = least_halves(halves, window)[0]
            starts = np.flatnonzero(np.isin(least, np.asarray(alive, np.int64).view(np.uint64)))
            full = doubled(halves, window // 2) if window % 2 == 0 else window_hashes(word_hashes(words_of(text)), window)
            rows.append((starts.astype(np.int32), full[starts].view(np.int64)))
        return pd.DataFrame(rows, columns=["starts", "hashes"])

    return windows(text, survivors)


def cut_text(text: Column, starts: Column, window: int) -> Column:
    """Struct of how many words the windows at ``starts`` cover, and the others,
    joined by one space: their digest and, as ``kept_text``, themselves."""

    @F.pandas_udf("n_removed long, kept_sha256 string, kept_text string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for text, at in zip(texts, found, strict=True):
            words = words_of(text)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.asarray(at), 1)
            np.add.at(edge, np.asarray(at) + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g])
            rows.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["n_removed", "kept_sha256", "kept_text"])

    return cut(text, starts)


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """The keys found under more than one id, with the smallest id as ``first_id``."""
    ids = rows.groupBy(key).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return ids.where("first_id < last_id").select(key, "first_id")


def longer_windows(windows: DataFrame, length: int) -> DataFrame:
    """The next level: windows (doc_id, text_key, start, hash) of twice the
    length, where both halves are in ``windows``, that repeat across documents."""
    after = windows.select("doc_id", "text_key", (F.col("start") - length).alias("start"), F.col("hash").alias("second"))
    both = windows.join(after, ["doc_id", "text_key", "start"])
    both = both.select("doc_id", "text_key", "start", F.xxhash64("hash", "second").alias("hash"))
    return both.join(repeated(both, "hash").select("hash"), "hash", "left_semi")


def longest_passages(windows: DataFrame, length: int) -> DataFrame:
    """(doc_id, longest): the greatest length, doubled from ``length``, at which a
    document has a window that repeats; levels go on until no window survives."""
    found = windows.groupBy("doc_id").agg(F.lit(length).alias("longest"))
    while True:
        windows = stored(longer_windows(windows, length))
        if windows.isEmpty():
            return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))
        length *= 2
        found = stored(found.unionByName(windows.groupBy("doc_id").agg(F.lit(length).alias("longest"))))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, texts, windows): the signatures of all rows, the texts that hold
    candidates, and the full windows that repeat across the ids that stand for
    their classes, with the smallest id they occur under."""
    rows = docs.select("doc_id", "text")
    signed = rows.select("doc_id", signatures(F.col("text"), window).alias("s")).select("doc_id", "s.*")
    own_key = F.xxhash64("same").alias("text_key")
    signed = stored(signed.withColumn("same", F.when(F.col("doc_id").isNotNull(), F.col("same"))).select("*", own_key))
    long = signed.where("same is not null")
    classes = stored(long.groupBy("same").agg(F.min("doc_id").alias("first_id")))
    firsts = long.join(classes, "same").where("doc_id = first_id")
    halves = firsts.select("doc_id", "text_key", F.explode("halves").alias("half")).distinct()
    alive = halves.join(repeated(halves, "half").select("half"), "half", "left_semi")
    alive = alive.groupBy("doc_id", "text_key").agg(F.collect_list("half").alias("alive"))
    texts = rows.join(alive, "doc_id")
    texts = stored(texts.where(F.xxhash64(same_of(F.col("text"))) == F.col("text_key")).dropDuplicates(["doc_id", "text_key"]))
    found = candidate_windows(F.col("text"), F.col("alive"), window).alias("w")
    full = texts.select("doc_id", "text_key", found)
    full = full.select("doc_id", "text_key", F.explode(F.arrays_zip("w.starts", "w.hashes")).alias("w"))
    full = stored(full.select("doc_id", "text_key", F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash")))
    return signed, texts, full.join(repeated(full, "hash"), "hash")


def same_of(text: Column) -> Column:
    """The 128-bit digest of a text's words."""

    @F.pandas_udf("binary")
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series([hashlib.blake2b(b" ".join(words_of(t)), digest_size=16).digest() for t in texts], dtype=object)

    return digests(text)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and kept_sha256.
    Removed are the words in windows of ``window`` words that also start in a
    document with a smaller id, judged on the input."""
    if window < 2:
        raise ValueError("a window has two words or more")
    signed, texts, windows = repeated_windows(docs, window)
    later = windows.where("first_id < doc_id").groupBy("doc_id", "text_key").agg(F.collect_list("start").alias("starts"))
    cut = texts.select("doc_id", "text_key", "text").join(later, ["doc_id", "text_key"])
    cut = cut.select("doc_id", "text_key", cut_text(F.col("text"), F.col("starts"), window).alias("cut"))
    cut = stored(cut.select("doc_id", "text_key", "cut.n_removed", "cut.kept_sha256"))
    first = signed.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("first_id"))
    rows = signed.select("doc_id", "n_words", "words_sha256", "same", "text_key")
    rows = rows.join(first, "same", "left").join(cut, ["doc_id", "text_key"], "left")
    copy = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
    )
