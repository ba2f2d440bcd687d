"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams in the
learning rows, by rank. A document's own most frequent n-grams are ranked in the
same way; its distance to a profile adds up how far each n-gram is out of place,
or the length of the profile for one that the profile lacks. The nearest profile
names the language.

N-grams are of 1 to 3 characters of the lower-cased text; runs of anything but
letters count as one space, as do the text's ends. N-gram codes pack characters
exactly, so counts are exact, over all learning rows and whole texts.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: N-grams in a profile, of a language and of a document.
PROFILE = 300
#: Code points that learning counts at a time.
CHUNK_CHARS = 500_000
UNDECIDED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool)


#: Stands for what isn't a letter; not 0, so that a code tells how long it is.
_GAP = 1


def _symbols(text: str) -> np.ndarray:
    """Lower-case letters as code points, all else as single gaps, one at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    padded = np.full(len(codes) + 2, _GAP, dtype=np.uint64)
    padded[1:-1] = np.where(_letters()[codes], codes, _GAP)
    return padded[np.concatenate(([True], (padded[1:] != _GAP) | (padded[:-1] != _GAP)))]


def _count(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending, and counts of the n-grams; a gap alone isn't one."""
    two = (symbols[:-1] << np.uint64(21)) | symbols[1:]
    three = (two[:-1] << np.uint64(21)) | symbols[2:]
    return np.unique(np.concatenate([symbols[symbols != _GAP], two, three]), return_counts=True)


def _ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """Codes by falling count, ties by code, at most ``most``."""
    if len(codes) > 4 * most:
        least = np.partition(counts, -most)[-most]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")][:most]


class Profiles:
    """Profiles of several languages, ready to be compared with a document."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        every = sorted({c for p in profiles.values() for c in p})
        self.codes = np.array(every, dtype=np.uint64)
        self.ranks = np.full((len(every), len(self.langs)), -1, dtype=np.int64)
        where = {c: i for i, c in enumerate(every)}
        for j, lang in enumerate(self.langs):
            for rank, code in enumerate(profiles[lang]):
                self.ranks[where[code], j] = rank

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language."""
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        ranks = np.where((self.codes[at] == top)[:, None], self.ranks[at], -1)
        apart = np.abs(ranks - np.arange(len(top))[:, None])
        return np.where(ranks < 0, PROFILE, apart).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how sure it is, from 0 (as near to another language,
        or nothing in common) to 1."""
        symbols = _symbols(text or "")
        if len(symbols) < 2 or not self.langs:
            return UNDECIDED, 0.0
        top = _ranked(*_count(symbols))
        distance = self.distances(top)
        best = int(distance.argmin())
        most = PROFILE * len(top)
        if len(self.langs) == 1:
            return self.langs[0], float(1 - distance[best] / most)
        second = np.partition(distance, 1)[1]
        return self.langs[best], float((second - distance[best]) / second) if second else 0.0


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}

    def counted(lang: str) -> pa.RecordBatch:
        codes, counts = _count_parts(held.pop(lang))
        sizes.pop(lang)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(counts.astype(np.int64))],
            ["lang", "code", "n"],
        )

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            symbols = _symbols(text)
            held.setdefault(lang, []).append(symbols)
            sizes[lang] = sizes.get(lang, 0) + len(symbols)
            if sizes[lang] >= CHUNK_CHARS:
                yield counted(lang)
    for lang in list(held):
        yield counted(lang)


def _count_parts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts over several texts laid end to end. One text has no two gaps in a
    row, so n-grams that hold two lie across texts and are left out."""
    codes, counts = _count(np.concatenate(parts))
    low = np.uint64((1 << 21) - 1)
    gap = [(codes >> np.uint64(21 * k)) & low == _GAP for k in range(3)]
    own = ~((gap[0] & gap[1]) | (gap[1] & gap[2]))
    return codes[own], counts[own]


def learn(rows: DataFrame) -> Profiles:
    """Profiles from rows with ``text`` and ``lang``; rows with a null in either
    teach nothing. Chunks are counted in the tasks, counts are summed by Spark,
    and only the profiles, PROFILE codes a language, reach the driver."""
    usable = rows.select("lang", "text").where("lang is not null and text is not null")
    counted = usable.mapInArrow(_chunk_counts, "lang string, code long, n long")
    summed = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = summed.withColumn("place", place).where(F.col("place") <= PROFILE).orderBy("lang", "place").collect()
    profiles: dict[str, list[int]] = {}
    for row in best:
        profiles.setdefault(row["lang"], []).append(row["code"] % 2**64)
    return Profiles(profiles)


def predict(text: Column, profiles: Profiles) -> Column:
    """Struct of ``lang_pred`` and ``score``. Null texts and those without a
    letter get ``und`` and 0."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predicted(text)


def accepted(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The documents that have a language, with all their columns: those whose
    text is null or has no letter go."""
    return docs.where(predict(F.col("text"), profiles)["lang_pred"] != UNDECIDED)
