"""Toxicity by a convolutional text classifier, trained in numpy.

Words, and their beginnings, are hashed to rows of an embedding table, a word's
embedding being the sum of its own; filters of several widths slide
over the words, each filter keeps its strongest response (max pooling), and a
logistic layer turns these into a score. All labelled rows are learnt from, and
every text is read whole: words are counted by Spark, tasks train on parts of the
rows side by side, and after each round their weights are averaged by Spark.

The threshold is calibrated by language: the score that parts the labels
of all rows best is found for each language that has enough rows of both, and scores
are shifted so that it lies at 0.5. The language of a text to be scored is never
taken from the table but predicted from its words: each language's most telling
words, by naive Bayes over all labelled rows, vote.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageproof.llm.common import stored

#: Rows that a task trains on in a round, about, and how many rounds there are: as
#: many as bring STEPS rows through the weights, between the two bounds.
PART_ROWS = 4500
STEPS = 36_000
ROUNDS = (2, 8)
#: Logits are counted in cells of this width to find thresholds.
CELL = 1e-3
BUCKETS = 1 << 20
DIMENSIONS = 6
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Bytes of the beginnings of a word that are hashed besides the word itself.
BEGINNINGS = (4, 6)
#: Labelled rows that a bucket must occur in to get an embedding, and how far its
#: rows must lean to one label (chi-square): rarer or even ones could only be
#: learnt by heart.
LEAST_ROWS = 4
LEAST_LEANING = 5.0
#: Words that are pooled at a time; memory stays flat for texts of any length.
BLOCK = 20_000
#: Rows of both labels a language must have for a threshold of its own.
CALIBRATION_ROWS = 30
#: Labels and languages that a task counts at a time; each takes 8 bytes a bucket.
MOST_KINDS = 12
#: Bits of the map of labelled ids (4 MB).
BITS = 1 << 25

# ASCII letters in lower case and digits stay, other ASCII becomes a space; bytes
# of other characters stay as they are.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
#: Bytes that are hashed at a time, and of the texts that are judged together.
PIECE = 1 << 18
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9

# Windows see a filter's weights word by word: a pair is a filter and a place in its
# window, by width, place and filter.
N_FILTERS = len(WIDTHS) * FILTERS
_PAIR_AT = {(k, j): FILTERS * (sum(WIDTHS[:k]) + j) for k, w in enumerate(WIDTHS) for j in range(w)}
N_PAIRS = FILTERS * sum(WIDTHS)
_FILTER_OF_PAIR = np.array([k * FILTERS + f for k, w in enumerate(WIDTHS) for _ in range(w) for f in range(FILTERS)])
_PLACE_OF_PAIR = np.array([j for w in WIDTHS for j in range(w) for _ in range(FILTERS)])
_ROWS_OF_FILTERS = -(-N_FILTERS // DIMENSIONS)
#: Rows of the parameters behind the embeddings: pairs, biases, weights, bias.
TAIL = N_PAIRS + 2 * _ROWS_OF_FILTERS + 1


@cache
def _powers(base: int) -> np.ndarray:
    """As many as the longest piece needs, see ``bucket_ids``."""
    powers = np.full(2 * PIECE + 1, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
    return (h >> np.uint64(65 - BUCKETS.bit_length())).astype(np.uint32)


def _hashed(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and their buckets. A word's hash is a polynomial modulo
    2^64, as a difference of running sums."""
    data = np.frombuffer(piece, np.uint8)
    edge = np.diff((data != 32).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ids = np.empty((len(starts), 1 + len(BEGINNINGS)), np.uint32)
    if not len(starts):
        return starts, ids
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * _powers(_BASE)[: len(data)], out=sums[1:])
    ids[:, 0] = _bucket((sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64))[starts])
    beginning = np.zeros(len(starts), np.uint64)
    last = len(data) - 1
    for j in range(max(BEGINNINGS)):
        at = starts + j
        byte = np.where(at < ends, data[np.minimum(at, last)], 0).astype(np.uint64)
        beginning |= byte << np.uint64(8 * j)
        if j + 1 in BEGINNINGS:
            ids[:, 1 + BEGINNINGS.index(j + 1)] = _bucket((beginning + np.uint64(j + 1 << 56)) * np.uint64(_BASE))
    return starts, ids


def bucket_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words of all texts, a row each: the word's and its
    beginnings'; and how many words each text has. Memory for hashing stays flat:
    a word longer than PIECE stands alone, by its CRC-32."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(data).translate(_WORD_BYTES)
    found, at = [], 0
    while at < len(joined):
        to = joined.find(b" ", at + PIECE)
        to = len(joined) if to < 0 else to
        last = max(at, joined.rfind(b" ", at, at + PIECE) + 1)
        long = to - last > PIECE
        starts, ids = _hashed(joined[at : last if long else to])
        found.append((starts + at, ids))
        if long:
            ids = _hashed(joined[last : last + max(BEGINNINGS)])[1]
            ids[0, 0] = _bucket(np.array([crc32(joined[last:to])], np.uint64))[0]
            found.append((np.array([last]), ids))
        at = to
    starts = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
    ids = np.concatenate([np.zeros((0, 1 + len(BEGINNINGS)), np.uint32), *(f[1] for f in found)])
    bounds = np.cumsum([0, *(len(d) + 1 for d in data)])
    return ids, np.diff(np.searchsorted(starts, bounds))


def _groups(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Texts in groups of about PIECE characters; longer ones are alone."""
    group: list[str | None] = []
    size = 0
    for text in texts:
        n = len(text or "") + 1
        if group and size + n > PIECE:
            yield group
            group, size = [], 0
        group.append(text)
        size += n
    if group:
        yield group


@dataclass
class Model:
    """Embedding rows are kept only for buckets that training has touched
    (``rows`` maps buckets to them, row 0 is zero). ``params`` has these rows and,
    behind them, TAIL more: filters by pair, biases, weights and the bias.
    ``lang_rows`` maps buckets of telling words to rows of ``lang_weights``, which
    has a column for each of ``langs``; row 0 stands for no such word."""

    rows: np.ndarray
    params: np.ndarray
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0
    langs: list[str] = field(default_factory=list)
    lang_weights: np.ndarray | None = None
    lang_rows: np.ndarray | None = None

    @property
    def table(self) -> np.ndarray:
        return self.params[:-TAIL]

    @property
    def filters(self) -> np.ndarray:
        return self.params[-TAIL:][:N_PAIRS]

    @property
    def biases(self) -> np.ndarray:
        return self.params[-TAIL:][N_PAIRS : N_PAIRS + _ROWS_OF_FILTERS].ravel()[:N_FILTERS]

    @property
    def weights(self) -> np.ndarray:
        return self.params[-TAIL:][N_PAIRS + _ROWS_OF_FILTERS : -1].ravel()[:N_FILTERS]

    @property
    def bias(self) -> np.ndarray:
        return self.params[-1, :1]

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        """Embeddings of words, summed over their buckets."""
        table = self.table
        return sum((table[rows[:, k]] for k in range(1, rows.shape[1])), table[rows[:, 0]])

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Of all filters to the windows that start at each row but the last ones.
        Windows that touch no known bucket respond with their bias alone, which
        counts as none. Sums are made in double precision, so that a text's response
        doesn't hang on its neighbours."""
        n = len(rows) - max(WIDTHS) + 1
        each = (self.embedded(rows).astype(float) @ self.filters.T.astype(float)).astype(np.float32)
        known, out = rows.any(axis=1), np.empty((n, N_FILTERS), np.float32)
        out[:] = self.biases
        near = np.zeros(n, bool)
        for k, width in enumerate(WIDTHS):
            own = out[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                own += each[j : j + n, _PAIR_AT[k, j] : _PAIR_AT[k, j] + FILTERS]
                near |= known[j : j + n]
            own *= near[:, None]
        return out

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strongest response of each filter and the word where its window starts,
        from the padded table rows of a text."""
        best, where = np.zeros(N_FILTERS, np.float32), np.full(N_FILTERS, -1)
        for at in range(0, len(rows) - max(WIDTHS) + 1, BLOCK):
            response = self.responses(rows[at : at + BLOCK + max(WIDTHS) - 1])
            top = response.argmax(axis=0)
            value = response[top, np.arange(N_FILTERS)]
            better = value > best
            best = np.where(better, value, best)
            where = np.where(better, top + at, where)
        return best, where

    def logits(self, rows: np.ndarray, n_rows: np.ndarray) -> np.ndarray:
        """Of texts whose (shortened) table rows follow each other."""
        far = max(WIDTHS) - 1
        owner = np.repeat(np.arange(len(n_rows)), n_rows)
        at = np.arange(len(rows)) + far * owner
        padded = np.zeros((len(rows) + far * len(n_rows), rows.shape[1]), rows.dtype)
        padded[at] = rows
        best = np.zeros((len(n_rows), N_FILTERS), np.float32)
        for first in range(0, len(rows), BLOCK):
            own, to = owner[first : first + BLOCK], at[first : first + BLOCK]
            response = self.responses(padded[to[0] : to[-1] + far + 1])[to - to[0]]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            best[own[cuts]] = np.maximum(best[own[cuts]], np.maximum.reduceat(response, cuts, axis=0))
        return best.astype(float) @ self.weights.astype(float) + float(self.bias[0])

    def languages(self, ids: np.ndarray, n_words: np.ndarray) -> list[str | None]:
        """By text the language whose telling words fit best; None if none occurs."""
        if self.lang_weights is None:
            return [None] * len(n_words)
        known = self.lang_rows[ids[:, 0]]
        at = np.flatnonzero(known)
        owner, known = np.repeat(np.arange(len(n_words)), n_words)[at], known[at]
        sums = np.stack([np.bincount(owner, self.lang_weights[known, k], len(n_words)) for k in range(len(self.langs))])
        some = np.bincount(owner, minlength=len(n_words))
        return [self.langs[k] if n else None for k, n in zip(sums.argmax(axis=0), some, strict=True)]

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        """0 to 1; 0.5 is the threshold of a text's predicted language."""
        out = []
        for group in _groups(texts):
            ids, n_words = bucket_ids(group)
            cuts = [self.thresholds.get(lang, self.threshold) for lang in self.languages(ids, n_words)]
            z = self.logits(*shortened_all(self.rows[ids], n_words)) - np.array(cuts)
            out.extend((1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist())
        return out

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By label the rows that each bucket occurs in, by language its words."""
    found: dict[tuple, np.ndarray] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (toxic, lang), counts in found.items():
            bucket = np.flatnonzero(counts)
            kind = [pa.array([toxic] * len(bucket), pa.int32()), pa.array([lang] * len(bucket), pa.string())]
            yield pa.RecordBatch.from_arrays([*kind, pa.array(bucket.astype(np.int32)), pa.array(counts[bucket])], ["toxic", "lang", "bucket", "n"])
        found.clear()

    def add(key: tuple, parts: list[np.ndarray]) -> None:
        if key not in found:
            found[key] = np.zeros(BUCKETS, np.int64)
        np.add.at(found[key], np.concatenate(parts), 1)

    for batch in batches:
        labels = iter(zip(batch["lang"].to_pylist(), batch["toxic"].to_pylist(), strict=True))
        for group in _groups(batch["text"].to_pylist()):
            ids, n_words = bucket_ids(group)
            parts: dict[tuple, list[np.ndarray]] = {}
            for own in np.split(ids, np.cumsum(n_words)[:-1]):
                lang, toxic = next(labels)
                parts.setdefault((int(toxic), None), []).append(np.unique(own))
                if lang is not None:
                    parts.setdefault((None, lang), []).append(own[:, 0])
            for key, of in parts.items():
                add(key, of)
        if len(found) > MOST_KINDS:
            yield from flushed()
    yield from flushed()


def _leaning(counts: DataFrame, n_rows: dict[int, int]) -> np.ndarray:
    """Buckets that get an embedding: they occur in enough rows, and lean. There
    are at most BUCKETS."""
    total = sum(n_rows.values())
    own = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("n")).otherwise(0))
    rows = counts.where("toxic is not null").groupBy("bucket").agg(own(0).alias("n_0"), own(1).alias("n_1"))
    both = F.col("n_0") + F.col("n_1")
    expected = {k: both * F.lit(float(n)) / F.lit(float(max(1, total))) for k, n in n_rows.items()}
    apart = [F.try_divide(F.pow(F.col(f"n_{k}") - expected[k], F.lit(2)), expected[k]) for k in n_rows]
    spread = F.try_divide(apart[0] + apart[1], 1 - both / F.lit(float(max(1, total))))
    kept = rows.where((both >= LEAST_ROWS) & (spread >= LEAST_LEANING))
    return np.sort(kept.select("bucket").toArrow()["bucket"].to_numpy().astype(np.int64))


def _fresh(seen: np.ndarray, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    rows = np.zeros(BUCKETS, np.int32)
    rows[seen] = np.arange(1, len(seen) + 1)
    model = Model(rows, np.zeros((len(seen) + 1 + TAIL, DIMENSIONS), np.float32))
    model.table[1:] = rng.normal(0, 0.1, (len(seen), DIMENSIONS))
    model.filters[:] = rng.normal(0, 0.5, (N_PAIRS, DIMENSIONS))
    model.weights[:] = rng.normal(0, 0.5, N_FILTERS)
    return model


def shortened_all(known: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of texts without words that no window with a known bucket
    reaches: such windows stay the same, and others aren't pooled. And how many
    rows each text has left."""
    at = np.flatnonzero(known.any(axis=1))
    owner = np.repeat(np.arange(len(n_words)), n_words)[at]
    before = np.concatenate([[-1], at])[:-1]
    first = np.diff(owner, prepend=-1) != 0
    before[first] = (np.cumsum(n_words) - n_words)[owner[first]] - 1
    steps = np.minimum(at - before, max(WIDTHS))
    to = np.cumsum(steps) - 1
    rows = np.zeros((int(steps.sum()), known.shape[1]), known.dtype)
    rows[to] = known[at]
    return rows, np.bincount(owner, steps, len(n_words)).astype(np.int64)


def shortened(known: np.ndarray) -> np.ndarray:
    return shortened_all(known, np.array([len(known)]))[0]


def _padded(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, np.zeros((max(WIDTHS) - 1, rows.shape[1]), rows.dtype)])


def _train(model: Model, sums: np.ndarray, rows: np.ndarray, label: int, weight: float, rate: float = 0.05) -> None:
    """One stochastic gradient with per-weight step sizes (Adagrad): it flows
    through the one window that each filter has pooled. Embedding rows shrink a
    little at each use, so words without meaning fade to zero."""
    params, weights = model.params, model.weights
    best, where = model.pooled(rows)
    z = float(best @ weights + model.bias[0])
    gap = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label) * weight
    if abs(gap) < 1e-3:
        return
    flow = gap * weights * (where >= 0)
    tail = Model(model.rows, np.zeros((TAIL, DIMENSIONS), np.float32))
    tail.weights[:] = gap * best + 1e-4 * weights
    tail.bias[:] = gap
    tail.biases[:] = flow
    at = where[_FILTER_OF_PAIR]
    use = np.flatnonzero(at >= 0)
    if len(use):
        words = rows[at[use] + _PLACE_OF_PAIR[use]]
        back = flow[_FILTER_OF_PAIR[use]][:, None]
        tail.params[use] = back * model.embedded(words)
        into = back * model.filters[use]
        bucket = words.ravel()
        order = bucket.argsort()
        bucket = bucket[order]
        cuts = np.flatnonzero(np.concatenate([bucket[:1] >= 0, bucket[1:] != bucket[:-1]]))
        touched = bucket[cuts]
        gradient = np.add.reduceat(into[order // words.shape[1]], cuts) + 1e-3 * params[touched]
        if not touched[0]:
            gradient[0] = 0
        total = sums[touched] + gradient * gradient
        sums[touched] = total
        # Windows of all widths share this step; it is as long as one for each.
        params[touched] -= rate * len(WIDTHS) ** 0.5 * gradient / np.sqrt(total)
    total = sums[-TAIL:]
    total += tail.params * tail.params
    params[-TAIL:] -= rate * tail.params / np.sqrt(total)


def _rows(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(data, np.int32).reshape(-1, 1 + len(BEGINNINGS)) for data in batch["rows"].to_pylist()]


def fit(rows: DataFrame, model: Model, n_rows: dict[int, int]) -> None:
    """Train on table rows (rows, toxic). In each round every partition trains a
    copy of the weights on all its rows; what changed is averaged over the
    partitions that changed it, row by row, and reaches the driver once."""
    total = sum(n_rows.values())
    weight = {k: 0.5 * total / max(1, n) for k, n in n_rows.items()}
    sums = np.full(model.params.shape, 1e-2, np.float32)
    context = rows.sparkSession.sparkContext
    names = [f"{c}{k}" for c in "dm" for k in range(DIMENSIONS)]
    for number in range(min(ROUNDS[1], max(ROUNDS[0], -(-STEPS // max(1, total))))):
        shared = context.broadcast((model, sums))

        def trained(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            given, given_sums = shared.value
            own, own_sums = replace(given, params=given.params.copy()), given_sums.copy()
            order = np.random.default_rng(number)
            for batch in batches:
                texts, labels = [_padded(r) for r in _rows(batch)], batch["toxic"].to_pylist()
                for i in order.permutation(len(texts)):
                    _train(own, own_sums, texts[i], labels[i], weight[labels[i]])
            at = np.flatnonzero((own_sums != given_sums).any(axis=1))
            moved = [(own.params - given.params)[at], (own_sums - given_sums)[at]]
            columns = [pa.array(np.ascontiguousarray(m[:, k])) for m in moved for k in range(DIMENSIONS)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *columns], ["i", *names])

        changed = rows.mapInArrow(trained, "i int, " + ", ".join(f"{c} float" for c in names))
        merged = changed.groupBy("i").agg(*(F.avg(c).cast("float").alias(c) for c in names)).toArrow()
        at = merged["i"].to_numpy()
        d, more = (np.stack([merged[c].to_numpy() for c in part], axis=1) for part in (names[:DIMENSIONS], names[DIMENSIONS:]))
        model.params[at] += d
        sums[at] += more
        shared.unpersist()


def _best_threshold(z: np.ndarray, n_0: np.ndarray, n_1: np.ndarray) -> float:
    """The cut in the middle of the widest best gap for balanced accuracy, from
    ascending logits and how many rows of each label have them."""
    below = np.cumsum(n_0) / max(1, n_0.sum()) + 1 - np.cumsum(n_1) / max(1, n_1.sum())
    cuts = np.flatnonzero(below[:-1] >= below[:-1].max() - 1e-9) if len(z) > 1 else []
    if not len(cuts):
        return 0.0
    best = max(cuts, key=lambda c: z[c + 1] - z[c])
    return float((z[best] + z[best + 1]) / 2)


def calibrate(model: Model, rows: DataFrame, counts: DataFrame) -> None:
    """Set thresholds by language and the words that tell languages apart, both
    from all rows; at most 3,000 words and the cells of the logits are collected."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _rows(batch)
            z = shared.value.logits(np.concatenate(texts), np.array([len(t) for t in texts])) if texts else np.zeros(0)
            cells = np.round(np.clip(z, -30, 30) / CELL).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["toxic"], pa.array(cells)], ["lang", "toxic", "cell"])

    own = lambda label: F.sum((F.col("toxic") == label).cast("long"))
    cells = rows.mapInArrow(judged, "lang string, toxic int, cell int").groupBy("lang", "cell").agg(own(0).alias("n_0"), own(1).alias("n_1")).toPandas()
    cut = lambda of: _best_threshold(of.index.to_numpy() * CELL, of["n_0"].to_numpy(), of["n_1"].to_numpy())
    model.threshold = cut(cells.groupby("cell")[["n_0", "n_1"]].sum())
    for lang, of in cells.groupby("lang"):
        if of[["n_0", "n_1"]].sum().min() >= CALIBRATION_ROWS:
            model.thresholds[lang] = cut(of.set_index("cell").sort_index())
    words = counts.where("lang is not null")
    common = words.groupBy("bucket").agg(F.sum("n").alias("total")).where("total >= 20").orderBy(F.desc("total"), "bucket").limit(3000)
    table = words.join(common, "bucket").toPandas().pivot_table(index="bucket", columns="lang", values="n", aggfunc="sum", fill_value=0)
    known = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    if known and len(table):
        smooth = table.reindex(columns=known, fill_value=0).sort_index().to_numpy(float).T + 0.5
        logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        model.langs, model.lang_rows = known, np.zeros(BUCKETS, np.int32)
        model.lang_rows[np.sort(table.index.to_numpy())] = np.arange(1, len(table) + 1)
        model.lang_weights = np.concatenate([np.zeros((1, len(known))), (logs - logs.mean(axis=0)).T])


def likely(docs: DataFrame, usable: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id may be in usable, all that are and few others: by
    a bitmap of the ids' hashes, which has BITS bits at any size."""
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(BITS)) + 1
    part, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = usable.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = docs.join(F.broadcast(maps), (part == F.col("part")) & (F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1))
    return found.select(*docs.columns)


def labelled(docs: DataFrame, usable: DataFrame) -> DataFrame:
    """Texts with a label, from (doc_id, text, lang) and (doc_id, toxic). Texts are
    wide, so few that have no label get into the shuffle of the join. It is a shuffle
    at any size: labels aren't sent whole to all tasks."""
    return likely(docs, usable).join(usable.hint("merge"), "doc_id")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the texts (doc_id, text, lang) of all labelled ids (doc_id,
    toxic); rows with a null id, or a label other than 0 and 1, aren't used. No rows
    teach nothing: scores are 0.5."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    texts = stored(labelled(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), usable))
    n_rows = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    found = texts.mapInArrow(_counted, "toxic int, lang string, bucket int, n long")
    counts = stored(found.groupBy("toxic", "lang", "bucket").agg(F.sum("n").alias("n")))
    model = _fresh(_leaning(counts, n_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model.rows)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for group in _groups(batch["text"].to_pylist()):
                ids, n_words = bucket_ids(group)
                short, n_short = shortened_all(shared.value[ids], n_words)
                rows += [r.tobytes() for r in np.split(short, np.cumsum(n_short)[:-1])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["toxic"], pa.array(rows, pa.binary())], ["doc_id", "lang", "toxic", "rows"])

    shuffled = F.xxhash64("doc_id", F.lit(11))
    parts = max(1, sum(n_rows.values()) // PART_ROWS)
    rows = texts.mapInArrow(known, f"doc_id {dict(texts.dtypes)['doc_id']}, lang string, toxic int, rows binary")
    rows = rows.repartition(parts, "doc_id").sortWithinPartitions(shuffled, "doc_id", "toxic").persist()
    fit(rows, model, n_rows)
    calibrate(model, rows, counts)
    rows.unpersist()
    return model


def score(text: Column, model: Model) -> Column:
    """The score of a text; the model travels to the workers once, as a broadcast
    of a size bounded by BUCKETS."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts), dtype=float)

    return scored(text)
