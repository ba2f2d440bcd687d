"""Sequence alignment and word diff: the one part that needs Python.

Both run as Arrow-batched UDFs on values that already sit in one row.
A row of the alignment table is one integer whose bits say where the length
grows, so a row costs a few word-parallel operations. Long inputs keep only
every k-th row and refill one band at a time while walking: memory grows with
m*sqrt(n) bits and no input is ever cut.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIFF_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("expected", T.StringType()),
            T.StructField("actual", T.StringType()),
        ]
    )
)

_SEGMENTS_HELD = 20_000
_DIRECT_CELLS = 1 << 29  # up to here (64 MB of bits) all rows are kept


def _rows(a, masks, full, row, lo, hi):
    """Rows hi-1 .. lo of the table from ``row`` (row hi), nearest first.

    Bit p of a row is set where the common length of a[i:] and the last p+1
    elements of b exceeds that of the last p.
    """
    v = full & ~row
    for i in range(hi - 1, lo - 1, -1):
        hit = v & masks[a[i]]
        v = ((v + hit) | (v - hit)) & full
        yield full & ~v


def lcs_alignment(a, b) -> list:
    """Index in ``b`` per element of ``a`` on a longest common subsequence.

    On ties the walk drops the element of ``a`` first. Elements of ``a`` that
    ``b`` lacks are always dropped by that rule, so they skip the table, and
    equal beginnings are matched outright.
    """
    out: list = [None] * len(a)
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        out[head] = head
        head += 1
    m = len(b) - head
    masks: dict = {}
    for j in range(head, len(b)):
        masks[b[j]] = masks.get(b[j], 0) | 1 << (len(b) - 1 - j)
    keep = [i for i in range(head, len(a)) if a[i] in masks]
    n = len(keep)
    if not n:
        return out
    seq, full = [a[i] for i in keep], (1 << m) - 1
    band = n if n * m <= _DIRECT_CELLS else max(64, int((32 * n) ** 0.5))
    starts = list(range(0, n, band))
    below, row = {}, 0
    for lo in reversed(starts):
        below[lo] = row
        if lo:
            for row in _rows(seq, masks, full, row, lo, min(lo + band, n)):
                pass
    j = 0
    for lo in starts:
        hi = min(lo + band, n)
        kept = [below[lo], *_rows(seq, masks, full, below.pop(lo), lo, hi)]
        kept.reverse()  # kept[k] is row lo + k
        i = lo
        while i < hi and j < m:
            here, after = kept[i - lo], kept[i - lo + 1]
            tail = (1 << (m - j)) - 1
            # Lengths from (i, j) and (i + 1, j), updated as j advances.
            length, below_length = (here & tail).bit_count(), (after & tail).bit_count()
            while j < m:
                if seq[i] == b[head + j]:
                    out[keep[i]] = head + j
                    j += 1
                    break
                grows = here >> (m - 1 - j) & 1
                if grows or below_length == length:
                    break
                below_length -= after >> (m - 1 - j) & 1
                j += 1
            i += 1
        if j >= m:
            break
    return out


def word_diff(expected: str, actual: str) -> list:
    """Segments same / changed / removed / added over white-space tokens."""
    et = re.split(r"\s+", expected.strip()) if expected.strip() else []
    at = re.split(r"\s+", actual.strip()) if actual.strip() else []
    matched = lcs_alignment([t.lower() for t in et], [t.lower() for t in at])
    segments: list = []
    i = j = 0
    anchors = [(x, y) for x, y in enumerate(matched) if y is not None] + [(len(et), len(at))]
    for x, y in anchors:
        if i < x or j < y:
            gone, new = et[i:x], at[j:y]
            both = min(len(gone), len(new))
            segments += [("changed", g, n) for g, n in zip(gone, new)]
            segments += [("removed", g, None) for g in gone[both:]]
            segments += [("added", None, n) for n in new[both:]]
        if x < len(et):
            segments.append(("same", et[x], at[y]))
        i, j = x + 1, y + 1
    return segments


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def lcs_align(a: pd.Series, b: pd.Series) -> pd.Series:
    """0-based partner in ``b`` for each element of ``a``; NULL when none."""
    return pd.Series(
        [None if x is None or y is None else lcs_alignment(list(x), list(y)) for x, y in zip(a, b)], dtype=object
    )


def diff_array(expected, actual) -> pa.Array:
    """Diffs of a batch as one Arrow array. Segments turn into Arrow columns every
    _SEGMENTS_HELD, so as Python objects there are never many more than the
    longest diff has, however many rows a batch brings."""
    kind = pa.struct([(f.name, pa.string()) for f in DIFF_TYPE.elementType.fields])
    done, held, ends, total = [], [], [0], 0
    nulls = []

    def flush() -> None:
        columns = zip(*held) if held else ([], [], [])
        done.append(pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(kind)))
        held.clear()

    for e, a in zip(expected, actual):
        e, a = e.as_py(), a.as_py()
        nulls.append(e is None or a is None)
        if not nulls[-1]:
            held += word_diff(e, a)
        if len(held) >= _SEGMENTS_HELD:
            total += len(held)
            ends.append(total)
            flush()
        else:
            ends.append(total + len(held))
    flush()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(done), mask=pa.array(nulls, pa.bool_()))


@F.arrow_udf(DIFF_TYPE)
def diff_words(expected: pa.Array, actual: pa.Array) -> pa.Array:
    return diff_array(expected, actual)


# Keeps the optimiser from evaluating a call twice to push a filter below it.
lcs_align = lcs_align.asNondeterministic()
diff_words = diff_words.asNondeterministic()


def diff_summary(diff, subject="Paragraph text") -> Column:
    """One sentence on a diff: counts per kind and one example."""
    diff = F.col(diff) if isinstance(diff, str) else diff
    subject = F.lit(subject) if isinstance(subject, str) else subject
    of = lambda kind: F.filter(diff, lambda s: s["type"] == kind)

    def part(kind: str, verb: str) -> Column:
        n = F.size(of(kind))
        noun = F.when(n == 1, F.lit(" word ")).otherwise(F.lit(" words "))
        return F.when(n > 0, F.concat(n.cast("string"), noun, F.lit(verb)))

    parts = F.concat_ws(", ", part("changed", "changed"), part("removed", "missing"), part("added", "added"))
    first = lambda kind, side: F.get(of(kind), F.lit(0))[side]
    example = (
        F.when(
            F.size(of("changed")) > 0,
            F.concat(F.lit(' (e.g. "'), first("changed", "expected"), F.lit('" → "'), first("changed", "actual"), F.lit('")')),
        )
        .when(F.size(of("removed")) > 0, F.concat(F.lit(' (e.g. missing "'), first("removed", "expected"), F.lit('")')))
        .when(F.size(of("added")) > 0, F.concat(F.lit(' (e.g. extra "'), first("added", "actual"), F.lit('")')))
        .otherwise(F.lit(""))
    )
    return F.when(parts == "", F.concat(subject, F.lit(" has changed."))).otherwise(
        F.concat(subject, F.lit(" has changed — "), parts, example, F.lit("."))
    )
