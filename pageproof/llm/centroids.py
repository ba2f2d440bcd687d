"""Centroid clustering of integer vectors with a LAESA pivot table.

Every vector's distances to a few fixed pivots are computed once and stored. By
the triangle inequality, the difference between a vector's and a centroid's
distance to a pivot bounds their own distance from below, so each round compares
the stored numbers with the few distances between pivots and centroids first.
Only centroids whose bound does not exceed the best distance found so far are
held against the vector itself, in exact integers. Bounds are floating point
numbers with a margin far above their error; they never decide, they only skip.

A round is one scan of the stored table. Each batch sums its vectors by centroid
before anything is shuffled, so a cluster with most of the vectors costs no more
than others; the driver sees the centroids alone, ``k`` rows of fixed width.

Kept are vectors of DIMENSIONS components, all finite. Rows with a null id are
clustered, but never a starting centroid. Repeated rows count as often as they
occur; among rows with one id, the one with smaller components starts first.
Components of any size are computed exactly, beyond SMALL in Python integers; a
distance or inertia that does not fit a long is null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageproof.llm.common import stored

DIMENSIONS = 64
SCALE = 256
#: Centroids, rounds of replacing them, and pivots of the table.
CENTROIDS, ROUNDS, PIVOTS = 40, 5, 12
#: Up to this size of components, squared distances fit 64-bit integers.
SMALL = 2**27
#: Far above the relative error of a square root, far below what bounds differ by.
MARGIN = 1e-9
#: Bits of one part of a sum; the parts of sums add up without overflow.
LIMB = 32


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite floating point numbers: 64-bit integers, or
    Python's where one is beyond SMALL."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() <= SMALL / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    # From 2^52 on, a floating point number is whole.
    exact = [math.floor(v * SCALE) if abs(v) < 2.0**52 else int(v) * SCALE for v in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to one centre."""
    if vectors.dtype == object or centre.dtype == object:
        apart = vectors.astype(object) - centre.astype(object)
        return (apart * apart).sum(axis=1)
    apart = vectors - centre
    return np.einsum("ij,ij->i", apart, apart)


def roots(squares: np.ndarray) -> np.ndarray:
    """Distances as floating point numbers. Those beyond their range are cut to
    it, which leaves the differences of two of them lower bounds."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([math.sqrt(s) if s < 2**1000 else float(min(math.isqrt(s), 2**1000)) for s in squares], dtype=np.float64)


def chosen_pivots(centres: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Of the centres, ``count`` that lie far apart: each next one has the
    greatest sum of distances to those before."""
    picked, total = [0], roots(squared(centres, centres[0]))
    while len(picked) < min(count, len(centres)):
        total[picked] = -1.0
        picked.append(int(total.argmax()))
        total = sum(roots(squared(centres, centres[p])) for p in picked)
    return centres[picked]


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([roots(squared(vectors, p)) for p in pivots], axis=1)


def nearest(vectors: np.ndarray, table: np.ndarray, centres: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each vector the number of its nearest centre (ties: the smaller one)
    and the squared distance; and how many distances were computed. ``table``
    holds the vectors' distances to the pivots."""
    n, rows = len(vectors), np.arange(len(vectors))
    between = pivot_distances(centres, pivots)
    bounds = np.zeros((n, len(centres)))
    for p in range(len(pivots)):
        np.maximum(bounds, np.abs(table[:, p, None] - between[None, :, p]), out=bounds)
    # What rounding may have added goes off the bound again.
    bounds -= MARGIN * (table.max(axis=1)[:, None] + between.max(axis=1)[None, :])
    order = bounds.argmin(axis=1)
    wide = vectors.dtype == object or centres.dtype == object
    best = np.empty(n, dtype=object if wide else np.int64)
    computed = n
    for c in np.unique(order):
        at = order == c
        best[at] = squared(vectors[at], centres[c])
    best_number, reach = order.copy(), roots(best) * (1 + MARGIN)
    for c in range(len(centres)):
        at = rows[(bounds[:, c] <= reach) & (order != c)]
        if not len(at):
            continue
        computed += len(at)
        found = squared(vectors[at], centres[c])
        better = (found < best[at]) | ((found == best[at]) & (c < best_number[at]))
        at, found = at[better], found[better]
        best[at], best_number[at], reach[at] = found, c, roots(found) * (1 + MARGIN)
    return best_number, best, computed


def limbs(value: int) -> list[int]:
    """An integer as parts of LIMB bits, the last one signed."""
    parts = []
    while not -(2**62) <= value < 2**62:
        parts.append(value & (2**LIMB - 1))
        value >>= LIMB
    return [*parts, value & (2**LIMB - 1), value >> LIMB]


def whole(parts: Sequence[int]) -> int:
    return sum(int(p) << (LIMB * i) for i, p in enumerate(parts))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(flat), -1)


def _by_centre(vectors: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, int, list[list[int]]]]:
    """(centre, vectors, sums by limb and component) of a batch."""
    for c in np.unique(numbers):
        own = vectors[numbers == c]
        parts = [limbs(int(v)) for v in own.sum(axis=0)]
        deep = max(map(len, parts))
        # A sum with fewer parts is continued by its sign.
        for i, p in enumerate(parts):
            if len(p) < deep:
                value = whole(p)
                parts[i] = [(value >> (LIMB * k)) & (2**LIMB - 1) for k in range(deep - 1)] + [value >> (LIMB * (deep - 1))]
        yield int(c), len(own), [[p[k] for p in parts] for k in range(deep)]


def kept_vectors(df: DataFrame, vec: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows whose vector has all its components, none null or not finite."""
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return df.where((F.size(vec) == dimensions) & finite)


def starting_centroids(kept: DataFrame, id_col: str = "vec_id", vec: str = "embedding", count: int = CENTROIDS) -> np.ndarray:
    """The vectors with the smallest sha256 of ``2:<id>``, in ascending order: at
    most ``count`` rows reach the driver."""
    place = F.sha2(F.concat(F.lit("2:"), F.col(id_col).cast("string")), 256)
    first = kept.where(F.col(id_col).isNotNull()).select(place.alias("place"), F.col(vec).alias("v"))
    rows = first.orderBy("place", "v").limit(count).collect()
    return scaled(np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0))


def pivot_table(kept: DataFrame, pivots: np.ndarray, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, vector, table): each vector with its distances to the pivots, stored."""
    rows = kept.select(F.col(id_col).alias("id"), F.col(vec).alias("vector"))
    schema = T.StructType([*rows.schema.fields, T.StructField("table", T.ArrayType(T.DoubleType()))])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            far = pivot_distances(scaled(_matrix(batch.column("vector"), np.float64)), pivots)
            at = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * far.shape[1])
            table = pa.ListArray.from_arrays(at, pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, table], names=["id", "vector", "table"])

    return stored(rows.mapInArrow(measured, schema))


def moved(table: DataFrame, centres: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of their vectors' means; those
    without vectors stay."""
    width = centres.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = scaled(_matrix(batch.column("vector"), np.float64))
            numbers = nearest(vectors, _matrix(batch.column("table"), np.float64), centres, pivots)[0]
            rows = [
                (c, k, n if k == 0 else 0, part)
                for c, n, parts in _by_centre(vectors, numbers)
                for k, part in enumerate(parts)
            ]
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            names = ["centre", "limb", "n", "sums"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    partial = table.mapInArrow(sums, "centre int, limb int, n long, sums array<long>")
    added = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
    rows = partial.groupBy("centre", "limb").agg(F.sum("n").alias("n"), *added).orderBy("centre", "limb").collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        n, totals = found.get(r["centre"], (0, [0] * width))
        found[r["centre"]] = n + r["n"], [t + (r[f"s{i}"] << (LIMB * r["limb"])) for i, t in enumerate(totals)]
    new = [[t // found[c][0] for t in found[c][1]] if c in found else [int(x) for x in centres[c]] for c in range(len(centres))]
    small = max((abs(x) for row in new for x in row), default=0) <= SMALL
    return np.array(new, dtype=np.int64 if small else object).reshape(centres.shape)


def assigned(table: DataFrame, centres: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(id, cluster, distance, computed) of every vector; ``computed`` is, on the
    first row of a batch, the number of distances that the bounds left to compute."""
    id_type = table.schema["id"].dataType
    longest = 2**63 - 1

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = scaled(_matrix(batch.column("vector"), np.float64))
            numbers, far, computed = nearest(vectors, _matrix(batch.column("table"), np.float64), centres, pivots)
            far = pa.array([int(d) if d <= longest else None for d in far] if far.dtype == object else far, pa.int64())
            work = np.zeros(len(batch), np.int64)
            work[0] = computed
            columns = [batch.column("id"), pa.array(numbers.astype(np.int32)), far, pa.array(work)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "cluster", "distance", "computed"])

    fields = [T.StructField("id", id_type), T.StructField("cluster", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("distance", "computed")]
    return table.mapInArrow(numbered, T.StructType(fields))


def centroid_digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centre).encode()).hexdigest()


def cluster(
    df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(members, centroids). ``members`` has a row (id, cluster, distance, computed)
    for each kept vector, stored; with fewer than ``count`` vectors to start from,
    each of them is a centroid, and with none there are no rows."""
    kept = kept_vectors(df.select(id_col, vec), vec)
    centres = starting_centroids(kept, id_col, vec, count)
    if not len(centres):
        empty = kept.select(F.col(id_col).alias("id"), *[F.lit(0).cast(t).alias(c) for c, t in MEMBER]).limit(0)
        return empty, centres
    pivots = chosen_pivots(centres)
    table = pivot_table(kept, pivots, id_col, vec)
    for _ in range(rounds):
        centres = moved(table, centres, pivots)
    return stored(assigned(table, centres, pivots)), centres


MEMBER = [("cluster", "int"), ("distance", "long"), ("computed", "long")]


def cluster_vectors(df: DataFrame) -> DataFrame:
    """One row per kept row of ``df`` (vec_id, embedding): vec_id, cluster,
    distance, cluster_inertia, inertia and centroid_sha256."""
    members, centres = cluster(df)
    spark = df.sparkSession
    digests = [(c, centroid_digest(centre)) for c, centre in enumerate(centres)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    # Null where a distance of the cluster is, or where the sum is too long.
    gap = F.count_if(F.col("distance").isNull())
    totals = members.groupBy("cluster").agg(exact.alias("s"), gap.alias("gaps"))
    rows = totals.collect()  # one per centroid
    every = sum(int(r["s"] or 0) for r in rows)
    fits = lambda value, gaps: int(value) if not gaps and value < 2**63 else None
    over_all = fits(every, sum(r["gaps"] for r in rows))
    sums = [(r["cluster"], fits(r["s"] or 0, r["gaps"]), over_all) for r in rows]
    sums = spark.createDataFrame(sums, "cluster int, cluster_inertia long, inertia long")
    # As many rows as centroids, a documented parameter.
    found = members.join(F.broadcast(named.join(sums, "cluster")), "cluster")
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
