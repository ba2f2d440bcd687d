"""Ordered scans that survive a hot group.

A window partitioned by sheet or source puts that whole group in one task. A
scan here cuts each group at fixed ranges of its order column first: every
(group, segment) is windowed on its own, one summary row per segment carries
the state across, and the summaries - smaller by the segment length - are all
that is ever windowed per group. No group is collected, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_ROWS = 100_000


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    sums: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,  # noqa: A002 - reads best at call sites
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Add running values per group, in the order of an integer column that
    is unique within the group.

    ``sums``: inclusive running sum. ``last``: latest non-NULL value up to and
    including the row. ``prev``: the same, excluding the row. ``next``:
    earliest non-NULL value from the row onwards.
    """
    sums, last, prev, nxt = dict(sums or {}), dict(last or {}), dict(prev or {}), dict(next or {})
    inputs = {**sums, **last, **prev, **nxt}
    raw = {name: f"_in_{name}" for name in inputs}
    base = df.withColumns(
        {"_seg": F.floor(F.col(order) / segment_rows).cast("bigint"), **{raw[n]: c for n, c in inputs.items()}}
    )
    part = [*keys, "_seg"]

    summary = [F.sum(raw[n]).alias(f"_c_{n}") for n in sums]
    summary += [F.max_by(raw[n], F.when(F.col(raw[n]).isNotNull(), F.col(order))).alias(f"_c_{n}") for n in {**last, **prev}]
    summary += [F.min_by(raw[n], F.when(F.col(raw[n]).isNotNull(), F.col(order))).alias(f"_c_{n}") for n in nxt]
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(1, Window.unboundedFollowing)
    carry = base.groupBy(*part).agg(*summary)
    carried = {f"_c_{n}": F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)) for n in sums}
    carried |= {f"_c_{n}": F.last(f"_c_{n}", ignorenulls=True).over(before) for n in {**last, **prev}}
    carried |= {f"_c_{n}": F.first(f"_c_{n}", ignorenulls=True).over(after) for n in nxt}
    carry = carry.select(*part, *[c.alias(n) for n, c in carried.items()])

    within = Window.partitionBy(*part).orderBy(order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    onward = within.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = {f"_l_{n}": F.sum(raw[n]).over(upto) for n in sums}
    local |= {f"_l_{n}": F.last(raw[n], ignorenulls=True).over(upto) for n in last}
    local |= {f"_l_{n}": F.last(raw[n], ignorenulls=True).over(earlier) for n in prev}
    local |= {f"_l_{n}": F.first(raw[n], ignorenulls=True).over(onward) for n in nxt}
    scanned = base.withColumns(local).join(carry, part)
    result = {n: F.col(f"_l_{n}") + F.col(f"_c_{n}") for n in sums}
    result |= {n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in {**last, **prev, **nxt}}
    return scanned.withColumns(result).drop(
        "_seg", *raw.values(), *[f"_l_{n}" for n in inputs], *[f"_c_{n}" for n in inputs]
    )


def sequence_number(
    df: DataFrame, keys: Sequence[str], order: str, name: str, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """1-based position within the group."""
    return ordered_scan(df, keys, order, sums={name: F.lit(1).cast("bigint")}, segment_rows=segment_rows)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the highest ``order``; partial maxima are taken before
    the shuffle, so a key holding most rows costs no more than the others."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``order`` and then by the other columns, so
    that the choice never hangs on which row came first. A NULL is less than any
    value; partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
