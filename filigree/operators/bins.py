"""Windows and bins over an order: pseudotime bins, cumulated weights, moving averages, gaps.

Positions in a long order are not numbered in one task: values are cut in
ranges at approximate quantiles, ranges are numbered on their own, and what lies
before a range is a running sum over a table of ranges.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a range of an order should hold, and the least and greatest number of ranges; the greatest bounds what the driver holds.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 1_000_000, 16, 16_384
#: Types of which different values differ as doubles too, and types that doubles keep in order.
_EXACT = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)
_MONOTONE = (*_EXACT, T.LongType, T.DecimalType)


def _place(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending ``cuts`` lie below ``value``, by halving; 0 for a null value."""
    if not cuts:
        return F.lit(0)
    table, steps = F.lit(cuts), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    below = lambda at, s: F.when(at + s <= len(cuts), F.get(table, at + s - 1) < value)
    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), lambda at, s: F.when(below(at, s), at + s).otherwise(at))


def _quantiles(value: Column, ranges: int) -> Column:
    return F.percentile_approx(value, [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges))


def ordered(df: DataFrame, order: str, tie: str, weight: Column | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with ``rn`` (place from 1), ``n`` (rows), ``cum`` (weight up to the row) and ``all_w``; null values come first.

    Ties in ``order`` go by ``tie``.  Ranges number one per RANGE_ROWS rows, unless given.  A value (or null) that
    fills more than a range is cut in as many by ``tie``, if both columns are numbers and those of ``order`` are
    exact as doubles; else it is one range.
    """
    weight = F.lit(1.0) if weight is None else weight
    kinds = {f.name: f.dataType for f in df.schema}
    value, by_tie = F.col(order).cast("double"), isinstance(kinds[tie], _MONOTONE)
    exact = isinstance(kinds[order], _EXACT) or isinstance(kinds[order], T.DecimalType) and kinds[order].precision <= 15
    if ranges is None:
        ranges = max(LEAST_RANGES, min(MOST_RANGES, -(-df.count() // RANGE_ROWS)))
    found = df.agg(_quantiles(value, ranges).alias("cuts"), F.count("*").alias("rows"), F.count(order).alias("known")).first()
    often = Counter(c for c in found["cuts"] or [] if c == c)
    cuts = sorted(often)
    parts = [often[c] if exact and by_tie else 1 for c in cuts]
    null_parts = max(1, ranges * (found["rows"] - found["known"]) // max(1, found["rows"])) if by_tie else 1
    placed = df.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(_place(value, cuts))).withColumn("_w", weight)
    part = F.lit(0)
    if null_parts > 1 or max(parts, default=1) > 1:
        hot = F.col(order).isNull() | value.isin([c for c, n in zip(cuts, parts) if n > 1])
        ties = sorted({c for c in df.where(hot).agg(_quantiles(F.col(tie).cast("double"), ranges)).first()[0] or [] if c == c})
        cut = lambda n: F.floor(_place(F.col(tie).cast("double"), ties) * n / ranges).cast("int")
        part = F.when(F.col(order).isNull(), cut(F.lit(null_parts)))
        if cuts:
            own = F.get(F.lit(parts), F.col("_range"))
            part = part.when((own > 1) & (F.get(F.lit(cuts), F.col("_range")) == value), 1 + cut(own))  # after the lesser values of its range
        part = part.otherwise(0)
    placed = placed.withColumn("_part", part)
    keys = ["_range", "_part"]
    sums = placed.groupBy(*keys).agg(F.count("*").alias("_c"), F.sum("_w").alias("_s"))  # a few rows per range
    w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = sums.select(*keys, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias("_s0"), F.sum("_c").over(every).alias("n"), F.sum("_s").over(every).alias("all_w"))
    within = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first(), tie)
    out = placed.join(F.broadcast(sums), keys).withColumn("rn", F.row_number().over(within) + F.col("_c0"))
    out = out.withColumn("cum", F.sum("_w").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_s0"))
    return out.drop(*keys, "_w", "_c0", "_s0")


def even_bins(df: DataFrame, order: str, tie: str, bins: int) -> DataFrame:
    """``df`` with ``bin``: ``bins`` bins of equal numbers of rows, ``floor((rn * bins - 1) / n)``."""
    return ordered(df, order, tie).withColumn("bin", F.floor((F.col("rn") * bins - 1) / F.col("n")).cast("int")).drop("rn", "n", "cum", "all_w")


def weighted_bins(df: DataFrame, order: str, tie: str, weight: str, bins: int) -> DataFrame:
    """``df`` with ``bin``: ``bins`` bins of equal weight along the order."""
    cum = F.round(F.col("cum") / F.col("all_w") * bins, 9)
    out = ordered(df, order, tie, F.col(weight))
    return out.withColumn("bin", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.ceil(cum) - 1)).cast("int")).drop("rn", "n", "cum", "all_w")


def equal_width_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``df`` with ``bin``: bins of equal width, open below and closed above, the first one holding the least value."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).first()
    width = ((ends["hi"] or 0.0) - (ends["lo"] or 0.0)) / bins
    at = F.ceil(F.round((F.col(value) - F.lit(ends["lo"])) / F.lit(width), 9)) - 1 if width else F.lit(0)
    return df.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int"))


def bin_means(binned: DataFrame, bins: int, value: str) -> DataFrame:
    """``(bin, n, mean)`` of every bin; an empty bin takes the mean of its neighbours' means, in ascending order."""
    spark = binned.sparkSession
    sums = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    got = {r["bin"]: (r["n"], r["mean"]) for r in sums.collect()}  # a row per bin
    rows, means = [], [got.get(b, (0, None))[1] for b in range(bins)]
    for b in range(bins):
        if means[b] is None:
            near = [means[c] for c in (b - 1, b + 1) if 0 <= c < bins and means[c] is not None]
            means[b] = sum(near) / len(near) if near else None
        rows.append((b, got.get(b, (0, None))[0], means[b]))
    return spark.createDataFrame(rows, "bin int, n long, mean double")


def bin_pseudotime(df: DataFrame, value: str, tie: str, bins: int) -> DataFrame:
    """Bins of equal width, or of equal numbers where one of them would be empty."""
    made = equal_width_bins(df, value, bins)
    return made if made.select("bin").distinct().count() == bins else even_bins(df, value, tie, bins)


def bin_vectors(binned: DataFrame, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector of every bin of ``binned (bin, x)`` and whether bin and neighbours were empty (an invalid chunk)."""
    rows = binned.select("bin", F.posexplode("x").alias("dim", "v")).groupBy("bin", "dim").agg(F.avg("v").alias("v")).collect()
    return fill_means({(r["bin"], r["dim"]): r["v"] for r in rows}, bins)


def fill_means(got: dict, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Means by bin and dimension, empty bins filled in order by their neighbours; flagged where both neighbours were empty too."""
    y = np.full((bins, 1 + max((d for _, d in got), default=0)), np.nan)
    for (b, d), v in got.items():
        y[b, d] = v
    empty = np.isnan(y).any(1)
    bad = empty & empty[np.maximum(np.arange(bins) - 1, 0)] & empty[np.minimum(np.arange(bins) + 1, bins - 1)]
    for b in range(bins):
        if np.isnan(y[b]).any():
            near = [y[c] for c in (b - 1, b + 1) if 0 <= c < bins and not np.isnan(y[c]).any()]
            if near:
                y[b] = np.mean(near, axis=0)
    return y, bad


def resample(path: np.ndarray) -> np.ndarray:
    """As many points as the polyline has, at equal distances along it."""
    along = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(path, axis=0), axis=1))])
    at = np.linspace(0, along[-1], len(path))
    return np.stack([np.interp(at, along, c) for c in path.T], 1)


def moving_average(df: DataFrame, x: str, y: str, step: float, steps_per_bin: int = 1, weight: str | None = None) -> DataFrame:
    """``(bin, x, value)``: means of ``y`` over bins of width ``step`` from the least ``x``, averaged over ``steps_per_bin`` bins."""
    lo = df.agg(F.min(x).cast("double")).first()[0]
    w = F.col(weight) if weight else F.lit(1.0)
    per = df.withColumn("bin", F.floor((F.col(x) - F.lit(lo)) / F.lit(float(step))).cast("int")).groupBy("bin").agg((F.sum(w * F.col(y)) / F.sum(w)).alias("m"))
    window = Window.orderBy("bin").rowsBetween(0, steps_per_bin - 1)  # over bins, not rows
    return per.select("bin", (F.lit(lo) + (F.col("bin") + F.lit(0.5)) * F.lit(float(step))).alias("x"), F.avg("m").over(window).alias("value"))


def fill_gaps(df: DataFrame, pos: str, value: str, *group: str) -> DataFrame:
    """``df`` with ``filled``: nulls between values by linear interpolation along ``pos``, at the ends by the nearest value.

    One sequence per ``group``; without one the table is a single sequence of bins or nodes.
    """
    w = Window.partitionBy(*group).orderBy(pos)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.struct(F.col(pos).cast("double").alias("p"), F.col(value).cast("double").alias("v")))
    out = df.withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(ahead))
    gap = F.col("_b.p") - F.col("_a.p")
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(pos) - F.col("_a.p")) / gap
    return out.withColumn("filled", F.when(gap > 0, line).otherwise(F.coalesce("_a.v", "_b.v"))).drop("_a", "_b")


def first_known(value: str, pos: str) -> Column:
    """Aggregate: the value at the first position that has one."""
    return F.min_by(value, F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(pos)))


def last_known(value: str, pos: str) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(pos)))


def first_gap(value: str, pos: str) -> Column:
    """Aggregate: the first position without a value."""
    return F.min(F.when(F.col(value).isNull() | F.isnan(value), F.col(pos)))
