"""Evaluation statistics as aggregate expressions over (x, y) pairs, nulls left out pair by pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pair(x: Column, y: Column) -> tuple[Column, Column]:
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def r2(x: Column, y: Column) -> Column:
    """Squared correlation; 0 when one side is constant, null without pairs."""
    x, y = _pair(x, y)
    flat = (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0)
    return F.when(F.count(x) > 0, F.when(flat, 0.0).otherwise(F.coalesce(F.pow(F.corr(x, y), 2), F.lit(0.0))))


def rmse(x: Column, y: Column, digits: int = 2) -> Column:
    return F.bround(F.sqrt(F.avg((x - y) * (x - y))), digits)


def nrmse(pred: Column, obs: Column) -> Column:
    _, o = _pair(pred, obs)
    return rmse(pred, obs) / F.avg(o)


def weighted_rrmse(pred: Column, obs: Column, w: Column) -> Column:
    return F.bround(F.sqrt(F.sum(w * (pred - obs) * (pred - obs)) / F.sum(w)) / (F.sum(w * pred) / F.sum(w)), 3)


def weighted_mean(v: Column, w: Column) -> Column:
    ok = v > 0
    return F.try_divide(F.sum(F.when(ok, w * v)), F.sum(F.when(ok, w)))


def rma(x: Column, y: Column) -> tuple[Column, Column]:
    """Slope and intercept of the reduced-major-axis line y ~ x; null where the two OLS slopes differ in sign."""
    x, y = _pair(x, y)
    a, b = F.regr_slope(y, x), 1 / F.regr_slope(x, y)
    slope = F.when(a * b >= 0, F.signum(a) * F.sqrt(a * b))
    return slope, F.avg(y) - slope * F.avg(x)


def pairs_above(u: np.ndarray, r: np.ndarray, event: np.ndarray) -> tuple[int, int]:
    """(pairs, above): of rows j with an event and rows i of a larger ``u``, all pairs and those with r of j above r of i.

    Bit by bit of the ranks of ``r``: of rows that share the higher bits, one with the bit stands above one without. Running
    sums in the order of ``u`` count them, so the work is n log n a bit.
    """
    def earlier(group: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sum of the weights in a row's group at a smaller u, in the rows' order."""
        order = np.lexsort((u, group))
        g, v = group[order], u[order]
        total = np.r_[0, np.cumsum(weight[order])]
        new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
        begins = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0))
        out = np.empty(len(g), np.int64)
        out[order] = total[first] - total[begins]
        return out

    if not len(u):
        return 0, 0
    event = event.astype(np.int64)
    rank = np.unique(r, return_inverse=True)[1]
    pairs, above = int(earlier(np.zeros(len(u), np.int64), event).sum()), 0
    for bit in range(int(rank.max()).bit_length()):
        one = (rank >> bit) & 1
        above += int((earlier(rank >> (bit + 1), event * one) * (1 - one)).sum())
    return pairs, above


def _cuts(df: DataFrame, column: str, n: int) -> list[float]:
    return sorted(set(df.approxQuantile(column, [k / n for k in range(n + 1)], 1 / (4 * n))))


def _bucket(x: Column, cuts: list[float]) -> Column:
    """Even numbers for values that are cuts, odd ones for those between two: a frequent value stands alone."""
    at = F.lit(cuts)
    return F.aggregate(at, F.lit(-1).cast("long"), lambda s, c: s + (c < x).cast("long") + (c <= x).cast("long"))


def concordance(df: DataFrame, time: str, risk: str, event: str, rows: int = 100_000) -> DataFrame:
    """(pairs, c): over the pairs of an event and a later row, the share where the earlier one's risk is higher.

    Pairs are counted, not made. Both columns are cut into at most 256 buckets of about ``rows`` rows; a frequent value is a
    bucket of its own. Pairs in different buckets of both come from the counts by bucket (at most 513 x 513), pairs that
    share a bucket of the one or the other from sorts inside it.
    """
    x = df.select(F.col(time).cast("double").alias("t"), F.col(risk).cast("double").alias("r"), F.coalesce(F.col(event), F.lit(False)).alias("e")).where("t is not null and r is not null")
    n = min(256, max(1, -(-x.count() // rows)))
    x = x.withColumns({"tb": _bucket(F.col("t"), _cuts(x, "t", n)), "rb": _bucket(F.col("r"), _cuts(x, "r", n))})
    found = x.groupBy("tb", "rb").agg(F.count("*").alias("n"), F.sum(F.col("e").cast("long")).alias("e")).toPandas()
    tb, rb = (np.unique(found[c], return_inverse=True)[1] for c in ("tb", "rb"))
    shape = (tb.max() + 1, rb.max() + 1) if len(found) else (0, 0)
    all_rows, events = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    all_rows[tb, rb], events[tb, rb] = found.n, found.e
    before = np.vstack([np.zeros((1, shape[1]), np.int64), events.cumsum(0)[:-1]]) if len(found) else events
    higher = before.sum(1, keepdims=True) - before.cumsum(1)
    pairs, above = int((all_rows * before.sum(1, keepdims=True)).sum()), int((all_rows * higher).sum())

    def inside(own: str, other: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([pairs_above(pdf[other].to_numpy(), pdf.r.to_numpy(), pdf.e.to_numpy())], columns=["pairs", "above"])

        # in a bucket of one value no risk is above another, and no time is later
        return x.where(F.col(own) % 2 != 0).select(own, other, "r", "e").groupBy(own).applyInPandas(run, "pairs long, above long")

    times, risks = inside("tb", "t"), inside("rb", "tb").withColumn("pairs", F.lit(0).cast("long"))
    sums = times.unionByName(risks).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("p"), F.coalesce(F.sum("above"), F.lit(0)).alias("a"))
    return sums.select((F.col("p") + pairs).alias("pairs"), F.try_divide(F.col("a") + above, F.col("p") + pairs).alias("c"))


def type_two(x: Column, y: Column) -> dict[str, Column]:
    """Aggregates of y ~ x: reduced major axis (slope, icpt, r, standard errors), its slope without intercept, the major
    axis and the arithmetic mean of both OLS slopes. Null where the two OLS slopes differ in sign."""
    x, y = _pair(x, y)
    a, b = F.regr_slope(y, x), F.try_divide(F.lit(1.0), F.regr_slope(x, y))
    n, sxx, syy, sxy = F.count(x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    slope = F.when(a * b >= 0, F.signum(a) * F.sqrt(a * b))
    s2 = F.try_divide(syy - 2 * slope * sxy + slope * slope * sxx, n - 2)
    xx, xy, yy = F.sum(x * x), F.sum(x * y), F.sum(y * y)
    return {
        "slope": slope,
        "icpt": F.avg(y) - slope * F.avg(x),
        "r": F.signum(a) * F.sqrt(F.try_divide(a, b)),
        "se_slope": F.sqrt(F.try_divide(s2, sxx)),
        "se_icpt": F.sqrt(F.try_divide(xx * s2, n * sxx)),
        "slope0": F.signum(xy) * F.sqrt(F.try_divide(yy, xx)),
        "major": F.try_divide(syy - sxx + F.sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy), 2 * sxy),
        "arithmetic": (a + b) / 2,
    }


def type_two_weighted(x: Column, y: Column, var_x: Column, var_y: Column) -> dict[str, Column]:
    """Reduced major axis from two weighted first regressions: y ~ x with weights 1 / ``var_y``, x ~ y with 1 / ``var_x``.

    slope, r (null where the two slopes differ in sign), and slope0 of the form without intercept. A weighted line's
    intercept comes from medians, so ``icpt`` is the median of y less slope times the median of x (exact percentiles, which
    hold a group's values: for groups of validation size). Rows with a missing value or a variance not over 0 are left out.
    """
    ok = x.isNotNull() & y.isNotNull() & (var_x > 0) & (var_y > 0)
    x, y = F.when(ok, x), F.when(ok, y)

    def line(a: Column, b: Column, w: Column) -> tuple[Column, Column]:
        """Weighted slopes of b ~ a, with and without intercept."""
        w = F.when(ok, 1 / w)
        n, ma, mb = F.sum(w), F.sum(w * a), F.sum(w * b)
        return F.try_divide(F.sum(w * a * b) - ma * mb / n, F.sum(w * a * a) - ma * ma / n), F.try_divide(F.sum(w * a * b), F.sum(w * a * a))

    (a, a0), (b, b0) = line(x, y, var_y), line(y, x, var_x)
    b, b0 = F.try_divide(F.lit(1.0), b), F.try_divide(F.lit(1.0), b0)
    both = lambda p, q: F.when(p * q >= 0, F.signum(p) * F.sqrt(p * q))
    slope = both(a, b)
    return {
        "slope": slope,
        "icpt": F.percentile(y, F.lit(0.5)) - slope * F.percentile(x, F.lit(0.5)),
        "r": F.when(a * b >= 0, F.signum(a) * F.sqrt(F.try_divide(a, b))),
        "slope0": both(a0, b0),
    }


def quantiles(df: DataFrame, by: list[str], value: str, q: float, buckets: int = 4096) -> DataFrame:
    """(by, q): exact, interpolated quantiles by rank. Values become counts, counts become bucket sums over the range of
    the group, and only the buckets that hold the wanted ranks are sorted; no task sees a whole group."""
    g = by or ["_all"]
    x = df.where(F.col(value).isNotNull())
    x = x if by else x.withColumn("_all", F.lit(0))
    v = x.groupBy(*g, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    lim = v.groupBy(*g).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total"))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * buckets), F.lit(buckets - 1))
    b = v.join(lim, g).withColumns({"_b": at, "_pos": F.lit(q) * (F.col("_total") - 1)})
    before = lambda w: F.sum("_n").over(w) - F.col("_n")
    wanted = (F.col("_c") <= F.ceil("_pos")) & (F.col("_c") + F.col("_n") > F.floor("_pos"))
    sums = b.groupBy(*g, "_b", "_pos").agg(F.sum("_n").alias("_n")).withColumn("_c", before(Window.partitionBy(*g).orderBy("_b"))).where(wanted)
    inside = b.join(sums.select(*g, "_b", F.col("_c").alias("_base")), [*g, "_b"]).withColumn("_c", F.col("_base") + before(Window.partitionBy(*g, "_b").orderBy("_v"))).where(wanted)
    holds = lambda r: F.max(F.when((F.col("_c") <= r) & (F.col("_c") + F.col("_n") > r), F.col("_v")))
    out = inside.groupBy(*g, "_pos").agg(holds(F.floor("_pos")).alias("_x"), holds(F.ceil("_pos")).alias("_y"))
    return out.select(*by, (F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_pos") - F.floor("_pos"))).alias("q"))
