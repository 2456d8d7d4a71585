"""Distance-based uncertainty: binned relative errors, curves, Mahalanobis distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binned_rrmse(df: DataFrame, width: float, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """RMSE (2 dp) over mean observation by distance bin, residual ratios (9 dp, so that equal ones tie) outside
    [low, high] quantiles left out."""
    x = df.where("obs is not null and pred is not null").withColumn("bin", F.floor(F.col("distance") / width)).withColumn("ratio", F.bround(F.try_divide(F.col("pred") - F.col("obs"), F.col("obs")), 9))
    q = x.groupBy("bin").agg(F.percentile("ratio", F.lit(low)).alias("lo"), F.percentile("ratio", F.lit(high)).alias("hi"))
    kept = x.join(F.broadcast(q), "bin").where("ratio between lo and hi")
    return kept.groupBy("bin").agg(F.count("*").alias("n"), (F.bround(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("obs"), 2))), 2) / F.avg("obs")).alias("rrmse"))


def segments(curve: DataFrame, x: str, y: str, part: tuple[str, ...] = ()) -> DataFrame:
    """Line segments between consecutive points of a curve (some tens of rows)."""
    w = Window.partitionBy(*part).orderBy(x) if part else Window.partitionBy(F.lit(0)).orderBy(x)
    return curve.select(*part, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.row_number().over(w).alias("i"))


def piecewise(df: DataFrame, at: str, curve: DataFrame, x: str = "x", y: str = "y", cap: float | None = None, tail: bool = False) -> DataFrame:
    """Adds ``fitted``: linear inside the curve, the first value before it; after it the last value, or, with ``tail``, the
    last segment if it rises and else the slope of a line through all points."""
    line = curve.agg(F.regr_slope(y, x).alias("_all"))
    s = segments(curve, x, y)
    s = s.withColumn("_up", F.lag("y0").over(Window.orderBy("i"))).withColumn("_px", F.lag("x0").over(Window.orderBy("i"))).crossJoin(line)  # some tens of rows
    j = df.join(F.broadcast(s), ((F.col(at) >= F.col("x0")) | (F.col("i") == 1)) & ((F.col(at) < F.col("x1")) | F.col("x1").isNull()), "left")
    inside = F.col("y0") + (F.greatest(F.col(at), F.col("x0")) - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    slope = F.when(F.col("y0") >= F.col("_up"), (F.col("y0") - F.col("_up")) / (F.col("x0") - F.col("_px"))).otherwise(F.col("_all")) if tail else F.lit(0.0)
    v = F.when(F.col("x1").isNull(), F.col("y0") + slope * (F.col(at) - F.col("x0"))).otherwise(inside)
    return j.withColumn("fitted", F.least(v, F.lit(cap)) if cap is not None else v).drop("x0", "y0", "x1", "y1", "i", "_up", "_px", "_all")


def expected_wrong(path: DataFrame, most: float) -> DataFrame:
    """(feature, wrong, place, oracle) from the running minimum ``run`` of each feature's selection probability by step.

    ``wrong``: the least over steps of features * mean(run)^2 / (2 run - 1) where run is over one half, else null (none);
    ``oracle``: how many features stand before the largest relative jump, 0 if the first is over ``most``.
    """
    n = F.broadcast(path.agg(F.countDistinct("feature").alias("_f")))
    mean = path.groupBy("step").agg(F.avg("run").alias("_m"))
    x = path.join(mean, "step").crossJoin(n)
    w = x.groupBy("feature").agg(F.min(F.when(F.col("run") > 0.5, F.col("_f") * F.col("_m") * F.col("_m") / (2 * F.col("run") - 1))).alias("wrong"))
    order = Window.orderBy(F.asc_nulls_last("wrong"), "feature")  # one row per feature
    o = w.withColumn("place", F.row_number().over(order)).withColumn("_w", F.coalesce("wrong", F.lit(1e300)))
    jump = F.try_divide(F.col("_w"), F.lag("_w").over(Window.orderBy("place")))
    best = o.withColumn("_r", jump).agg(F.max(F.when(F.col("place") == 1, F.col("_w"))).alias("_first"), F.max(F.struct(F.coalesce("_r", F.lit(-1.0)).alias("r"), (-F.col("place")).alias("p"))).alias("_b"))
    oracle = F.when(F.col("_first") > most, 0).otherwise(-F.col("_b.p") - 1)
    return o.crossJoin(F.broadcast(best)).select("feature", "wrong", "place", oracle.alias("oracle"))


def covariance(df: DataFrame, vector: str, n: int) -> np.ndarray:
    """Sample covariance of an n-vector column: n * (n + 1) / 2 numbers reach the driver, from one aggregation."""
    v = [F.get(vector, F.lit(i)).cast("double") for i in range(n)]
    row = df.agg(*[F.covar_samp(v[i], v[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    return np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])


def inverse_of(covariance: np.ndarray) -> np.ndarray:
    """Inverse; raises ``numpy.linalg.LinAlgError`` where channels depend on each other, as distances mean nothing then."""
    if len(covariance) and np.linalg.matrix_rank(covariance, hermitian=True) < len(covariance):
        raise np.linalg.LinAlgError("singular covariance")
    return np.linalg.inv(covariance)


def group_shapes(df: DataFrame, key: str, vector: str, n: int) -> DataFrame:
    """(key, rows, mean, inverse): mean and inverse sample covariance (row by row) of the vectors of every group.

    Every task sums counts, vectors and their products by group with matrix products; what meets by key is one row of
    n * n numbers per task and group. Rows with a missing value are left out; a singular group raises an error.
    """
    kind = df.schema[key].dataType.simpleString()

    def sums(batches):
        held: dict = {}
        for b in batches:
            keys = b.column(0).to_pylist()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            for k in dict.fromkeys(keys):
                v = x[[i for i, other in enumerate(keys) if other == k]]
                c, s, p = held.get(k, (0, 0.0, 0.0))
                held[k] = c + len(v), s + v.sum(0), p + v.T @ v
        cols = [list(held), [c for c, _, _ in held.values()], [s.tolist() for _, s, _ in held.values()], [p.ravel().tolist() for _, _, p in held.values()]]
        types = [b.schema.field(0).type if held else pa.null(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[key, "_c", "_s", "_p"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        c, s, p = pdf["_c"].sum(), np.sum(np.stack(pdf["_s"]), 0), np.sum(np.stack(pdf["_p"]), 0).reshape(n, n)
        mean = s / c
        inverse = inverse_of((p - c * np.outer(mean, mean)) / max(1, c - 1))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "rows": [c], "mean": [mean.tolist()], "inverse": [inverse.ravel().tolist()]})

    v = F.transform(vector, lambda x: x.cast("double"))
    ok = df.select(key, v.alias("_v")).where(F.col(key).isNotNull() & (F.size("_v") == n) & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x)))
    parts = ok.mapInArrow(sums, f"{key} {kind}, _c long, _s array<double>, _p array<double>")
    return parts.groupBy(key).applyInPandas(whole, f"{key} {kind}, rows long, mean array<double>, inverse array<double>")


def mahalanobis_by_group(df: DataFrame, key: str, vector: str, shapes: DataFrame, n: int, reference: str | None = None, block_bytes: int = 64 << 20) -> DataFrame:
    """Adds ``distance``: sqrt(max(0, d S^-1 d)) with the inverse of the row's own group; d is the way from ``reference`` (else
    from the group's mean). Rows of unknown groups or with missing values have none.

    Inverses are looked up by key in the tasks, which multiply whole batches; they are broadcast ``block_bytes`` at a time, and
    a row meets the block that holds its key.
    """
    blocks = max(1, -(-shapes.count() * n * (n + 1) * 8 // block_bytes))
    of = F.pmod(F.xxhash64(key), F.lit(blocks))
    out, spark = None, df.sparkSession

    def run(shared):
        def go(batches):
            known = shared.value
            for b in batches:
                x = [np.array(v.as_py() if v.is_valid else [], dtype=float) for v in b.column("_v")]
                r = [np.array(v.as_py() if v.is_valid else [], dtype=float) for v in b.column("_r")]
                keys = b.column(key).to_pylist()
                d = np.full(len(keys), np.nan)
                for k in set(keys) & known.keys():
                    mean, inverse = known[k]
                    at = [i for i, other in enumerate(keys) if other == k and len(x[i]) == n and (reference is None or len(r[i]) == n)]
                    if at:
                        w = np.stack([x[i] - (mean if reference is None else r[i]) for i in at])
                        d[at] = np.sqrt(np.maximum(0, ((w @ inverse) * w).sum(1)))
                names = [c for c in b.schema.names if c not in ("_v", "_r")]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(d, mask=np.isnan(d))], names=[*names, "distance"])

        return go

    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    made = df.withColumns({"_v": as_double(vector), "_r": as_double(reference) if reference else F.array().cast("array<double>")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", distance double"
    for i in range(blocks):
        rows = shapes.where(of == i).select(key, "mean", "inverse").collect()  # ``block_bytes`` at most
        shared = spark.sparkContext.broadcast({r[0]: (np.array(r[1]), np.array(r[2]).reshape(n, n)) for r in rows})
        part = (made if blocks == 1 else made.where(F.coalesce(of, F.lit(0)) == i)).mapInArrow(run(shared), schema)
        out = part if out is None else out.unionByName(part)
    return out


def mahalanobis(a: Column, b: Column, inverse: np.ndarray) -> Column:
    """sqrt(max(0, d S^-1 d)) of two array columns."""
    n = len(inverse)
    d = [F.get(a, F.lit(i)).cast("double") - F.get(b, F.lit(i)).cast("double") for i in range(n)]
    total = F.lit(0.0)
    for i in range(n):
        inner = F.lit(0.0)
        for j in range(n):
            inner = inner + d[j] * F.lit(float(inverse[i, j]))
        total = total + d[i] * inner
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def lowess(x: np.ndarray, y: np.ndarray, frac: float, passes: int = 3) -> np.ndarray:
    """Locally weighted regression at each x: tricube weights over the nearest share of points, bisquare robust passes."""
    n = len(x)
    k = max(2, min(n, int(frac * n + 1e-10)))
    out, robust = np.zeros(n), np.ones(n)
    for _ in range(passes + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = np.sort(d)[k - 1]
            w = robust * (np.where(d < 0.999 * h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0.0) if h > 0 else (d == 0))
            if w.sum() <= 0:
                out[i] = y[i]
                continue
            mx, my = np.average(x, weights=w), np.average(y, weights=w)
            var = np.average((x - mx) ** 2, weights=w)
            out[i] = my + (np.average((x - mx) * (y - my), weights=w) / var * (x[i] - mx) if var > 1e-12 * (np.ptp(x) ** 2 + 1e-300) else 0.0)
        r = y - out
        s = np.median(np.abs(r))
        robust = np.clip(1 - (r / (6 * s)) ** 2, 0, None) ** 2 if s > 0 else np.ones(n)
    return out


def smoothed(curve: DataFrame, part: str, x: str, y: str, frac: float) -> DataFrame:
    """Adds ``smooth`` to a curve of some tens of points per ``part``; parts are smoothed side by side."""
    kept = curve.columns

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(x)
        p["smooth"] = lowess(p[x].to_numpy(float), p[y].to_numpy(float), frac)
        return p

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in curve.schema)
    return curve.groupBy(part).applyInPandas(one, f"{schema}, smooth double").select(*kept, "smooth")


def log_binned_rrmse(df: DataFrame, part: str, low: float = 0.3, high: float = 2.0, bins: int = 30, trim: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """RMSE over mean prediction by bins of log(1 + distance) between ``low`` and ``high``; relative residuals (9 dp)
    outside the quantiles ``trim`` of their bin are left out."""
    step = (high - low) / bins
    at = F.log1p("distance")
    x = df.where("obs is not null and pred is not null").where((at >= low) & (at < high)).withColumn("bin", F.floor((at - low) / F.lit(step))).withColumn("ratio", F.bround((F.col("pred") - F.col("obs")) / (F.col("obs") + F.lit(1e-4)), 9))
    q = x.groupBy(part, "bin").agg(F.bround(F.percentile("ratio", F.lit(trim[0])), 9).alias("lo"), F.bround(F.percentile("ratio", F.lit(trim[1])), 9).alias("hi"))
    kept = x.join(F.broadcast(q), [part, "bin"]).where("ratio between lo and hi")  # at most parts * bins rows
    return kept.groupBy(part, "bin").agg(F.count("*").alias("n"), (F.sqrt(F.avg(F.pow(F.col("pred") - F.col("obs"), 2))) / F.avg("pred")).alias("rrmse"))


def extrapolated(df: DataFrame, at: str, curve: DataFrame, x: str, y: str, part: str, low_slope: float = 0.05, high_slope: float = 0.1, cap: float = 1.0) -> DataFrame:
    """Adds ``fitted``: linear inside the curve of the row's ``part``; beyond its ends the end segment goes on if the curve
    rises there, else it rises by a fixed slope; never over ``cap``."""
    w = Window.partitionBy(part).orderBy(x)
    s = curve.select(part, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.row_number().over(w).alias("i")).where("x1 is not null")
    s = s.withColumn("last", F.max("i").over(Window.partitionBy(part)))
    one = s.groupBy(part).agg(F.sort_array(F.collect_list(F.struct("i", "x0", "y0", "x1", "y1", "last"))).alias("_s"))  # some tens of segments
    j = df.join(F.broadcast(one), part, "left")
    v = F.col(at)
    g = F.get(F.filter("_s", lambda z: ((v >= z["x0"]) | (z["i"] == 1)) & ((v < z["x1"]) | (z["i"] == z["last"]))), 0)
    slope = (g["y1"] - g["y0"]) / (g["x1"] - g["x0"])
    low = F.when(g["y1"] >= g["y0"], slope).otherwise(low_slope) * (v - g["x0"]) + g["y0"]
    high = F.when(g["y1"] >= g["y0"], slope).otherwise(high_slope) * (v - g["x1"]) + g["y1"]
    fitted = F.when(v < g["x0"], low).when(v >= g["x1"], high).otherwise(g["y0"] + slope * (v - g["x0"]))
    return j.withColumn("fitted", F.least(fitted, F.lit(cap))).drop("_s")
