"""Operators that SQL does not express, against numpy on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import learn, raster, spatial, uncertainty
from skyloom.plans import registry
from skyloom.sources.fixtures import frame

SF = "/root/testdata/sf0.001"


def test_patches(spark):
    """Windows at the border, cells and values that are missing, and both layouts of the features."""
    rng = np.random.default_rng(1)
    grid = [(i, j, 2000, m, float(rng.normal()), None if (i + j) % 3 == 0 else float(i * 10 + j)) for i in range(4) for j in range(5) for m in (1, 2) if (i, j) != (1, 1)]
    sites = [(7, 0, 0), (8, 2, 2), (9, 3, 4), (10, 9, 9)]
    at = {(i, j, m): (a, b) for i, j, _, m, a, b in grid}
    g, s = spark.createDataFrame(grid, "ilat long, ilon long, year int, mon int, a double, b double"), spark.createDataFrame(sites, "site long, ilat long, ilon long")
    got = {(r.site, r.mon): r for r in learn.patches(s, g, ["a", "b"]).withColumn("mid", learn.flattened(["a", "b"])).withColumn("all", learn.flattened(["a", "b"], mode="flatten")).collect()}
    assert set(got) == {(k, m) for k in (7, 8, 9) for m in (1, 2)}
    for (site, m), r in got.items():
        _, i, j = next(x for x in sites if x[0] == site)
        want = [at.get((i + dy, j + dx, m), (None, None)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        assert list(r.a) == [x[0] for x in want] and list(r.b) == [x[1] for x in want]
        assert list(r.mid) == list(want[4]) and list(r.all) == [*r.a, *r.b]


def test_fill_and_early_stop(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal()), [float(x) if rng.random() > 0.1 else None, float(rng.normal())], bool(k % 4 == 0)) for k, x in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "y double, values array<double>, early boolean")
    v = learn.filled_vector(df, df.limit(200), 2)
    mean = np.mean([r[1][0] for r in df.limit(200).collect() if r[1][0] is not None])
    assert all(math.isclose(r.features[0], r["values"][0] if r["values"][0] is not None else mean) for r in v.collect())
    none = learn.filled_vector(df.withColumn("values", F.array(F.lit(None).cast("double"), F.lit(1.0))), df.limit(0), 2)
    assert {tuple(r.features) for r in none.collect()} == {(0.0, 1.0)}
    # the label is noise: more trees only learn it by heart, and the marked rows end it
    whole, short = learn.boosted(v, "y", trees=15), learn.boosted(v, "y", validation="early", trees=15)
    assert whole.getNumTrees == 15 and short.getNumTrees < 15


def test_boosted_models(spark, tmp_path):
    """Held-out accuracy by DuckDB on saved predictions, and the tuner's metrics against the same."""
    import duckdb

    from skyloom.plans import learning

    sf = "/root/testdata/sf0.01"

    def r2(df, name, where="true", by="0"):
        df.write.parquet(f"{tmp_path}/{name}")
        out = duckdb.sql(f"select {by} as k, count(*) as n, power(corr(obs, pred), 2) as r2, sqrt(avg((obs - pred) * (obs - pred))) as rmse from '{tmp_path}/{name}/*.parquet' where {where} group by all").fetchall()
        return {k: (n, r, e) for k, n, r, e in out}

    for name in ("m1_boosted_trees", "m1_flattened_patches"):
        assert r2(registry.QUERIES[name](spark, sf), name)[0][1] > 0.4
    g = registry.QUERIES["m2_gain_importance"](spark, sf).toPandas()
    assert abs(g.gain.sum() - 1) < 1e-5 and g.sort_values("gain").feature.iloc[-1] == "sat"
    cv = registry.QUERIES["m3_cross_validated"](spark, sf)
    for k, (n, r, _) in r2(cv, "m3", "role = 1", "span").items():
        assert n and r > 0.4, k
    pdf = cv.toPandas()
    assert (pdf.groupby(["span", "site", "year", "mon"]).role.sum() == -1).all()
    m = registry.QUERIES["m4_prediction_map"](spark, sf).toPandas()
    land = (m.ilat + m.ilon) % 3 != 0
    assert (m.pred[~land] == learn.NO_DATA).all() and (m.pred[land] > 0).all()
    sets = {"none": {}, "blind": {"without": [0]}, "flat": {"maxDepth": 1}}
    out, best = learning.search(spark, sf, sets)
    want = r2(out, "tuned", by="variant")
    got = {r.variant: (r.n, r.r2, r.rmse) for r in learning.variant_metrics(out).collect()}
    assert set(got) == set(sets) and best == min(want, key=lambda k: want[k][2])
    for k, (n, r, e) in want.items():
        assert got[k][0] == n and math.isclose(got[k][1], r, abs_tol=2e-6) and math.isclose(got[k][2], e, abs_tol=0.006)
    assert want["blind"][1] < 0.05 < want["none"][1]
    l10, l11 = (registry.QUERIES[n](spark, SF).toPandas() for n in ("l10_sensitivity_sweep", "l11_parameter_search"))
    assert len(l10) == 5 and len(l11) == 3 and l10.best.sum() == 1 == l11.best.sum() and l10.n.nunique() == 1


def test_search_boosts_as_long_as_it_helps(spark, monkeypatch):
    """A sum that needs many trees is learnt; labels that are all the same end boosting at once."""
    from pyspark.ml.functions import array_to_vector

    from skyloom.plans import learning

    x = lambda k: f"pmod(xxhash64(id, {k}), 1000) / 1000.0D"
    rows = spark.range(1500, numPartitions=1).selectExpr("id as site", "1999 as year", "1 as mon", "cast(id % 3 as int) as fold", "id % 7 = 0 as early", *[f"{x(k)} as x{k}" for k in range(7)])
    made = rows.withColumn("features", array_to_vector(F.array(*[f"x{k}" for k in range(6)])))
    for label in ("x0 + x1 + x6 / 4", "5.0D"):
        monkeypatch.setattr(learning, "samples", lambda spark, d, label=label: made.withColumn("obs", F.expr(label)))
        out, best = learning.search(spark, "", {"all": {}})
        assert out.count() == 1500 and best == "all"
        if label != "5.0D":
            assert learning.variant_metrics(out).first().r2 > 0.92
        else:
            assert {r.pred for r in out.collect()} == {5.0}


def test_sites_of_a_cell_share_their_patch(spark):
    """The windows are made for two cells, not for 400 sites: rows of the join with the grid, at run time."""
    grid = spark.createDataFrame([(y, x, 2000, 1, float(10 * y + x)) for y in range(3) for x in range(4) if (y, x) != (0, 0)], "ilat long, ilon long, year int, mon int, v double")
    sites = spark.range(400).selectExpr("id as site", "1L as ilat", "1 + id % 2 as ilon")
    assert learn.windows(sites, grid, ["v"]).count() == 2
    got = {r.site: r.v for r in learn.patches(sites, grid, ["v"]).collect()}
    assert len(got) == 400 and got[0] == got[2] == [None, 1.0, 2.0, 10.0, 11.0, 12.0, 20.0, 21.0, 22.0] and got[1] == [1.0, 2.0, 3.0, 11.0, 12.0, 13.0, 21.0, 22.0, 23.0]


def test_lowess():
    x = np.linspace(0, 5, 21)
    assert np.allclose(uncertainty.lowess(x, 2 * x + 1, 0.4), 2 * x + 1)
    y = np.sin(x)
    y[10] = 30
    s = uncertainty.lowess(x, y, 0.4)
    assert abs(s[9] - np.sin(x[9])) < 0.3  # the outlier is weighted away
    plain = uncertainty.lowess(x, y, 0.4, 0)
    h = np.sort(abs(x - x[3]))[7]
    w = np.where(abs(x - x[3]) < 0.999 * h, (1 - np.minimum(abs(x - x[3]) / h, 1) ** 3) ** 3, 0)
    assert math.isclose(plain[3], np.polyval(np.polyfit(x, y, 1, w=np.sqrt(w)), x[3]), rel_tol=1e-9)


def test_tessellate(spark):
    rng = np.random.default_rng(2)
    rows, area = [], 0.0
    for k in range(20):
        a = rng.uniform(0, math.pi / 2)
        r = [a + i * math.pi / 2 for i in range(4)]
        y0, x0 = rng.uniform(10, 30), rng.uniform(20, 60)
        rows.append((1, 3.0, [y0 + 1.3 * math.sin(t) for t in r], [x0 + 1.3 * math.cos(t) for t in r]))
        area += 2 * 1.3**2
    got = raster.tessellate(spark.createDataFrame(rows, "day int, v double, lats array<double>, lons array<double>"), ["day"], ["v"], 0.0, 0.0, 0.5).toPandas()
    assert math.isclose(got.area.sum(), area, rel_tol=1e-9) and np.allclose(got.v, 3.0)
    line = [(1, None, [0.0, 0.0, 1.0, 1.0], [179.5, -179.5, -179.5, 179.5]), (1, 2.0, [0.0, 0.0, 1.0, 1.0], [179.0, 180.0, 180.0, 179.0])]
    got = raster.tessellate(spark.createDataFrame(line, "day int, v double, lats array<double>, lons array<double>"), ["day"], ["v"], -90.0, -180.0, 1.0).toPandas()
    assert sorted(got.ilon) == [0, 359] and got.set_index("ilon").v[359] == 2.0 and math.isnan(got.set_index("ilon").v[0])


def test_profile_correction(spark):
    xs, ys, at = [1.0, 2.0, 4.0], [3.0, 5.0, 4.0], [0.5, 1.5, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(xs, ys, at)], "xs array<double>, ys array<double>, at array<double>")
    r = df.select(raster.interpolated(F.col("at"), F.col("xs"), F.col("ys")).alias("a"), raster.interpolated(F.col("at"), F.col("xs"), F.col("ys"), True).alias("b"), raster.shape_factor(F.col("ys"), F.col("xs")).alias("c")).first()
    assert np.allclose(r.a, [2.0, 4.0, 4.5, 4.0, 3.5]) and np.allclose(r.b, [0, *np.interp(at[1:4], xs, ys), 0]) and math.isclose(r.c, (3 + 10 + 16) / 12)


def test_repeated_targets_and_borders(spark):
    g = spark.createDataFrame([(i, j, 10.0) for i in range(4) for j in range(4)], "ilat long, ilon long, v double")
    t = spark.createDataFrame([(1, 1.5, 1.5), (1, 1.5, 1.5), (2, 0.5, 2.25)], "site long, fy double, fx double")
    for f in (raster.bilinear, raster.bilinear_zero):
        assert [r.v for r in f(g, t).collect()] == [10.0] * 3
    a = np.random.default_rng(1).normal(size=(6, 7))
    a[2, 0] = a[5, 6] = np.nan
    df = spark.createDataFrame([(i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(6) for j in range(7)], "ilat long, ilon long, v double")
    got = raster.boxcar(df, 5, 4).toPandas().pivot(index="ilat", columns="ilon", values="focal").to_numpy()
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(a, ((5, 4), (5, 4)), mode="edge"), (10, 10))
    assert np.allclose(got, np.nanmean(windows, axis=(2, 3)))


def test_knn_lone_point(spark):
    rng = np.random.default_rng(4)
    sites = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(40, 50, 60), rng.uniform(0, 20, 60)))]
    lone = [(1000, -60.0, -150.0), (1001, 45.0, 10.0)]
    s, q = (spark.createDataFrame(x, "site long, lat double, lon double") for x in (sites, lone))
    got = {(r.site, r.site2) for r in spatial.knn_join(q, s, 3).collect()}
    km = lambda p, r: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(r[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(r[1])) * math.sin(math.radians(r[2] - p[2]) / 2) ** 2))
    assert got == {(p[0], r[0]) for p in lone for r in sorted(sites, key=lambda r, p=p: km(p, r))[:3]}


def test_vif_and_mahalanobis(spark):
    """M11 and P4 against numpy on the table's own vectors."""
    e = frame(spark, SF, "embeddings")
    x = e.select("vec_id", "label", "embedding").toPandas()
    v = np.array(x.embedding.tolist(), float)
    got = registry.QUERIES["m11_vif"](spark, SF).toPandas().set_index("feature").vif
    v = v[:, : len(got)]
    assert np.allclose(got.sort_index(), np.diag(np.linalg.inv(np.corrcoef(v.T))), rtol=1e-6)
    d = registry.QUERIES["p4_mahalanobis"](spark, SF).toPandas().set_index("vec_id").distance
    inverse = np.linalg.inv(np.cov(v.T))
    means = {k: v[(x.label == k).to_numpy()].mean(0) for k in x.label.unique()}
    for i, (key, label) in enumerate(zip(x.vec_id, x.label)):
        u = v[i] - means[label]
        assert math.isclose(d[key], math.sqrt(u @ inverse @ u), rel_tol=1e-5)


@pytest.mark.parametrize("name", ["o3_lowess"])
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def clipped(poly, x0, y0, step):
    """Area of a convex polygon in a cell: corners inside and crossings, one half-plane after the other."""
    for axis, bound, sign in ((0, x0, 1), (0, x0 + step, -1), (1, y0, 1), (1, y0 + step, -1)):
        out = []
        for p, q in zip(poly, poly[1:] + poly[:1]):
            a, b = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                out.append(tuple(u + (v - u) * a / (a - b) for u, v in zip(p, q)))
        poly = out
    return abs(sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(poly, poly[1:] + poly[:1]))) / 2 if poly else 0.0


def test_tessellate_turned_pixels(spark):
    """Turned, sheared and axis-parallel pixels, also with sides on grid lines and corners in any order, cell by cell."""
    rng = np.random.default_rng(8)
    pixels = []
    for k in range(60):
        y0, x0, t = rng.uniform(3, 12), rng.uniform(-12, 12), rng.uniform(0, math.pi)
        w, h, shear = rng.uniform(0.1, 1.5), rng.uniform(0.1, 1.5), rng.uniform(-0.4, 0.4)
        corners = [(w * a + shear * b, h * b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        pixels.append([(x0 + a * math.cos(t) - b * math.sin(t), y0 + a * math.sin(t) + b * math.cos(t)) for a, b in corners])
    pixels += [[(1.0, 5.0), (2.0, 5.0), (2.0, 6.0), (1.0, 6.0)], [(0.5, 5.0), (3.25, 5.0), (3.25, 5.5), (0.5, 5.5)]]
    want: dict = {}
    for k, poly in enumerate(pixels):
        for i in range(0, 30):
            for j in range(-30, 30):
                a = clipped(poly, j * 0.5, i * 0.5, 0.5)
                if a > 1e-9:
                    s = want.setdefault((i, j % 720), [0.0, 0.0, 0])
                    s[0], s[1], s[2] = s[0] + a * k, s[1] + a, s[2] + 1
    rows = [(1, float(k), [p[order][1] for order in o], [p[order][0] for order in o]) for k, p in enumerate(pixels) for o in [rng.permutation(4).tolist()]]
    df = spark.createDataFrame(rows, "day int, v double, lats array<double>, lons array<double>")
    got = {(r.ilat, r.ilon): (r.v, r.area, r.n) for r in raster.tessellate(df, ["day"], ["v"], 0.0, 0.0, 0.5).collect()}
    assert got.keys() == want.keys()
    for cell, (s, a, n) in want.items():
        assert math.isclose(got[cell][1], a, abs_tol=1e-8) and math.isclose(got[cell][0], s / a, abs_tol=1e-5) and got[cell][2] == n


def test_tessellate_edge_pixels(spark):
    """Pixels that touch the first or last parallel, or lack a corner, are left out whole."""
    box = lambda y0, y1: [y0, y0, y1, y1]
    lons = [0.2, 0.8, 0.8, 0.2]
    rows = [(1, 1.0, box(-0.5, 0.5), lons), (1, 1.0, box(0.0, 0.5), lons), (1, 2.0, box(0.1, 0.5), lons), (1, 1.0, box(1.5, 2.0), lons), (1, 3.0, box(1.2, 1.9), [360.2, 360.8, 360.8, 360.2]), (1, 1.0, [0.5, None, 0.7, 0.7], lons), (1, 1.0, None, lons)]
    df = spark.createDataFrame(rows, "day int, v double, lats array<double>, lons array<double>")
    got = {(r.ilat, r.ilon): r.v for r in raster.tessellate(df, ["day"], ["v"], 0.0, 0.0, 1.0, rows=2).collect()}
    assert got == {(0, 0): pytest.approx(2.0), (1, 0): pytest.approx(3.0)}


def test_corrected_column(spark):
    """Total and tropospheric columns against numpy, with falling pressures, missing levels and a floor."""
    rng = np.random.default_rng(6)
    p_model = np.linspace(1000, 100, 12)
    rows, want = [], []
    for k in range(30):
        prof, kern = rng.uniform(0, 1, 12), rng.uniform(0.2, 1.5, 9)
        p_sensor = np.sort(rng.uniform(60, 1050, 9))[::-1]
        sc, amf, tp = rng.uniform(1, 9), rng.uniform(0.3, 2), rng.uniform(150, 400)
        x, y = p_model[::-1], prof[::-1]
        total = np.interp(p_sensor, x, y)
        low, high = p_sensor < x[0], p_sensor > x[-1]
        total[low] = y[0] + (p_sensor[low] - x[0]) * (y[1] - y[0]) / (x[1] - x[0])
        total[high] = y[-1] + (p_sensor[high] - x[-1]) * (y[-1] - y[-2]) / (x[-1] - x[-2])
        f = amf * (total * kern).sum() / total.sum()
        yt = np.where(x >= tp, y, 0)
        trop = np.where(p_sensor >= tp, np.interp(p_sensor, x, yt, left=0, right=0), 0)
        g = amf * (trop * kern * (p_sensor >= tp)).sum() / trop.sum()
        want.append((f, sc / f, g, sc / g if g >= 0.5 else None))
        rows.append((k, sc, amf, kern.tolist(), p_sensor.tolist(), p_model.tolist(), prof.tolist(), tp))
    broken = list(rows[0])
    broken[0], broken[6] = 100, [None, *rows[0][6][1:]]
    thin = list(rows[0])
    thin[0], thin[7] = 101, 2000.0
    df = spark.createDataFrame([*rows, tuple(broken), tuple(thin)], "k long, sc double, amf double, kern array<double>, ps array<double>, pm array<double>, prof array<double>, tp double")
    df = raster.corrected_column(df, "total", "sc", "amf", "kern", "ps", "pm", "prof")
    df = raster.corrected_column(df, "trop", "sc", "amf", "kern", "ps", "pm", "prof", "tp", 0.5)
    got = {r.k: (r.total_amf, r.total, r.trop_amf, r.trop) for r in df.collect()}
    assert got[100] == (None,) * 4 and got[101][2:] == (None, None) and got[101][0] is not None
    assert any(w[3] is None for w in want) and any(w[3] for w in want)
    for k, w in enumerate(want):
        assert got[k] == tuple(None if x is None else pytest.approx(x) for x in w)


def km_between(p, r):
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(r[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(r[1])) * math.sin(math.radians(r[2] - p[2]) / 2) ** 2)))


@pytest.mark.parametrize(("k", "not_closer"), [(1, 0.0), (5, -1.0), (3, 0.1), (4, 30.0), (200, 0.0)])
def test_knn_by_counts(spark, k, not_closer):
    """Cities, empty regions, poles, the date line, sites on one spot and too few sites, against all distances."""
    rng = np.random.default_rng(k)
    places = [*rng.normal((48, 11), 0.02, (40, 2)), *rng.normal((48, 11), 3, (30, 2)), *zip(rng.uniform(-90, 90, 25), rng.uniform(-180, 180, 25)), *[(89.99, x) for x in (0, 90, -170)], *[(10, x) for x in (179.999, -179.999, 179.9)], *[(48.0, 11.0)] * 6]
    sites = [(i, float(a), float(b), i % 2) for i, (a, b) in enumerate(places)]
    asked = [*sites[::3], *[(1000 + i, float(a), float(b), i % 2) for i, (a, b) in enumerate([(-90, 0), (90, 10), (0, 180), (48, 11), (-48.0, -169.0), *zip(rng.uniform(-90, 90, 20), rng.uniform(-180, 180, 20))])]]
    schema = "site long, lat double, lon double, half long"
    q, s = spark.createDataFrame([*asked, (5000, None, 1.0, 0)], schema), spark.createDataFrame([*sites, (6000, 1.0, None, 0)], schema)
    for on in ((), ("half",)):
        want = {}
        for p in asked:
            order = sorted((round(km_between(p, r), 6), r[0]) for r in sites if (not on or r[3] == p[3]) and km_between(p, r) > not_closer)
            want[p[0]] = [km for km, _ in order[:k]]
        got: dict = {p[0]: [] for p in asked}
        for r in spatial.knn_join(q, s, k, not_closer, on=on).orderBy("site", "rank").collect():
            assert r.rank == len(got[r.site]) + 1
            got[r.site].append(round(r.km, 6))
        assert got.keys() == want.keys()
        for i in want:
            assert len(got[i]) == len(want[i]) and np.allclose(got[i], want[i], atol=2e-5), i


@pytest.mark.parametrize(("n", "rows"), [(300, 20), (300, 10**6), (1, 5), (0, 5)])
def test_concordance_by_counts(spark, n, rows):
    """Ties of times and risks, frequent values and missing ones, in many buckets and in one."""
    from skyloom.operators import metrics

    rng = np.random.default_rng(7)
    t = np.where(rng.random(n) < 0.4, 5.0, np.round(rng.uniform(0, 10, n), 1))
    r = np.where(rng.random(n) < 0.3, 1.0, np.round(rng.normal(0, 2, n), 1))
    e = rng.random(n) < 0.6
    data = [(float(a), float(b), bool(c)) for a, b, c in zip(t, r, e)]
    pairs = sum(1 for a in data for b in data if a[2] and a[0] < b[0])
    above = sum(1 for a in data for b in data if a[2] and a[0] < b[0] and a[1] > b[1])
    df = spark.createDataFrame([*data, (None, 1.0, True), (1.0, None, True)], "t double, r double, e boolean")
    got = metrics.concordance(df, "t", "r", "e", rows).first()
    assert got.pairs == pairs and (got.c is None if not pairs else math.isclose(got.c, above / pairs))


def test_scan_lines(spark):
    """Overlapping, concave and open rings, and cells on a side's crossing, against counting sides one by one."""
    rng = np.random.default_rng(11)
    edges = []
    for ring in range(6):
        n = int(rng.integers(3, 9))
        at = [(float(y), float(x)) for y, x in zip(rng.uniform(0, 10, n), rng.uniform(0, 12, n))]
        sides = list(zip(at, at[1:] + at[:1]))
        edges += [(ring, *a, *b) for a, b in (sides[:-1] if ring == 5 else sides)]
    edges += [(9, 2.0, 3.0, 2.0, 6.0), (9, 2.0, 6.0, 8.0, 6.0), (9, 8.0, 6.0, 8.0, 3.0), (9, 8.0, 3.0, 2.0, 3.0)]
    cells = [(i * 100 + j, i, i * 0.5 + 0.25, j * 0.5) for i in range(20) for j in range(24)]
    want = {}
    for site, _, lat, lon in cells:
        n: dict = {}
        for ring, y1, x1, y2, x2 in edges:
            if (y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
                n[ring] = n.get(ring, 0) + 1
        want[site] = int(any(c % 2 for c in n.values()))
    df = raster.inside_rings(spark.createDataFrame(cells, "site long, ilat long, lat double, lon double"), spark.createDataFrame(edges, "ring long, y1 double, x1 double, y2 double, x2 double"), 0.25, 0.5)
    assert {r.site: r.land for r in df.collect()} == want and 0 < sum(want.values()) < len(want)


def test_fuzzy_names_of_numbers(spark):
    """Names that differ in numbers alone: a neighbour by one edit, by two, ties, and none; pairs do not grow with their square."""
    from skyloom.operators import intake

    n = 20000
    sites = spark.range(n).selectExpr("1 as state", "format_string('Site#%09d', id * 1010 + 1000000) as name")
    names = spark.range(n).selectExpr("1 as state", "case id % 3 when 0 then format_string('Sit#%09d', id * 1010 + 1000000) when 1 then format_string('Station %09d', id) else format_string('Site#%09d', id * 1010 + 1000000) end as name")
    more = spark.createDataFrame([(1, "St#001001010"), (1, "Site#00100x010"), (2, "Site#001000000")], "state int, name string")
    df = intake.fuzzy_sites(names.unionByName(more), sites, "state")
    got = df.collect()
    by = {r.name: (r.site_name, r.score) for r in got}
    assert len(got) == len(by) == n - n // 3 + 2 - (n % 3 == 2)
    for r in got:
        if r.name.startswith("Sit#"):
            assert r.site_name == "Site" + r.name[3:] and math.isclose(r.score, 1 - 1 / 14, abs_tol=1e-6)
    assert by["St#001001010"] == ("Site#001001010", pytest.approx(1 - 2 / 14, abs=1e-6)) and by["Site#00100x010"] == ("Site#001001010", pytest.approx(1 - 1 / 14, abs=1e-6))


def test_cells_of_pixels_are_dealt(spark):
    """All pixels in one task before: their cells are made after a shuffle, and no lambda runs for each cell."""
    at = [(1, 3.0, [0.2, 0.2, 1.4, 1.4], [0.3, 1.7, 1.7, 0.3])]
    p = spark.createDataFrame(at, "day int, v double, lats array<double>, lons array<double>").coalesce(1)
    df = raster.tessellate(p, ["day"], ["v"], 0.0, 0.0, 1.0)
    assert {(r.ilat, r.ilon): (round(r.area, 9), r.n) for r in df.collect()} == {(0, 0): (0.56, 1), (0, 1): (0.56, 1), (1, 0): (0.28, 1), (1, 1): (0.28, 1)}
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    kinds = [next((k for k in ("Generate", "Repartition", "Aggregate") if k in line), None) for line in plan]
    assert kinds.index("Repartition") > max(i for i, k in enumerate(kinds) if k == "Generate")
    assert not any("lambda" in line for line in plan[: kinds.index("Generate")])


def test_metric_grid_meets_by_site(spark):
    """Rows of a site meet before they are exploded; before, each task held groups of all sites."""
    from skyloom.plans import model  # noqa: F401
    from skyloom.plans import registry

    plan = registry.QUERIES["n9_metric_grid"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression [site")


@pytest.mark.parametrize("least", [0.55, 0.7, 0.9])
def test_fuzzy_names(spark, least):
    """Every name against all of its group."""
    import random

    from skyloom.operators import intake

    rng = random.Random(3)

    def edited(w):
        w = list(w)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "Station"[rng.randrange(7)]])
        return "".join(w)

    sites = [(g, f"Station {rng.choice('abc')}{rng.choice('xyz')}{'ab' * rng.randrange(5)}") for g in (1, 2) for _ in range(25)] + [(1, "a"), (2, ""), (2, "ab")]
    names = [(g, edited(n)) for g, n in sites for _ in range(2)] + sites[:5] + [(1, "zzzz"), (3, "a"), (1, "")]

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for g, n in set(names):
        scored = [(-(1.0 if n == s else round(1 - far(n, s) / max(len(n), len(s)), 6)), s) for h, s in set(sites) if h == g]
        best = min((x for x in scored if -x[0] >= least), default=None)
        if best:
            want[g, n] = (best[1], -best[0])
    df = intake.fuzzy_sites(spark.createDataFrame(names, "state int, name string"), spark.createDataFrame(sites, "state int, name string"), "state", least)
    assert {(r.state, r.name): (r.site_name, pytest.approx(r.score, abs=1e-6)) for r in df.collect()} == want
    with pytest.raises(ValueError):
        intake.fuzzy_sites(df, df, "state", 0.5)


@pytest.mark.parametrize("block_bytes", [64 << 20, 200])
def test_group_inverses(spark, block_bytes):
    """Distances by each row's own group and by a reference, in one block of inverses and in several."""
    rng = np.random.default_rng(13)
    rows = [(k, f"g{k % 3}", rng.normal(k % 3, 1 + k % 3, 5).tolist(), rng.normal(0, 1, 5).tolist()) for k in range(120)]
    rows += [(1000, "g0", None, [0.0] * 5), (1001, None, [0.0] * 5, [0.0] * 5), (1002, "g1", [1.0, None, 0.0, 0.0, 0.0], [0.0] * 5), (1003, "other", [0.0] * 5, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, part string, v array<double>, ref array<double>").repartition(3)
    shapes = uncertainty.group_shapes(df.where("part <> 'other'"), "part", "v", 5)
    for ref in (None, "ref"):
        got = {r.id: r.distance for r in uncertainty.mahalanobis_by_group(df, "part", "v", shapes, 5, ref, block_bytes).collect()}
        assert len(got) == len(rows) and all(got[k] is None for k in range(1000, 1004))
        for g in range(3):
            x = np.array([r[2] for r in rows[:120] if r[1] == f"g{g}"])
            inverse, mean = np.linalg.inv(np.cov(x.T)), x.mean(0)
            for r in rows[:120]:
                if r[1] == f"g{g}":
                    w = np.array(r[2]) - (mean if ref is None else np.array(r[3]))
                    assert math.isclose(got[r[0]], math.sqrt(w @ inverse @ w), rel_tol=1e-9)


def test_singular_covariance_raises(spark):
    with pytest.raises(np.linalg.LinAlgError):
        uncertainty.inverse_of(np.array([[1.0, 2.0], [2.0, 4.0]]))
    df = spark.createDataFrame([("a", [float(k), 2.0 * k]) for k in range(9)], "part string, v array<double>")
    with pytest.raises(Exception, match="singular"):
        uncertainty.group_shapes(df, "part", "v", 2).collect()


def test_isolated_folds_are_padded(spark):
    """Fewer sites than folds: one to a fold; else folds by hash."""
    from skyloom.operators import splits

    few = spark.createDataFrame([(3,), (8,), (11,)], "site long")
    got = {r.site: r.fold for r in splits.isolated_folds(few, 5).collect()}
    assert set(got) == {3, 8, 11} and len(set(got.values())) == 3 and set(got.values()) <= set(range(5))
    assert splits.isolated_folds(few.limit(0), 5).count() == 0
    many = splits.isolated_folds(spark.range(40).withColumnRenamed("id", "site"), 5).collect()
    assert len(many) == 40 and {r.fold for r in many} <= set(range(5))


def test_weighted_type_two(spark):
    from skyloom.operators import metrics

    rng = np.random.default_rng(17)
    x = rng.normal(5, 2, 60)
    y, vx, vy = 1.7 * x + rng.normal(0, 1, 60), rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
    rows = [*map(lambda r: tuple(map(float, r)), zip(x, y, vx, vy)), (1.0, None, 1.0, 1.0), (1.0, 2.0, 0.0, 1.0)]
    t = metrics.type_two_weighted(*map(F.col, ("x", "y", "vx", "vy")))
    got = spark.createDataFrame(rows, "x double, y double, vx double, vy double").agg(*[c.alias(k) for k, c in t.items()]).first()
    a, b = np.polyfit(x, y, 1, w=1 / np.sqrt(vy))[0], 1 / np.polyfit(y, x, 1, w=1 / np.sqrt(vx))[0]
    a0, b0 = (x * y / vy).sum() / (x * x / vy).sum(), (y * y / vx).sum() / (x * y / vx).sum()
    assert math.isclose(got.slope, math.sqrt(a * b)) and math.isclose(got.r, math.sqrt(a / b)) and math.isclose(got.slope0, math.sqrt(a0 * b0))
    assert math.isclose(got.icpt, np.median(y) - math.sqrt(a * b) * np.median(x))


def test_fill_with_ratio(spark):
    """Tiers and the last resort come to the surface by eta; a value is there already; a reference of 0 gives no guess."""
    df = spark.createDataFrame([(7.0, 2.0, 4.0, 8.0, 0.5), (None, 2.0, 4.0, 8.0, 0.5), (None, 2.0, 0.0, 8.0, 0.5), (None, None, 4.0, 8.0, 0.5)], "v double, g double, m double, s double, eta double")
    c = F.col
    v, tier = raster.tiered_fill(c("v"), c("g"), [(c("m"), c("s"))], c("g"), c("eta"))
    assert [tuple(r) for r in df.select(v, tier).collect()] == [(7.0, 0), (2.0, 1), (1.0, 2), (None, None)]


def test_header_metadata(spark):
    from skyloom.functions import units

    rows = [("Station Name: A B, x\nDate Time,NO2\n,ppb", "/d/f.1.xlsx"), ("none\nNO2 , SO2\n ppm,ug", "f.csv"), ("x\nDate Time,NO2", "a/b"), (None, "a/b.txt")]
    df = spark.createDataFrame(rows, "h string, p string")
    got = df.select(units.station_name(F.col("h"), F.col("p")), units.header_unit(F.col("h"), "NO2")).collect()
    assert [tuple(r) for r in got] == [("A B", "ppb"), ("f", "ppm"), ("b", None), ("b", None)]
