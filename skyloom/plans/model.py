"""Registered queries of training tables, splits, ensembles, evaluation and uncertainty."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions.units import fold_of, season
from skyloom.operators import metrics as N
from skyloom.operators import splits as S
from skyloom.operators import uncertainty as V
from skyloom.plans.registry import query
from skyloom.sources.fixtures import frame, with_

R = lambda c, n=6: F.bround(c, n)
col = F.col
_FOLD = "cast(concat('0x', substr(md5(concat('20230130-', {k})), 1, 8)) as bigint) % {n}"
_SEASON = "case when mon in (12,1,2) then 'DJF' when mon in (3,4,5) then 'MAM' when mon in (6,7,8) then 'JJA' else 'SON' end"


@query("k1_patches", with_("grid", "sites") + ", g as (select ilat, ilon, avg(gchp) as v from grid group by ilat, ilon) select s.site, dy, dx, round_even(g.v,6) as v from sites s, range(-1,2) a(dy), range(-1,2) b(dx), g where g.ilat = s.site % 20 + dy and g.ilon = s.site % 25 + dx")
def k1(spark, d):
    return k1_patches(spark, d).withColumn("v", R("v"))


def k1_patches(spark, d):
    g = frame(spark, d, "grid").groupBy("ilat", "ilon").agg(F.avg("gchp").alias("v"))
    off = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    s = frame(spark, d, "sites").select("site", F.explode(off).alias("dy")).withColumn("dx", F.explode(off))
    s = s.withColumns({"ilat": col("site") % 20 + col("dy"), "ilon": col("site") % 25 + col("dx")})
    # estimates leave out that explode multiplies the sites, so without the hint they would be broadcast whole
    return s.join(g.hint("merge"), ["ilat", "ilon"]).select("site", "dy", "dx", "v")


@query("k3_append_channels", with_("obs", "obs2") + "select o.site, o.year, o.mon, round_even(o.no2,6) as no2, round_even(coalesce(b.no2,0),6) as extra from obs o left join obs2 b using (site, year, mon)")
def k3(spark, d):
    b = frame(spark, d, "obs2").select("site", "year", "mon", R("no2").alias("extra"))
    return frame(spark, d, "obs").select("site", "year", "mon", R("no2").alias("no2")).join(b, ["site", "year", "mon"], "left").fillna(0.0, ["extra"])


@query("k9_period_slice", with_("obs") + "select site, year, mon from obs where year between 1996 and 1998")
def k9(spark, d):
    return frame(spark, d, "obs").where("year between 1996 and 1998").select("site", "year", "mon")


@query("k10_labelled_sites", with_("obs") + "select site from obs where year = 1996 group by site having count(no2) > 0")
def k10(spark, d):
    return frame(spark, d, "obs").where("year = 1996").groupBy("site").agg(F.max(col("no2").isNotNull()).alias("any")).where("any").select("site")


@query("k11_centre", "select vec_id, round_even(embedding[13]::double,6) as centre from embeddings")
def k11(spark, d):
    return frame(spark, d, "embeddings").select("vec_id", R(F.element_at("embedding", 13).cast("double")).alias("centre"))


@query("k12_impute_zscore", with_("grid") + ", m as (select avg(sat) as a from grid), f as (select ilat, ilon, year, mon, coalesce(sat, a) as v from grid, m), s as (select avg(v) as a, stddev_samp(v) as s from f) select ilat, ilon, year, mon, round_even((v-a)/s,6) as z from f, s")
def k12(spark, d):
    g = frame(spark, d, "grid")
    f = g.crossJoin(F.broadcast(g.agg(F.avg("sat").alias("a0")))).select("ilat", "ilon", "year", "mon", F.coalesce("sat", "a0").alias("v"))
    s = f.agg(F.avg("v").alias("a"), F.stddev_samp("v").alias("s"))
    return f.crossJoin(F.broadcast(s)).select("ilat", "ilon", "year", "mon", R((col("v") - col("a")) / col("s")).alias("z"))


@query("l2_stratified_folds", with_("sites") + "select site, region, (row_number() over (partition by region order by md5(concat('20230130-', site)), site) - 1) % 5 as fold from sites")
def l2(spark, d):
    return S.stratified_folds(frame(spark, d, "sites"), 5).select("site", "region", "fold")


#: Overlapping region masks on a grid of one degree.
_MASKS = ", mask as (select 'north' as region, y.i as ilat, x.i as ilon from range(20, 30) y(i), range(0, 40) x(i) union all select 'west', y.i, x.i from range(0, 30) y(i), range(0, 9) x(i) union all select 'south', y.i, x.i from range(0, 8) y(i), range(0, 40) x(i)), spot as (select site, least(greatest(round_even(lat-30.5e0,0),0),29) as ilat, least(greatest(round_even(lon+9.5e0,0),0),39) as ilon from sites)"


def masks(spark):
    """Rectangles of cells (region, ilat, ilon), as a region's raster would give them."""
    box = lambda n, y0, y1, x1: spark.range(y0, y1).select(F.lit(n).alias("region"), col("id").alias("ilat"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x1 - 1).cast("long"))).alias("ilon"))
    return box("north", 20, 30, 40).unionByName(box("west", 0, 30, 9)).unionByName(box("south", 0, 8, 40))


@query("l3_region_filter", with_("sites") + _MASKS + " select distinct 'two' as wanted, site from spot join mask using (ilat, ilon) where region in ('north', 'west') union all select 'all', site from sites")
def l3(spark, d):
    """Sites in the union of two masks, and those for an empty list of regions: all."""
    s, m = frame(spark, d, "sites"), masks(spark)
    of = lambda names: S.in_regions(s, m, names, 30.5, -9.5, 1.0, 30, 40).select("site")
    return of(["north", "west", "no such region"]).select(F.lit("two").alias("wanted"), "site").unionByName(of([]).select(F.lit("all").alias("wanted"), "site"))


@query("l4_sample_folds", with_("obs") + f"select site, year, mon, {_FOLD.format(k='site*100000+year*12+mon', n=5)} as fold from obs")
def l4(spark, d):
    key = col("site") * 100000 + col("year") * 12 + col("mon")
    return frame(spark, d, "obs").select("site", "year", "mon", fold_of(key, 5).alias("fold"))


@query("l5_fixed_test", with_("sites") + "select site, case when row_number() over (order by md5(concat('20230130-', site)), site) <= 30 then 1 else -1 end as role from sites")
def l5(spark, d):
    return S.fixed_test(frame(spark, d, "sites"), 30).select("site", "role")


@query("l9_roles_report", with_("sites") + f", f as (select site, {_FOLD.format(k='site', n=10)} as own from sites) select f as fold, case when f = own then 1 else -1 end as role, count(*) as n from f, range(10) t(f) group by all".replace(", f as (select site", ", ff as (select site").replace("from f, range(10)", "from ff, range(10)"))
def l9(spark, d):
    r = S.roles(S.random_folds(frame(spark, d, "sites"), 10), 10)
    return r.groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("m5_forced_slope", with_("cv") + ", t as (select year, mon, regr_slope(pred,obs) as a, 1/regr_slope(obs,pred) as b, avg(pred) as my, avg(obs) as mx from cv where split='train' group by year, mon), s as (select year, mon, case when a*b>=0 then sign(a)*sqrt(a*b) end as s, my, mx from t) select site, year, mon, count(*) as n, round_even(avg((pred-(my-s*mx))/s),4) as pred from cv join s using (year, mon) where split='test' and s <> 0 group by site, year, mon")
def m5(spark, d):
    cv = frame(spark, d, "cv")
    slope, icpt = N.rma(col("obs"), col("pred"))
    fit = cv.where("split = 'train'").groupBy("year", "mon").agg(slope.alias("s"), icpt.alias("i"))
    j = cv.where("split = 'test'").join(F.broadcast(fit), ["year", "mon"]).where("s <> 0")
    return j.groupBy("site", "year", "mon").agg(F.count("*").alias("n"), R(F.avg((col("pred") - col("i")) / col("s")), 4).alias("pred"))


@query("m6_distance_blend", with_("cv") + ", c as (select *, pow(greatest(0, (pop-20)/(pop+1e-7)),2) as c from cv) select site, year, mon, split, round_even(avg((1-c)*pred+c*geo),4) as v from c group by site, year, mon, split")
def m6(spark, d):
    c = F.pow(F.greatest(F.lit(0.0), (col("pop") - 20) / (col("pop") + 1e-7)), 2)
    return frame(spark, d, "cv").withColumn("c", c).groupBy("site", "year", "mon", "split").agg(R(F.avg((1 - col("c")) * col("pred") + col("c") * col("geo")), 4).alias("v"))


_SEL = with_("hist") + ", p as (select step, feature, avg(selected) as p from hist group by step, feature), r as (select *, min(p) over (partition by feature order by step) as run from p) "


def selection(spark, d):
    p = frame(spark, d, "hist").groupBy("step", "feature").agg(F.avg("selected").alias("p"))
    return p.withColumn("run", F.min("p").over(Window.partitionBy("feature").orderBy("step")))


@query("m8_selection_probability", _SEL + "select step, feature, round_even(p,6) as p, round_even(run,6) as run from r")
def m8(spark, d):
    return selection(spark, d).select("step", "feature", R("p").alias("p"), R("run").alias("run"))


@query("m9_exit_step", with_("hist") + "select model, feature, min(case when selected = 0 then step end) as exit_step from hist group by model, feature")
def m9(spark, d):
    return frame(spark, d, "hist").groupBy("model", "feature").agg(F.min(F.when(col("selected") == 0, col("step"))).alias("exit_step"))


#: The fixture's channels are the first elements of the vectors (FIXTURES.md).
CHANNELS = 8


@query("m11_vif")
def m11(spark, d):
    """Variance inflation of every channel: the diagonal of the inverse correlation matrix; constant channels get the bound."""
    e = frame(spark, d, "embeddings")
    c = V.covariance(e, "embedding", CHANNELS)
    sd = np.sqrt(np.diag(c))
    vary = np.flatnonzero(sd > 0)
    vif = np.full(len(sd), 1e9)
    vif[vary] = np.clip(np.diag(V.inverse_of((c / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1)))[np.ix_(vary, vary)])), 1, 1e9)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(vif)], "feature int, vif double")


@query("m13_population_weighted", with_("cv") + "select region, year, round_even(sum(case when pred>0 then pop*pred end)/sum(case when pred>0 then pop end),4) as pwm from cv group by region, year")
def m13(spark, d):
    return frame(spark, d, "cv").groupBy("region", "year").agg(R(N.weighted_mean(col("pred"), col("pop")), 4).alias("pwm"))


@query("n1_r2", with_("cv") + "select region, round_even(pow(corr(obs,pred),2),6) as r2 from cv group by region")
def n1(spark, d):
    return frame(spark, d, "cv").groupBy("region").agg(R(N.r2(col("obs"), col("pred"))).alias("r2"))


@query("n2_rmse", with_("cv") + "select region, round_even(sqrt(avg((obs-pred)*(obs-pred))),2) as rmse from cv group by region")
def n2(spark, d):
    return frame(spark, d, "cv").groupBy("region").agg(N.rmse(col("obs"), col("pred")).alias("rmse"))


@query("n3_nrmse", with_("cv") + "select region, round_even(round_even(sqrt(avg((obs-pred)*(obs-pred))),2)/avg(obs),6) as nrmse from cv group by region")
def n3(spark, d):
    return frame(spark, d, "cv").groupBy("region").agg(R(N.nrmse(col("pred"), col("obs"))).alias("nrmse"))


@query("n4_weighted_rrmse", with_("cv") + "select region, round_even(sqrt(sum(pop*(pred-obs)*(pred-obs))/sum(pop))/(sum(pop*pred)/sum(pop)),3) as v from cv group by region")
def n4(spark, d):
    return frame(spark, d, "cv").groupBy("region").agg(N.weighted_rrmse(col("pred"), col("obs"), col("pop")).alias("v"))


@query("n5_weighted_mean", with_("cv") + "select year, round_even(sum(pop*obs)/nullif(sum(pop),0),4) as v from cv where obs > 0 group by year")
def n5(spark, d):
    return frame(spark, d, "cv").groupBy("year").agg(R(N.weighted_mean(col("obs"), col("pop")), 4).alias("v"))


@query("n6_ols", with_("cv") + "select region, round_even(regr_slope(pred,obs),6) as slope, round_even(regr_intercept(pred,obs),3) as icpt from cv group by region")
def n6(spark, d):
    return frame(spark, d, "cv").groupBy("region").agg(R(F.regr_slope("pred", "obs")).alias("slope"), R(F.regr_intercept("pred", "obs"), 3).alias("icpt"))


@query("n8_fold_merge", with_("cv") + "select site, year, mon, round_even(sum(case when split='test' then pred end),4) as pred from cv group by site, year, mon")
def n8(spark, d):
    return frame(spark, d, "cv").groupBy("site", "year", "mon").agg(R(F.sum(F.when(col("split") == "test", col("pred"))), 4).alias("pred"))


@query("n10_all_time", with_("cv") + ", y as (select year, avg(obs) as v from cv group by year) select round_even(avg(v),4) as mean, round_even(min(v),4) as lo, round_even(max(v),4) as hi, round_even(stddev_pop(v),4) as sd from y")
def n10(spark, d):
    y = frame(spark, d, "cv").groupBy("year").agg(F.avg("obs").alias("v"))
    return y.agg(R(F.avg("v"), 4).alias("mean"), R(F.min("v"), 4).alias("lo"), R(F.max("v"), 4).alias("hi"), R(F.stddev_pop("v"), 4).alias("sd"))


@query("n11_site_means", with_("cv") + "select site, mon, round_even(avg(obs),4) as obs, round_even(avg(pred),4) as pred from cv group by grouping sets ((site, mon), (site))")
def n11(spark, d):
    return frame(spark, d, "cv").groupingSets([["site", "mon"], ["site"]], "site", "mon").agg(R(F.avg("obs"), 4).alias("obs"), R(F.avg("pred"), 4).alias("pred"))


@query("n13_metrics_by_region", with_("cv") + "select region, year, round_even(pow(corr(obs,pred),2),6) as r2, round_even(sqrt(avg((obs-pred)*(obs-pred))),2) as rmse from cv group by region, year having count(*) > 2")
def n13(spark, d):
    g = frame(spark, d, "cv").groupBy("region", "year").agg(F.count("*").alias("n"), R(N.r2(col("obs"), col("pred"))).alias("r2"), N.rmse(col("obs"), col("pred")).alias("rmse"))
    return g.where("n > 2").drop("n")


_DIST = with_("cv") + ", x as (select *, pop as distance, round_even((pred-obs)/obs, 9) as ratio, cast(floor(pop/5) as bigint) as bin from cv where obs is not null and pred is not null)"


@query("o1_distance_bins", _DIST + ", q as (select bin, quantile_cont(ratio,0.05) as lo, quantile_cont(ratio,0.95) as hi from x group by bin) select x.bin, count(*) as n, round_even(round_even(sqrt(avg((pred-obs)*(pred-obs))),2)/avg(obs),6) as rrmse from x join q using (bin) where ratio between lo and hi group by x.bin")
def o1(spark, d):
    return V.binned_rrmse(frame(spark, d, "cv").withColumn("distance", col("pop")), 5).withColumn("rrmse", R("rrmse"))


@query("o5_absolute_uncertainty", with_("cv") + ", r as (select region, sqrt(avg((obs-pred)*(obs-pred)))/avg(obs) as rr from cv group by region) select site, round_even(avg(rr*pred),4) as u from cv join r using (region) group by site")
def o5(spark, d):
    cv = frame(spark, d, "cv")
    r = cv.groupBy("region").agg((F.sqrt(F.avg(F.pow(col("obs") - col("pred"), 2))) / F.avg("obs")).alias("rr"))
    return cv.join(F.broadcast(r), "region").groupBy("site").agg(R(F.avg(col("rr") * col("pred")), 4).alias("u"))


@query("p3_covariance", "select " + ", ".join(f"round_even(covar_samp(embedding[{i + 1}]::double, embedding[{j + 1}]::double),9) as c{i}_{j}" for i in range(4) for j in range(i, 4)) + " from embeddings")
def p3(spark, d):
    c = V.covariance(frame(spark, d, "embeddings"), "embedding", 4)
    return spark.createDataFrame([tuple(float(c[i, j]) for i in range(4) for j in range(i, 4))], ", ".join(f"c{i}_{j} double" for i in range(4) for j in range(i, 4))).select(*[R(f"c{i}_{j}", 9).alias(f"c{i}_{j}") for i in range(4) for j in range(i, 4)])


@query("p4_mahalanobis")
def p4(spark, d):
    """Distance of every vector to its label's mean over all channels, with the pooled covariance."""
    e = frame(spark, d, "embeddings")
    n = CHANNELS
    mean = e.groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(n)]).alias("m"))
    inv = V.inverse_of(V.covariance(e, "embedding", n))
    return e.join(F.broadcast(mean), "label").select("vec_id", "label", R(V.mahalanobis(col("embedding"), col("m"), inv)).alias("distance"))


_GROUPED = """with x as (select c_custkey as id, c_mktsegment as part, c_acctbal as a, cast(c_nationkey as double) as b from customer),
 s as (select part, avg(a) as ma, avg(b) as mb, var_samp(a) as aa, covar_samp(a,b) as ab, var_samp(b) as bb from x group by part)
 select id, part, round_even(sqrt(greatest(0, (bb*(a-ma)*(a-ma)-2*ab*(a-ma)*(b-mb)+aa*(b-mb)*(b-mb))/(aa*bb-ab*ab))),5) as distance from x join s using (part)"""


@query("p4_group_inverse", _GROUPED)
def p4_groups(spark, d):
    """Every row with the inverse of its own group."""
    x = frame(spark, d, "customer").select(col("c_custkey").alias("id"), col("c_mktsegment").alias("part"), F.array(col("c_acctbal").cast("double"), col("c_nationkey").cast("double")).alias("v"))
    return V.mahalanobis_by_group(x, "part", "v", V.group_shapes(x, "part", "v", 2), 2).select("id", "part", R("distance", 5).alias("distance"))


@query("p5_standardise", "with s as (select avg(embedding[1]::double) as a, stddev_pop(embedding[1]::double) as s from embeddings) select vec_id, round_even((embedding[1]::double-a)/s,5) as z from embeddings, s")
def p5(spark, d):
    e = frame(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return e.crossJoin(F.broadcast(e.agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("s")))).select("vec_id", R((col("x") - col("a")) / col("s"), 5).alias("z"))


@query("p9_long_term_mean", with_("grid") + "select ilat, ilon, round_even(avg(gchp),6) as v from grid group by ilat, ilon")
def p9(spark, d):
    return frame(spark, d, "grid").groupBy("ilat", "ilon").agg(R(F.avg("gchp")).alias("v"))


@query("k4_load_transforms", with_("sites", "grid") + ", g as (select ilat, ilon, avg(sat) as v from grid group by ilat, ilon) select s.site, round_even(s.lon+181e0,6) as lon, round_even(s.lat+91e0,6) as lat, round_even(g.v*1e16/2.69e16,6) as sat_du from sites s left join g on g.ilat = s.site % 20 and g.ilon = s.site % 25")
def k4(spark, d):
    g = frame(spark, d, "grid").groupBy("ilat", "ilon").agg(F.avg("sat").alias("v"))
    s = frame(spark, d, "sites").withColumns({"ilat": col("site") % 20, "ilon": col("site") % 25})
    return s.join(g, ["ilat", "ilon"], "left").select("site", R(col("lon") + 181).alias("lon"), R(col("lat") + 91).alias("lat"), R(col("v") * 1e16 / 2.69e16).alias("sat_du"))


@query("m12_annual_map", with_("grid") + "select ilat, ilon, year, count(gchp) as months, round_even(avg(gchp),6) as v from grid group by ilat, ilon, year")
def m12(spark, d):
    return frame(spark, d, "grid").groupBy("ilat", "ilon", "year").agg(F.count("gchp").alias("months"), R(F.avg("gchp")).alias("v"))


_PATCH = with_("grid", "sites") + ", g as (select ilat, ilon, avg(gchp) as v from grid group by ilat, ilon), p as (select s.site, dy, dx, g.v from sites s, range(-1,2) a(dy), range(-1,2) b(dx), g where g.ilat = s.site % 20 + dy and g.ilon = s.site % 25 + dx)"


@query("k6_normalise", _PATCH + ", m as (select dy, dx, avg(v) as a, stddev_pop(v) as s, min(v) as lo, max(v) as hi from p where site % 2 = 0 group by all) select site, dy, dx, round_even((v-a)/case when s = 0 then 1 else s end,6) as gaussian, round_even((v-lo)/case when hi = lo then 1 else hi-lo end,6) as minmax, round_even(v,6) as plain from p join m using (dy, dx)")
def k6(spark, d):
    """Per patch position, with the scales of labelled rows (even sites)."""
    p = k1_patches(spark, d)
    m = p.where("site % 2 = 0").groupBy("dy", "dx").agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    return p.join(F.broadcast(m), ["dy", "dx"]).select("site", "dy", "dx", R((col("v") - col("a")) / one(col("s"))).alias("gaussian"), R((col("v") - col("lo")) / one(col("hi") - col("lo"))).alias("minmax"), R("v").alias("plain"))


_FOLD2 = _FOLD.replace("20230130", "20230131")


@query("l1_random_folds", with_("sites", "obs") + f", v as (select distinct site from obs where year between 1996 and 1998) select site, 0 as repeat, {_FOLD.format(k='site', n=10)} as fold from sites join v using (site) union all select site, 1, {_FOLD2.format(k='site', n=10)} from sites join v using (site)")
def l1(spark, d):
    """Two repeats over the sites that have a label in the period."""
    v = frame(spark, d, "obs").where("year between 1996 and 1998").select("site").distinct()
    return S.random_folds(frame(spark, d, "sites").join(v, "site", "left_semi"), 10, 2).select("site", "repeat", "fold")


@query("m7_ensemble", with_("cv") + """, w as (select greatest(pow(corr(obs,pred),2),0) as a, greatest(pow(corr(obs,geo),2),0) as b, sum((obs-geo)*(pred-geo))/sum((pred-geo)*(pred-geo)) as e,
 sum(pred*pred)+1e0 as pp, sum(pred*geo) as pg, sum(geo*geo)+1e0 as gg, sum(pred*obs) as po, sum(geo*obs) as go from cv where split = 'train'), r as (select *, (po*gg-go*pg)/(pp*gg-pg*pg) as u, (go*pp-po*pg)/(pp*gg-pg*pg) as v from w)
 select site, count(*) as n, round_even(avg((pred+geo)/2),4) as mean, round_even(avg((pred*a+geo*b)/(a+b)),4) as by_r2, round_even(avg(least(greatest(e,0),1)*pred+(1-least(greatest(e,0),1))*geo),4) as by_rmse, round_even(avg(u*pred+v*geo),4) as ridge from cv, r group by site""")
def m7(spark, d):
    """Mean, R2-weighted, RMSE-optimal and ridge-stacked ensembles; the weights are one row, made from training rows."""
    cv = frame(spark, d, "cv")
    o, p, g = col("obs"), col("pred"), col("geo")
    w = cv.where("split = 'train'").agg(N.r2(o, p).alias("a"), N.r2(o, g).alias("b"), F.try_divide(F.sum((o - g) * (p - g)), F.sum((p - g) * (p - g))).alias("e"), *[F.sum(x).alias(n) for n, x in (("pp", p * p), ("pg", p * g), ("gg", g * g), ("po", p * o), ("go", g * o))])
    w = w.withColumns({"pp": col("pp") + 1.0, "gg": col("gg") + 1.0, "e": F.least(F.greatest("e", F.lit(0.0)), F.lit(1.0))}).withColumn("det", col("pp") * col("gg") - col("pg") * col("pg"))
    w = w.withColumns({"u": (col("po") * col("gg") - col("go") * col("pg")) / col("det"), "v": (col("go") * col("pp") - col("po") * col("pg")) / col("det")})
    j = cv.crossJoin(F.broadcast(w))
    r2 = F.when(col("a") + col("b") == 0, (p + g) / 2).otherwise((p * col("a") + g * col("b")) / (col("a") + col("b")))
    return j.groupBy("site").agg(F.count("*").alias("n"), R(F.avg((p + g) / 2), 4).alias("mean"), R(F.avg(r2), 4).alias("by_r2"), R(F.avg(col("e") * p + (1 - col("e")) * g), 4).alias("by_rmse"), R(F.avg(col("u") * p + col("v") * g), 4).alias("ridge"))


@query("m10_attribution", "with e as (select vec_id, (i - 1) % 8 as feature, sum(embedding[i]::double) as s from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by all), m as (select feature, min(s) as lo, max(s) as hi from e group by feature), a as (select feature, avg((s-lo)/nullif(hi-lo,0)) as v from e join m using (feature) group by feature) select feature, round_even(v,6) as importance, row_number() over (order by round_even(v,6) desc, feature) as place from a")
def m10(spark, d):
    """Attributions summed over the patch, scaled to 0..1 per feature, averaged and ranked."""
    e = frame(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).groupBy("vec_id", (col("i") % 8).cast("long").alias("feature")).agg(F.sum(col("x").cast("double")).alias("s"))
    m = e.groupBy("feature").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    a = e.join(F.broadcast(m), "feature").groupBy("feature").agg(R(F.avg(F.try_divide(col("s") - col("lo"), col("hi") - col("lo")))).alias("importance"))
    return a.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))  # one row per feature


@query("m14_area_under_path", _SEL + ", l as (select feature, p, log10(step) as x, lag(p) over w as q, lag(log10(step)) over w as px from p where step > 0 window w as (partition by feature order by step)), a as (select feature, feature % 3 as kind, round_even(sum(0.5*(p+q)*(x-px)),4) as area from l where q is not null group by feature) select feature, kind, area from a qualify row_number() over (partition by kind order by area desc, feature) <= 3")
def m14(spark, d):
    """Area over the logarithm of the penalty's step; the three largest of each group of features."""
    w = Window.partitionBy("feature").orderBy("step")
    x = selection(spark, d).where("step > 0").withColumn("x", F.log10("step")).withColumns({"q": F.lag("p").over(w), "px": F.lag("x").over(w)}).where("q is not null")
    a = x.groupBy("feature", (col("feature") % 3).alias("kind")).agg(R(F.sum(0.5 * (col("p") + col("q")) * (col("x") - col("px"))), 4).alias("area"))
    return a.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("area"), "feature"))).where("_r <= 3").drop("_r")


@query("n7_type_two", with_("cv") + """, t as (select region, count(*) as n, regr_slope(pred,obs) as a, 1/regr_slope(obs,pred) as b, avg(pred) as y, avg(obs) as x, regr_sxx(pred,obs) as sxx, regr_syy(pred,obs) as syy, regr_sxy(pred,obs) as sxy, sum(obs*obs) as xx, sum(obs*pred) as xy, sum(pred*pred) as yy from cv group by region),
 s as (select *, sign(a)*sqrt(a*b) as slope from t where a*b >= 0), e as (select *, (syy-2*slope*sxy+slope*slope*sxx)/(n-2) as s2 from s)
 select region, round_even(slope,6) as slope, round_even(y-slope*x,3) as icpt, round_even(sign(a)*sqrt(a/b),6) as r, round_even(sqrt(s2/sxx),6) as se_slope, round_even(sqrt(xx*s2/(n*sxx)),3) as se_icpt, round_even(sign(xy)*sqrt(yy/xx),6) as slope0, round_even((syy-sxx+sqrt((syy-sxx)*(syy-sxx)+4*sxy*sxy))/(2*sxy),6) as major, round_even((a+b)/2,6) as arithmetic from e""")
def n7(spark, d):
    """Reduced major axis with errors, the form without intercept, the major axis and the arithmetic mean."""
    t = N.type_two(col("obs"), col("pred"))
    digits = {"icpt": 3, "se_icpt": 3}
    return frame(spark, d, "cv").groupBy("region").agg(*[R(x, digits.get(k, 6)).alias(k) for k, x in t.items()]).where("slope is not null")


_WEIGHTED = with_("cv") + """, c as (select region, obs as x, pred as y, pop as vy, pop * 2 + 1 as vx from cv),
 t as (select region, (sum(x*y/vy)-sum(x/vy)*sum(y/vy)/sum(1/vy))/(sum(x*x/vy)-sum(x/vy)*sum(x/vy)/sum(1/vy)) as a, (sum(y*y/vx)-sum(y/vx)*sum(y/vx)/sum(1/vx))/(sum(x*y/vx)-sum(x/vx)*sum(y/vx)/sum(1/vx)) as b, sum(x*y/vy)/sum(x*x/vy) as a0, sum(y*y/vx)/sum(x*y/vx) as b0, quantile_cont(y,0.5) as my, quantile_cont(x,0.5) as mx from c group by region)
 select region, round_even(sign(a)*sqrt(a*b),6) as slope, round_even(my-sign(a)*sqrt(a*b)*mx,3) as icpt, round_even(sign(a)*sqrt(a/b),6) as r, round_even(sign(a0)*sqrt(a0*b0),6) as slope0 from t"""


@query("n7_type_two_weighted", _WEIGHTED)
def n7_weighted(spark, d):
    """Reduced major axis of two weighted regressions; the variances come with the rows."""
    t = N.type_two_weighted(col("obs"), col("pred"), col("pop") * 2 + 1, col("pop"))
    return frame(spark, d, "cv").groupBy("region").agg(*[R(x, 3 if k == "icpt" else 6).alias(k) for k, x in t.items()])


def _r2_sql(x, y):
    return f"case when regr_count({y},{x}) > 0 then case when regr_sxx({y},{x}) = 0 or regr_syy({y},{x}) = 0 then 0 else coalesce(pow(corr({x},{y}),2),0) end end"


_PICK = ", ".join(f"avg(case when split='{s}' then {c} end) as {n}" for n, s, c in (("o", "test", "obs"), ("p", "test", "pred"), ("g", "test", "geo"), ("w", "test", "pop"), ("fo", "train", "obs"), ("fp", "train", "pred")))
_N9 = with_("cv") + f""", x as (select *, unnest([cast(mon as varchar), {_SEASON}, 'Annual']) as period from cv), m as (select site, year, period, {_PICK} from x group by site, year, period union all
 select site, year, 'AllPoints', case when split='test' then obs end, case when split='test' then pred end, case when split='test' then geo end, case when split='test' then pop end, case when split='train' then obs end, case when split='train' then pred end from cv)
 select period, year, count(o) as n, round_even({_r2_sql('o', 'p')},6) as r2, round_even({_r2_sql('fo', 'fp')},6) as train_r2, round_even({_r2_sql('o', 'g')},6) as geo_r2, round_even(sqrt(avg((o-p)*(o-p))),2) as rmse, round_even(round_even(sqrt(avg((o-p)*(o-p))),2)/avg(o),6) as nrmse,
 round_even(sqrt(sum(w*(p-o)*(p-o))/sum(w))/(sum(w*p)/sum(w)),3) as pwm_rrmse, round_even(case when regr_slope(p,o)/nullif(regr_slope(o,p),0) >= 0 then sign(regr_slope(p,o))*sqrt(regr_slope(p,o)/nullif(regr_slope(o,p),0)) end,5) as slope, round_even(sum(case when p > 0 then w*p end)/nullif(sum(case when p > 0 then w end),0),3) as pwm_model, round_even(sum(case when o > 0 then w*o end)/nullif(sum(case when o > 0 then w end),0),3) as pwm_monitor
 from m group by grouping sets ((period, year), (period)) having count(o) > 10"""


@query("n9_metric_grid", _N9)
def n9(spark, d):
    """The main report: one pass makes site means of every period and split, one grouping makes all metrics."""
    cv = frame(spark, d, "cv")
    side = lambda s, c: F.when(col("split") == s, col(c))
    parts = (("o", "test", "obs"), ("p", "test", "pred"), ("g", "test", "geo"), ("w", "test", "pop"), ("fo", "train", "obs"), ("fp", "train", "pred"))
    # rows of a site meet first: a task that read rows of all sites would hold a group for most of its exploded rows
    x = cv.repartition("site").withColumn("period", F.explode(F.array(col("mon").cast("string"), season(col("mon")), F.lit("Annual"))))
    m = x.groupBy("site", "year", "period").agg(*[F.avg(side(s, c)).alias(n) for n, s, c in parts])
    m = m.unionByName(cv.select("site", "year", F.lit("AllPoints").alias("period"), *[side(s, c).alias(n) for n, s, c in parts]))
    o, p, g, w = (col(n) for n in "opgw")
    slope, _ = N.rma(o, p)
    out = m.groupingSets([["period", "year"], ["period"]], "period", "year").agg(
        F.count("o").alias("n"), R(N.r2(o, p)).alias("r2"), R(N.r2(col("fo"), col("fp"))).alias("train_r2"), R(N.r2(o, g)).alias("geo_r2"), N.rmse(o, p).alias("rmse"), R(N.nrmse(p, o)).alias("nrmse"),
        N.weighted_rrmse(p, o, w).alias("pwm_rrmse"), R(slope, 5).alias("slope"), R(N.weighted_mean(p, w), 3).alias("pwm_model"), R(N.weighted_mean(o, w), 3).alias("pwm_monitor"),
    )
    return out.where("n > 10")


_BIN = "cast(least(floor(({v}-lo)/(hi-lo)*100),99) as bigint)"


@query("n14_density_histogram", with_("cv") + f", l as (select min(least(obs,pred,geo)) as lo, max(greatest(obs,pred,geo)) as hi from cv), x as (select year, 'pred' as field, obs, pred as v from cv union all select year, 'geo', obs, geo from cv), s as (select year, field, count(*) as total, round_even(pow(corr(obs,v),2),6) as r2, round_even(sqrt(avg((obs-v)*(obs-v))),2) as rmse from x group by all) select year, field, {_BIN.format(v='obs')} as bx, {_BIN.format(v='v')} as bp, count(*) as n, any_value(total) as total, any_value(r2) as r2, any_value(rmse) as rmse from x join s using (year, field), l group by all")
def n14(spark, d):
    """100 x 100 bins over the common range, per year, for the prediction and the geophysical field, with their label."""
    cv = frame(spark, d, "cv")
    lim = F.broadcast(cv.agg(F.min(F.least("obs", "pred", "geo")).alias("lo"), F.max(F.greatest("obs", "pred", "geo")).alias("hi")))
    x = cv.select("year", "obs", "pred", "geo").unpivot(["year", "obs"], ["pred", "geo"], "field", "v")
    s = x.groupBy("year", "field").agg(F.count("*").alias("total"), R(N.r2(col("obs"), col("v"))).alias("r2"), N.rmse(col("obs"), col("v")).alias("rmse"))
    at = lambda c: F.least(F.floor((col(c) - col("lo")) / (col("hi") - col("lo")) * 100), F.lit(99)).alias
    b = x.crossJoin(lim).groupBy("year", "field", at("obs")("bx"), at("v")("bp")).agg(F.count("*").alias("n"))
    return b.join(F.broadcast(s), ["year", "field"])


@query("o6_report_pivot", with_("cv") + ", x as (select *, unnest([0, 15, 30]) as radius from cv), m as (select radius, region, year, mon, sqrt(avg((obs-pred)*(obs-pred)))/avg(obs) as rr, pow(corr(obs,pred),2) as r2 from x where pop >= radius group by all having count(*) > 5) select radius, region, round_even(avg(rr),6) as rrmse_mean, round_even(stddev_pop(rr),6) as rrmse_sd, round_even(avg(r2),6) as r2_mean, round_even(stddev_pop(r2),6) as r2_sd from m group by all")
def o6(spark, d):
    """Mean and deviation of a long report (radius, region, period, metric, value), pivoted by metric."""
    x = frame(spark, d, "cv").withColumn("radius", F.explode(F.array(F.lit(0), F.lit(15), F.lit(30)))).where("pop >= radius")
    m = x.groupBy("radius", "region", "year", "mon").agg((F.sqrt(F.avg(F.pow(col("obs") - col("pred"), 2))) / F.avg("obs")).alias("rrmse"), N.r2(col("obs"), col("pred")).alias("r2"), F.count("*").alias("n")).where("n > 5")
    report = m.unpivot(["radius", "region", "year", "mon"], ["rrmse", "r2"], "metric", "value")
    return report.groupBy("radius", "region").pivot("metric", ["rrmse", "r2"]).agg(R(F.avg("value")).alias("mean"), R(F.stddev_pop("value")).alias("sd"))


@query("p10_attach_uncertainty", with_("grid") + ", u as (select ilat, ilon, year, avg(gchp)/100 as u from grid group by all) select g.ilat-2 as ilat, g.ilon-2 as ilon, g.year, g.mon, round_even(case when g.sat is not null then u.u end,6) as u from grid g left join u using (ilat, ilon, year) where g.ilat between 2 and 17 and g.ilon between 2 and 22")
def p10(spark, d):
    """The product's centre crop with its uncertainty, null where the product is."""
    g = frame(spark, d, "grid")
    u = g.groupBy("ilat", "ilon", "year").agg((F.avg("gchp") / 100).alias("u"))
    inside = g.where("ilat between 2 and 17 and ilon between 2 and 22")
    return inside.join(u, ["ilat", "ilon", "year"], "left").select((col("ilat") - 2).alias("ilat"), (col("ilon") - 2).alias("ilon"), "year", "mon", R(F.when(col("sat").isNotNull(), col("u"))).alias("u"))


_WRONG = _SEL + """, f as (select count(distinct feature) as c from hist), w as (select feature, min(case when run > 0.5 then c*m*m/(2*run-1) end) as wrong from (select r.*, f.c, avg(run) over (partition by step) as m from r, f) group by feature),
 o as (select feature, wrong, row_number() over (order by wrong nulls last, feature) as place from w), q as (select place, coalesce(wrong, 1e300)/nullif(lag(coalesce(wrong, 1e300)) over (order by place), 0) as ratio, wrong from o)
 select o.feature, round_even(o.wrong,6) as wrong, o.place, (select case when max(case when place = 1 then coalesce(wrong, 1e300) end) > 0.5 then 0 else arg_max(place, ratio*1e6-place*1e-6)-1 end from q) as oracle from o"""


@query("m8_expected_wrong", _WRONG)
def m8_wrong(spark, d):
    """Features by the expected number of wrong ones, and the size where it jumps most (0 if the first is over one half)."""
    return V.expected_wrong(selection(spark, d).select("step", "feature", "run"), 0.5).withColumn("wrong", R("wrong"))


@query("o4_piecewise", with_("cv") + ", c(x, y) as (values (10e0, 0.2e0), (20e0, 0.3e0), (40e0, 0.25e0)), l as (select regr_slope(y, x) as s from c), f as (select site, year, mon, split, count(*) as n, sum(cast(round_even((case when pop < 10 then 0.2e0 when pop < 20 then 0.2e0+(pop-10)/10*0.1e0 when pop < 40 then 0.3e0-(pop-20)/20*0.05e0 else 0.25e0+(pop-40)*l.s end)*1e9,0) as bigint)) as t from cv, l group by all) select site, year, mon, split, n, ((2*t+n)//(2*n))/1e9 as u from f")
def o4(spark, d):
    """Head clamp; the tail goes on with the last segment if it rises, else with the slope of a line through all points.
    Means are of whole billionths, in whole numbers: neither the order of a sum nor a tie can change them."""
    curve = spark.createDataFrame([(10.0, 0.2), (20.0, 0.3), (40.0, 0.25)], "x double, y double")
    f = V.piecewise(frame(spark, d, "cv"), "pop", curve, tail=True).groupBy("site", "year", "mon", "split").agg(F.count("*").alias("n"), F.sum(F.rint(col("fitted") * 1e9).cast("long")).alias("t"))
    return f.select("site", "year", "mon", "split", "n", (F.expr("(2 * t + n) div (2 * n)") / 1e9).alias("u"))
