"""Registered queries of the label stage: cleaning, reshaping, completeness, combination, grid labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.functions import units as U
from skyloom.operators import label as L
from skyloom.operators import metrics as N
from skyloom.plans.registry import query
from skyloom.sources.fixtures import frame, with_

R = lambda c, n=6: F.bround(c, n)
col = F.col


@query("flagship_seasonal_summary", with_("obs") + """, t as (select *, year*12+mon as t from obs), n as (select *,
 case when lag(t) over w = t-1 then lag(no2) over w end as p, case when lead(t) over w = t+1 then lead(no2) over w end as x from t window w as (partition by lat, lon order by t)),
 m as (select *, case when p is null then x when x is null then p else (p+x)/2 end as nb from n),
 k as (select * from m where no2 > 0 and no2 <= 300 and not coalesce(no2 > 2.5*nb and nb > 3, false))
 select year, case when mon in (12,1,2) then 'DJF' when mon in (3,4,5) then 'MAM' when mon in (6,7,8) then 'JJA' else 'SON' end as season, count(*) as months, count(distinct site) as sites, round_even(avg(no2),6) as mean_no2 from k group by all""")
def flagship(spark, d):
    x = L.spikes(frame(spark, d, "obs")).where(U.in_range(col("no2"), 0.0, None, closed=False) & (col("no2") <= 300) & ~col("spike"))
    return x.groupBy("year", U.season(col("mon")).alias("season")).agg(F.count("*").alias("months"), F.countDistinct("site").alias("sites"), R(F.avg("no2")).alias("mean_no2"))


@query("a8_era_routing", with_("obs") + "select site, year, mon, case when year*100+mon <= 199806 then 'OMI' else 'TROPOMI' end as source from obs")
def a8(spark, d):
    return frame(spark, d, "obs").select("site", "year", "mon", U.era(col("year"), col("mon"), 199806).alias("source"))


@query("a11_year_slice", with_("obs") + "select site, mon, round_even(no2,6) as no2 from obs where year = 1997")
def a11(spark, d):
    return frame(spark, d, "obs").where("year = 1997").select("site", "mon", R("no2").alias("no2"))


@query("b1_to_ppb", with_("hourly") + "select unit, count(*) as n, round_even(avg(case unit when 'ppb' then value when 'ppm' then value*1000 when 'µg/m³' then value*(24.45e0/46e0) end),6) as ppb from hourly group by unit")
def b1(spark, d):
    return frame(spark, d, "hourly").groupBy("unit").agg(F.count("*").alias("n"), R(F.avg(U.to_ppb(col("value"), col("unit")))).alias("ppb"))


@query("b2_range", with_("hourly") + "select site, count(*) as n from hourly where value > 0 and value < 50 group by site")
def b2(spark, d):
    return frame(spark, d, "hourly").where(U.in_range(col("value"), 0.0, 50.0, closed=False)).groupBy("site").agg(F.count("*").alias("n"))


@query("b3_sentinel_null", "select c_custkey, try_cast(nullif(c_mktsegment, 'BUILDING') as double) as x, nullif(c_acctbal, -999) as v from customer")
def b3(spark, d):
    return frame(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).try_cast("double").alias("x"), F.nullif("c_acctbal", F.lit(-999.0)).alias("v"))


@query("b7_dms", with_("sites") + "select site, round_even(floor(lat) + 30/60e0 + 15/3600e0, 6) as x from sites")
def b7(spark, d):
    return frame(spark, d, "sites").select("site", R(U.dms(F.floor("lat"), F.lit(30), F.lit(15))).alias("x"))


@query("b9_coordinates", with_("sites") + "select site, round_even(lat,4) as lat, round_even(lon,4) as lon from sites where lat is not null and lon is not null")
def b9(spark, d):
    return frame(spark, d, "sites").dropna(subset=["lat", "lon"]).select("site", R("lat", 4).alias("lat"), R("lon", 4).alias("lon"))


@query("b10_unknown_fill", "select c_custkey, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'unknown') as kind, 'unknown' as owner from customer")
def b10(spark, d):
    x = frame(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("kind"))
    return x.fillna({"kind": "unknown"}).withColumn("owner", F.lit("unknown"))


@query("b11_sensor_type", "select s_suppkey, case when s_suppkey%2=0 and s_suppkey%3<>0 then 'low_cost' when s_suppkey%3=0 and s_suppkey%2<>0 then 'stationary' else 'unknown' end as kind from supplier")
def b11(spark, d):
    return frame(spark, d, "supplier").select("s_suppkey", U.sensor_type(col("s_suppkey") % 2 == 0, col("s_suppkey") % 3 == 0).alias("kind"))


@query("b12_label_map", "select n_nationkey, case n_name when 'NATION_0' then 'Türkiye' else n_name end as name from nation")
def b12(spark, d):
    return frame(spark, d, "nation").select("n_nationkey", F.when(col("n_name") == "NATION_0", "Türkiye").otherwise(col("n_name")).alias("name"))


@query("b13_days_in_month", with_("obs") + "select distinct year, mon, day(last_day(make_date(cast(year as integer), cast(mon as integer), 1))) as days from obs")
def b13(spark, d):
    return frame(spark, d, "obs").select("year", "mon", U.days_in_month(col("year"), col("mon")).alias("days")).distinct()


@query("b16_log_density", "select p_partkey, round_even(ln(1+p_retailprice),6) as x from part")
def b16(spark, d):
    return frame(spark, d, "part").select("p_partkey", R(F.log1p("p_retailprice")).alias("x"))


@query("b17_unit_vector", with_("sites") + "select site, round_even(cos(radians(lat))*cos(radians(lon)),6) as x, round_even(cos(radians(lat))*sin(radians(lon)),6) as y, round_even(sin(radians(lat)),6) as z from sites")
def b17(spark, d):
    x, y, z = U.unit_vector(col("lat"), col("lon"))
    return frame(spark, d, "sites").select("site", R(x).alias("x"), R(y).alias("y"), R(z).alias("z"))


_HAV = "2*6371e0*asin(sqrt(least(pow(sin(radians({b}.lat-{a}.lat)/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2),1.0)))"


@query("b18_haversine", with_("sites") + f", n as (select *, lead(lat) over (order by site) as la, lead(lon) over (order by site) as lo from sites), p as (select site, lat, lon, la, lo from n where la is not null) select a.site, round_even({_HAV.format(a='a', b='b')},3) as km from p a join (select site, la as lat, lo as lon from p) b using (site)")
def b18(spark, d):
    s = frame(spark, d, "sites").select("site", "lat", "lon")
    nxt = s.select((col("site") - 1).alias("site"), col("lat").alias("la"), col("lon").alias("lo"))
    return s.join(nxt, "site").select("site", R(U.haversine(col("lat"), col("lon"), col("la"), col("lo")), 3).alias("km"))


@query("b19_slug", "select n_nationkey, regexp_replace(lower(trim(n_name)), '[^a-z0-9]+', '_', 'g') as slug from nation where n_nationkey not in (1, 2)")
def b19(spark, d):
    return frame(spark, d, "nation").where(~col("n_nationkey").isin(1, 2)).select("n_nationkey", U.slug(col("n_name")).alias("slug"))


_HEADS = "concat(case when c_custkey % 3 = 0 then 'Report' else concat('Station Name: ', c_name, ', region ', c_nationkey) end, chr(10), 'Date Time,', case when c_custkey % 4 = 0 then 'SO2' else 'SO2,NO2' end, chr(10), ',ug/m3', case when c_custkey % 4 = 0 then '' when c_custkey % 2 = 0 then ',ppb' else ', ppm ' end)"


@query("b20_pattern_metadata", f"with h as (select c_custkey, {_HEADS} as h from customer) select c_custkey, coalesce(nullif(trim(regexp_extract(h, 'Station Name:\\s*([^,\\n]+)', 1)), ''), concat('site_', c_custkey, '.v2')) as station, case when c_custkey % 4 = 0 then null when c_custkey % 2 = 0 then 'ppb' else 'ppm' end as unit from h")
def b20(spark, d):
    """Station from a header line, else from the file's name; unit from the cell under the variable's."""
    k = col("c_custkey")
    name = F.when(k % 3 == 0, "Report").otherwise(F.concat(F.lit("Station Name: "), "c_name", F.lit(", region "), col("c_nationkey").cast("string")))
    columns = F.when(k % 4 == 0, "Date Time,SO2").otherwise("Date Time,SO2,NO2")
    units = F.concat(F.lit(",ug/m3"), F.when(k % 4 == 0, "").when(k % 2 == 0, ",ppb").otherwise(", ppm "))
    x = frame(spark, d, "customer").select("c_custkey", F.concat_ws("\n", name, columns, units).alias("h"), F.concat(F.lit("/data/2020/site_"), k.cast("string"), F.lit(".v2.xlsx")).alias("path"))
    return x.select("c_custkey", U.station_name(col("h"), col("path")).alias("station"), U.header_unit(col("h"), "NO2").alias("unit"))


@query("c2_melt", "select p_partkey, 'p_size' as name, cast(p_size as double) as v from part union all select p_partkey, 'p_retailprice', p_retailprice from part")
def c2(spark, d):
    return frame(spark, d, "part").select("p_partkey", col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot("p_partkey", ["p_size", "p_retailprice"], "name", "v")


@query("c4_standardise", with_("obs2") + "select round_even(lat,4) as lat, round_even(lon,4) as lon, year, mon, round_even(no2,6) as no2, 'X' as country from obs2")
def c4(spark, d):
    x = frame(spark, d, "obs2").select(col("lat").alias("Latitude"), col("lon").alias("Longitude"), "year", "mon", col("no2").alias("value"))
    return L.standardise(x, {"Latitude": "lat", "Longitude": "lon", "value": "no2"}, "X").withColumn("no2", R("no2"))


@query("c6_flat_index", with_("obs") + "select site, year, mon, ((year-1995)*12+(mon-1))*10000+site as i from obs")
def c6(spark, d):
    return frame(spark, d, "obs").select("site", "year", "mon", U.flat_index(col("year"), col("mon"), col("site"), 10000, 1995).alias("i"))


@query("d1_daily", with_("hourly") + "select site, day, count(value) as n, round_even(avg(value),6) as mean from hourly group by site, day")
def d1(spark, d):
    return L.daily(frame(spark, d, "hourly")).withColumn("mean", R("mean"))


@query("d2_valid_days", with_("hourly") + "select site, day, count(distinct hour(ts)) as n, round_even(avg(value),6) as mean from hourly group by site, day having count(distinct hour(ts)) >= 18")
def d2(spark, d):
    return L.daily(frame(spark, d, "hourly"), distinct_hours=True).where("n >= 18").withColumn("mean", R("mean"))


_D3 = with_("hourly") + ", dd as (select site, day, count(distinct hour(ts)) as n, avg(value) as mean from hourly group by site, day having count(distinct hour(ts)) >= {h}) select site, year(day) as year, month(day) as mon, count(*) as valid_days, round_even(avg(mean),6) as mean from dd group by site, year(day), month(day) having count(*) >= {c} * day(last_day(min(day)))"


@query("d3_monthly_coverage", _D3.format(h=18, c=0.5))
def d3(spark, d):
    return L.monthly(L.daily(frame(spark, d, "hourly"), distinct_hours=True).where("n >= 18"), coverage=0.5).withColumn("mean", R("mean"))


@query("d4_hour_weighted", with_("hourly") + ", dd as (select site, day from hourly group by site, day having count(distinct hour(ts)) >= 12), h as (select hourly.* from hourly join dd using (site, day)) select site, year(day) as year, month(day) as mon, count(distinct day) as valid_days, round_even(avg(value),6) as mean from h group by site, year(day), month(day) having count(distinct day) >= 0.3 * day(last_day(min(day)))")
def d4(spark, d):
    return L.hour_weighted(frame(spark, d, "hourly"), 12, 0.3).withColumn("mean", R("mean"))


@query("d5_reduced_coverage", _D3.format(h=12, c=0.3))
def d5(spark, d):
    return L.monthly(L.daily(frame(spark, d, "hourly"), distinct_hours=True).where("n >= 12"), coverage=0.3).withColumn("mean", R("mean"))


_D6 = with_("obs") + ", y as (select site, year from obs group by site, year having count(distinct mon) >= 6), k as (select site from y group by site having count(*) >= 4) "


@query("d6_site_years", _D6 + "select site, year, mon from obs where site in (select site from k)")
def d6(spark, d):
    return L.site_year_policy(frame(spark, d, "obs"), 6, 4).select("site", "year", "mon")


@query("d7_exclusion_report", _D6 + ", kept as (select * from obs where site in (select site from k)), a as (select year, count(distinct site) as raw_sites from obs group by year), b as (select year, count(distinct site) as kept_sites from kept group by year) select year, coalesce(raw_sites,0) as raw_sites, coalesce(kept_sites,0) as kept_sites, round_even((coalesce(raw_sites,0)-coalesce(kept_sites,0))*100e0/nullif(raw_sites,0),6) as excluded_pct from a full join b using (year)")
def d7(spark, d):
    o = frame(spark, d, "obs")
    return L.exclusion_report(o, L.site_year_policy(o, 6, 4))


@query("d8_coverage_by_year", with_("obs") + ", c as (select site, year, count(*)/12e0 as cov from obs group by site, year) select year, round_even(min(cov),6) as lo, round_even(avg(cov),6) as mean, round_even(max(cov),6) as hi from c group by year")
def d8(spark, d):
    c = frame(spark, d, "obs").groupBy("site", "year").agg((F.count("*") / F.lit(12.0)).alias("cov"))
    return c.groupBy("year").agg(R(F.min("cov")).alias("lo"), R(F.avg("cov")).alias("mean"), R(F.max("cov")).alias("hi"))


@query("d9_annual_mean", with_("obs") + "select year, round_even(avg(no2),6) as mean from obs group by year")
def d9(spark, d):
    return frame(spark, d, "obs").groupBy("year").agg(R(F.avg("no2")).alias("mean"))


@query("d10_site_tracker", with_("obs") + ", g as (select site, bool_or(no2 > 60) as kept from obs group by site) select count(*) as all_sites, count(*) filter (where kept) as kept, count(*) filter (where not kept) as dropped from g")
def d10(spark, d):
    g = frame(spark, d, "obs").groupBy("site").agg(F.bool_or(col("no2") > 60).alias("kept"))
    return g.agg(F.count("*").alias("all_sites"), F.count_if("kept").alias("kept"), F.count_if(~col("kept")).alias("dropped"))


@query("e3_overlap_report", with_("obs", "obs2") + "select country, count(*) as records, count(distinct (lat, lon)) as sites from obs2 where exists (select 1 from obs where obs.lat=obs2.lat and obs.lon=obs2.lon) group by country")
def e3(spark, d):
    return L.overlap_report(frame(spark, d, "obs"), frame(spark, d, "obs2"))


@query("e4_removal_counts", with_("obs2") + "select count(*) filter (where no2 <= 0) as nonpositive, count(*) filter (where no2 > 500) as over_500, count(*) filter (where no2 > 300) as over_300, count(*) filter (where no2 > 0 and no2 <= 300) as kept from obs2")
def e4(spark, d):
    n = col("no2")
    return frame(spark, d, "obs2").agg(F.count_if(n <= 0).alias("nonpositive"), F.count_if(n > 500).alias("over_500"), F.count_if(n > 300).alias("over_300"), F.count_if((n > 0) & (n <= 300)).alias("kept"))


@query("e6_spikes", with_("obs") + """, t as (select *, year*12+mon as t from obs), n as (select *, case when lag(t) over w = t-1 then lag(no2) over w end as p, case when lead(t) over w = t+1 then lead(no2) over w end as x from t window w as (partition by lat, lon order by t)), m as (select *, case when p is null then x when x is null then p else (p+x)/2 end as nb from n)
 select site, year, mon, round_even(no2,6) as no2, round_even(nb,6) as neighbours from m where no2 > 1.5*nb and nb > 3""")
def e6(spark, d):
    return L.spikes(frame(spark, d, "obs"), 1.5).where("spike").select("site", "year", "mon", R("no2").alias("no2"), R("neighbours").alias("neighbours"))


@query("e7_retained_high", with_("obs2") + "select count(*) as n from obs2 where no2 > 150 and no2 <= 300")
def e7(spark, d):
    return frame(spark, d, "obs2").agg(F.count_if((col("no2") > 150) & (col("no2") <= 300)).alias("n"))


@query("e8_countries", with_("obs") + "select distinct country from obs")
def e8(spark, d):
    return frame(spark, d, "obs").select("country").distinct().orderBy("country")


@query("e9_site_type_exclusion", with_("sites", "obs2") + "select o.site, o.year, o.mon from obs2 o where not exists (select 1 from sites s where s.kind in ('BUILDING', 'MACHINERY') and round_even(s.lat,4)=round_even(o.lat,4) and round_even(s.lon,4)=round_even(o.lon,4))")
def e9(spark, d):
    s = frame(spark, d, "sites").where(col("kind").isin("BUILDING", "MACHINERY")).select(R("lat", 4).alias("a"), R("lon", 4).alias("b")).distinct()
    o = frame(spark, d, "obs2")
    return o.join(s, (R(o.lat, 4) == s.a) & (R(o.lon, 4) == s.b), "left_anti").select("site", "year", "mon")


@query("e10_excluded_sites", with_("sites", "obs2") + "select lat, lon, min(site) as site from obs2 o where exists (select 1 from sites s where s.kind = 'BUILDING' and s.lat=o.lat and s.lon=o.lon) group by lat, lon")
def e10(spark, d):
    s = frame(spark, d, "sites").where("kind = 'BUILDING'").select("lat", "lon")
    return frame(spark, d, "obs2").join(s, ["lat", "lon"], "left_semi").groupBy("lat", "lon").agg(F.min("site").alias("site"))


@query("f1_site_ids", with_("obs") + ", s as (select distinct lat, lon from obs) select lat, lon, dense_rank() over (order by lat, lon) as id from s")
def f1(spark, d):
    """Ids in coordinate order: numbered inside ranges of latitude, whose counts (one row a degree) give the offsets."""
    s = frame(spark, d, "obs").select("lat", "lon").distinct().withColumn("b", F.floor("lat"))
    n = s.groupBy("b").agg(F.count("*").alias("n"))
    before = n.select("b", (F.sum("n").over(Window.orderBy("b")) - col("n")).alias("before"))
    return s.join(F.broadcast(before), "b").select("lat", "lon", (col("before") + F.row_number().over(Window.partitionBy("b").orderBy("lat", "lon"))).alias("id"))


_SNAP = "cast(least(greatest(round_even((lat-30e0)/0.5e0,0),0),59) as integer) as ilat, cast(least(greatest(round_even((lon+10e0)/0.5e0,0),0),79) as integer) as ilon"


@query("f2_snap", with_("sites") + f"select site, {_SNAP} from sites")
def f2(spark, d):
    return L.snap(frame(spark, d, "sites"), 30.0, -10.0, 0.5, 60, 80).select("site", "ilat", "ilon")


@query("f3_colocated", with_("sites") + f", s as (select *, {_SNAP} from sites) select ilat, ilon, array_to_string(list_sort(list(site)), ',') as sites, round_even(avg(lat),6) as lat, round_even(avg(lon),6) as lon, count(*) as n from s group by ilat, ilon")
def f3(spark, d):
    x = L.colocated(L.snap(frame(spark, d, "sites"), 30.0, -10.0, 0.5, 60, 80))
    return x.select("ilat", "ilon", F.array_join(col("sites").cast("array<string>"), ",").alias("sites"), R("lat").alias("lat"), R("lon").alias("lon"), "n")


@query("f4_cell_month", with_("obs") + f", s as (select *, {_SNAP} from obs) select ilat, ilon, year, mon, round_even(avg(no2),6) as no2 from s group by ilat, ilon, year, mon")
def f4(spark, d):
    return L.snap(frame(spark, d, "obs"), 30.0, -10.0, 0.5, 60, 80).groupBy("ilat", "ilon", "year", "mon").agg(R(F.avg("no2")).alias("no2"))


@query("f6_interference", "select l_orderkey, l_linenumber, round_even(case when l_quantity+l_tax+0.15e0*l_discount+0.95e0*l_tax=0 then l_extendedprice else l_extendedprice*l_quantity/(l_quantity+l_tax+0.15e0*l_discount+0.95e0*l_tax) end,4) as v from lineitem")
def f6(spark, d):
    x = L.correct_interference(col("l_extendedprice"), col("l_quantity"), col("l_tax"), col("l_discount"), col("l_tax"))
    return frame(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R(x, 4).alias("v"))


@query("f7_bias", with_("grid") + "select ilat, ilon, year, mon, round_even(sat-gchp,6) as bias from grid")
def f7(spark, d):
    return frame(spark, d, "grid").select("ilat", "ilon", "year", "mon", R(col("sat") - col("gchp")).alias("bias"))


@query("f8_coverage", with_("grid") + "select year, count(sat) as valid, round_even(count(sat)*100e0/count(*),6) as pct from grid group by year")
def f8(spark, d):
    return frame(spark, d, "grid").groupBy("year").agg(F.count("sat").alias("valid"), R(F.count("sat") * 100.0 / F.count("*")).alias("pct"))


@query("f9_metadata_join", with_("sites", "obs2") + "select o.site, o.year, o.mon, s.kind from obs2 o join sites s using (site) where s.lat is not null")
def f9(spark, d):
    s = frame(spark, d, "sites").select("site", "kind", col("lat").alias("slat"))
    return frame(spark, d, "obs2").join(s, "site", "left").dropna(subset=["slat"]).select("site", "year", "mon", "kind")


@query("b8_timestamp", "select event_id, case when event_id % 3 = 2 then null else year(ts) end as y, case when event_id % 3 = 2 then null else month(ts) end as m, case when event_id % 3 = 2 then null else day(ts) end as dd, case when event_id % 3 = 2 then null when event_id % 3 = 1 then 0 else hour(ts) end as h from events")
def b8(spark, d):
    """Slashes and fractions, a leading HH:MM before a date, and text that is no date."""
    e, k = frame(spark, d, "events"), col("event_id") % 3
    forms = F.when(k == 0, F.concat(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"), F.lit(".123"))).when(k == 1, F.concat(F.date_format("ts", "HH:mm"), F.lit(" "), F.date_format("ts", "yyyy-MM-dd"))).otherwise(F.lit("no date"))
    t = U.any_timestamp(forms)
    again = U.from_parts(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t))
    return e.select("event_id", F.year(again).alias("y"), F.month(again).alias("m"), F.dayofmonth(again).alias("dd"), F.hour(again).alias("h"))


@query("b15_solar_window", with_("sites", "hourly") + ", l as (select h.site, h.ts + to_hours(cast(round_even(s.lon/15e0, 0) as bigint)) as t from hourly h join sites s using (site)) select site, cast(t as date) as day, count(*) as n from l where hour(t) in (13,14,15) group by all")
def b15(spark, d):
    """Rows in the overpass window by local date, which may be the next or the previous day."""
    j = frame(spark, d, "hourly").join(frame(spark, d, "sites").select("site", "lon"), "site")
    local = j.select("site", (col("ts") + F.make_dt_interval(hours=U.solar_offset(col("lon")).cast("int"))).alias("t"))
    return local.where(F.hour("t").isin(13, 14, 15)).groupBy("site", F.to_date("t").alias("day")).agg(F.count("*").alias("n"))


@query("c1_wide_hours", with_("obs") + "select site, year, count(no2) as n, round_even(avg(no2),6) as mean from obs group by site, year")
def c1(spark, d):
    names = [str(k) for k in range(1, 13)]
    wide = frame(spark, d, "obs").groupBy("site", "year").pivot("mon", list(range(1, 13))).agg(F.first("no2"))
    a = F.filter(F.array(*names), lambda x: x.isNotNull())
    return wide.select("site", "year", F.size(a).cast("long").alias("n"), R(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))).alias("mean")).where("n > 0")


@query("c5_dense_panel", with_("obs") + ", s as (select distinct site from obs), m as (select distinct year, mon from obs) select s.site, m.year, m.mon, round_even(o.no2,6) as no2 from s cross join m left join obs o on o.site=s.site and o.year=m.year and o.mon=m.mon")
def c5(spark, d):
    o = frame(spark, d, "obs")
    return L.dense_panel(o.select("site").distinct(), o.select("year", "mon").distinct(), o.select("site", "year", "mon", R("no2").alias("no2")))


@query("c7_channel_pivot", with_("obs") + "select site, year, " + ", ".join(f"round_even(max(case when mon={k} then no2 end),6) as m{k}" for k in range(1, 13)) + " from obs group by site, year")
def c7(spark, d):
    p = frame(spark, d, "obs").groupBy("site", "year").pivot("mon", list(range(1, 13))).agg(F.first("no2"))
    return p.select("site", "year", *[R(str(k)).alias(f"m{k}") for k in range(1, 13)])


@query("e2_priority_dedup", with_("obs", "obs2") + "select site, lat, lon, year, mon, round_even(no2,6) as no2, country from obs union all select site, lat, lon, year, mon, round_even(no2,6), country from obs2 where not exists (select 1 from obs where round_even(obs.lat,4)=round_even(obs2.lat,4) and round_even(obs.lon,4)=round_even(obs2.lon,4))")
def e2(spark, d):
    return L.priority_union(frame(spark, d, "obs"), frame(spark, d, "obs2")).withColumn("no2", R("no2"))


@query("e5_outlier_report", with_("obs2") + ", t as (select quantile_cont(no2, 0.9999) as p from obs2), c as (select country, count(*) as n from obs2, t where no2 > t.p group by country) select o.country, o.site, o.year, o.mon, round_even(o.no2,6) as no2, round_even(t.p,6) as threshold, c.n, row_number() over (order by o.no2 desc, o.site, o.year, o.mon) as place from obs2 o, t, c where o.no2 > t.p and c.country = o.country")
def e5(spark, d):
    """Rows over the exact P99.99 in order, with their country's count."""
    o = frame(spark, d, "obs2")
    t = N.quantiles(o, [], "no2", 0.9999).select(col("q").alias("p"))
    over = o.join(F.broadcast(t), col("no2") > col("p"))
    c = over.groupBy("country").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("no2"), "site", "year", "mon")  # one row in ten thousand
    return over.withColumn("place", F.row_number().over(w)).join(c, "country").select("country", "site", "year", "mon", R("no2").alias("no2"), R("p").alias("threshold"), "n", "place")


@query("f5_raster_lookup", with_("sites", "grid") + "select s.site, g.year, g.mon, round_even(g.gchp,6) as v from sites s join grid g on g.ilat = s.site % 20 and g.ilon = s.site % 25")
def f5(spark, d):
    s = frame(spark, d, "sites").select("site", (col("site") % 20).alias("ilat"), (col("site") % 25).alias("ilon"))
    return s.join(frame(spark, d, "grid"), ["ilat", "ilon"]).select("site", "year", "mon", R("gchp").alias("v"))
