"""Hourly feeds to quality-controlled monthly labels: completeness, combination, screening, grid snapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.units import days_in_month, nearest_index


def daily(df: DataFrame, site: str = "site", ts: str = "ts", value: str = "value", distinct_hours: bool = False) -> DataFrame:
    """n valid hours and mean by site and day."""
    n = F.countDistinct(F.hour(ts)) if distinct_hours else F.count(value)
    return df.groupBy(site, F.to_date(ts).alias("day")).agg(n.alias("n"), F.avg(value).alias("mean"))


def monthly(days: DataFrame, site: str = "site", coverage: float = 0.75, ceil: bool = False) -> DataFrame:
    """Mean of daily means by site and month, where enough days are valid."""
    m = days.groupBy(site, F.year("day").alias("year"), F.month("day").alias("mon")).agg(F.count("*").alias("valid_days"), F.avg("mean").alias("mean"))
    need = F.lit(coverage) * days_in_month(F.col("year"), F.col("mon"))
    return m.where(F.col("valid_days") >= (F.ceil(need) if ceil else need))


def hour_weighted(df: DataFrame, least_hours: int, least_days: float, site: str = "site", ts: str = "ts", value: str = "value") -> DataFrame:
    """Monthly mean of the hours of valid days, in months with enough of them: one aggregation by day, one by month."""
    days = df.groupBy(site, F.to_date(ts).alias("day")).agg(F.countDistinct(F.hour(ts)).alias("h"), F.sum(value).alias("s"), F.count(value).alias("c")).where(F.col("h") >= least_hours)
    m = days.groupBy(site, F.year("day").alias("year"), F.month("day").alias("mon")).agg(F.count("*").alias("d"), (F.sum("s") / F.sum("c")).alias("mean"))
    return m.where(F.col("d") >= F.lit(least_days) * days_in_month(F.col("year"), F.col("mon"))).select(site, "year", "mon", F.col("d").alias("valid_days"), "mean")


def site_year_policy(obs: DataFrame, months: int, years: int, keys: tuple[str, ...] = ("site", "lat", "lon")) -> DataFrame:
    """Rows of sites with at least ``years`` years of at least ``months`` months each."""
    per_year = obs.groupBy(*keys, "year").agg(F.countDistinct("mon").alias("m")).where(F.col("m") >= months)
    return obs.join(per_year.groupBy(*keys).agg(F.count("*").alias("y")).where(F.col("y") >= years), list(keys), "left_semi")


def exclusion_report(raw: DataFrame, kept: DataFrame) -> DataFrame:
    a = raw.groupBy("year").agg(F.countDistinct("site").alias("raw_sites"))
    b = kept.groupBy("year").agg(F.countDistinct("site").alias("kept_sites"))
    j = a.join(b, "year", "full").fillna(0)
    return j.withColumn("excluded_pct", F.bround(F.try_divide((F.col("raw_sites") - F.col("kept_sites")) * F.lit(100.0), F.col("raw_sites")), 6))


def standardise(df: DataFrame, names: dict[str, str], country: str | None = None) -> DataFrame:
    """Columns renamed to lat, lon, year, mon, no2, country; empty if a required one is missing."""
    target = ["lat", "lon", "year", "mon", "no2", "country"]
    by = {v: k for k, v in names.items()} | {c: c for c in df.columns if c in target}
    missing = [c for c in target if c not in by and not (c == "country" and country)]
    cols = [F.bround(F.col(by[c]).cast("double"), 4).alias(c) if c in ("lat", "lon") and c in by else (F.col(by[c]) if c in by else F.lit(country if c == "country" else None)).alias(c) for c in target]
    out = df.select(*cols)
    return out.where(F.lit(False)) if missing else out.dropna(subset=["lat", "lon"])


def priority_union(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary rows, and those secondary ones whose coordinates, rounded to 4 places, the primary does not have."""
    at = [F.bround("lat", 4).alias("_a"), F.bround("lon", 4).alias("_o")]
    rest = secondary.select("*", *at).join(primary.select(*at).distinct(), ["_a", "_o"], "left_anti")
    return primary.unionByName(rest.select(*secondary.columns))


def overlap_report(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    both = secondary.join(primary.select("lat", "lon").distinct(), ["lat", "lon"], "left_semi")
    return both.groupBy("country").agg(F.count("*").alias("records"), F.countDistinct("lat", "lon").alias("sites")).orderBy(F.desc("records"), "country")


def spikes(obs: DataFrame, ratio: float = 2.5, floor: float = 3.0) -> DataFrame:
    """Adds ``spike``: over ``ratio`` times the mean of the adjacent months, where that mean is over ``floor``.

    Months of several sites at one place follow each other by site, so that every run finds the same neighbours."""
    w = Window.partitionBy("lat", "lon").orderBy("t", *[c for c in ("site",) if c in obs.columns])
    near = lambda f, d: F.when(f("t").over(w) == F.col("t") + d, f("no2").over(w))
    x = obs.withColumn("t", F.col("year") * 12 + F.col("mon")).withColumns({"_p": near(F.lag, -1), "_n": near(F.lead, 1)})
    mean = F.when(F.col("_p").isNull(), F.col("_n")).when(F.col("_n").isNull(), F.col("_p")).otherwise((F.col("_p") + F.col("_n")) / 2)
    return x.withColumn("neighbours", mean).withColumn("spike", F.coalesce((F.col("no2") > ratio * F.col("neighbours")) & (F.col("neighbours") > floor), F.lit(False))).drop("_p", "_n", "t")


def snap(sites: DataFrame, lat0: float, lon0: float, step: float, n_lat: int, n_lon: int) -> DataFrame:
    return sites.withColumns({"ilat": nearest_index(F.col("lat"), lat0, step, n_lat), "ilon": nearest_index(F.col("lon"), lon0, step, n_lon)})


def colocated(snapped: DataFrame) -> DataFrame:
    return snapped.groupBy("ilat", "ilon").agg(F.sort_array(F.collect_list("site")).alias("sites"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))


def dense_panel(sites: DataFrame, months: DataFrame, obs: DataFrame, keys=("site",)) -> DataFrame:
    """Every site in every month; the months are a calendar of bounded length, so this is no join of two large sides."""
    return sites.crossJoin(F.broadcast(months)).join(obs, [*keys, "year", "mon"], "left")


def correct_interference(obs: Column, base: Column, an: Column, hno3: Column, pan: Column) -> Column:
    """The response factors of nitrates, nitric acid and PAN."""
    total = base + an + F.lit(0.15) * hno3 + F.lit(0.95) * pan
    return F.when(total == 0, obs).otherwise(obs * base / total)
