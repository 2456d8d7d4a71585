"""Spatial joins on a sphere: equi-joins on grid buckets, then true distances. No cross joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.units import EARTH_KM, haversine, unit_vector

KM_PER_DEGREE = 111.19492664455873
#: Edge of the finest cubes, and levels until one cube is wider than the Earth.
FINEST_KM, LEVELS = 0.25, 17


def _band(cell_km: float) -> float:
    return cell_km / KM_PER_DEGREE


def _large(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffles: Spark's estimates leave out that explode multiplies rows, and so an exploded side, or one
    that meets an exploded one, would be broadcast through the driver whatever its size."""
    return df.hint("merge")


def radius_join(left: DataFrame, right: DataFrame, km: float, suffix: str = "2", on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within ``km`` (and of equal columns ``on``). Both sides have site, lat, lon; the right side's other columns
    get ``suffix``.

    The right side is bucketed by latitude bands of ``km`` and longitude cells that are as wide in their band; the left
    side looks into the cells around it. Cells wrap at the date line; bands at the poles are one cell. ``site`` may be missing.
    Pairs grow with the square of the sites at one place: ``radius_counts`` and ``within`` meet places instead.
    """
    step = _band(max(km, FINEST_KM))
    r = right.select(*[F.col(c).alias(c if c in on else c + suffix) for c in right.columns])

    def cells(band):
        """Number of longitude cells of a band: their width is km at the band's edge nearer to a pole."""
        edge = F.least(F.greatest(F.abs(band * step), F.abs((band + 1) * step)), F.lit(89.9))
        return F.greatest(F.floor(F.lit(360.0 / step) * F.cos(F.radians(edge))), F.lit(1)).cast("long")

    band = lambda lat: F.floor(lat / F.lit(step))
    spot = lambda lon, n: F.least(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n), n - 1)
    r = r.withColumn("_b", band(F.col("lat" + suffix))).withColumn("_n", cells(F.col("_b"))).withColumn("_x", spot(F.col("lon" + suffix), F.col("_n"))).drop("_n")
    l = left.withColumn("_b", F.explode(F.array(*[band(F.col("lat")) + d for d in (-1, 0, 1)]))).withColumn("_n", cells(F.col("_b")))  # noqa: E741
    l = l.withColumn("_x", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(spot(F.col("lon"), F.col("_n")) + d, F.col("_n")))))).drop("_n")  # noqa: E741
    near = l.join(_large(r), ["_b", "_x", *on]).drop("_b", "_x")
    return near.withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("lat" + suffix), F.col("lon" + suffix))).where(F.col("km") <= km)


def _cubes(lat: Column, lon: Column) -> list[Column]:
    """Numbers, in x, y and z, of the finest cube around a place: the Earth is laid in cubes, so neither the poles nor the
    date line are special. Twice as large cubes have half the numbers."""
    return [F.floor((x * EARTH_KM + EARTH_KM) / FINEST_KM).cast("long") for x in unit_vector(lat, lon)]


def _key(level: Column, *at: Column) -> Column:
    """One number for a cube of a level."""
    key = level.cast("long")
    for x in at:
        key = key * (1 << 17) + x + 1
    return key


def _around(level: Column, *at: Column) -> Column:
    """Keys of a cube of a level and of its 26 neighbours."""
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    return F.array(*[_key(level, *[x + d for x, d in zip(at, step)]) for step in steps])


def knn_join(queries: DataFrame, sites: DataFrame, k: int, not_closer: float = 0.0, on: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest sites of each query point (among those of equal columns ``on``), by a pyramid of site counts.

    Places meet, not sites: all query points of a place have the same partners, and of the sites of a place only the k with
    the smallest numbers can be among the k nearest, so that many sites at one place make no more pairs.

    Cubes from ``FINEST_KM`` on double their edge from level to level, up to one around the Earth. The number of sites in a
    cube and its neighbours is known for each level, so every place finds the smallest level with k sites around it that
    count: the k nearest lie within two diagonals of that cube, and cubes four times as large, with their neighbours, hold all
    of that. One equi-join by cube then ends it, in dense areas over short ways and in empty ones over long ways.

    ``not_closer``: partners at or under this distance do not count (0 keeps only other places, less keeps all). Both
    sides have site, lat, lon; the right side's other columns get the suffix 2. Points with fewer than k partners get
    what there is.
    """
    names = [F.col(c).alias(c if c in on else c + "2") for c in sites.columns]
    at = ["_x", "_y", "_z"]
    of_level = lambda level: [F.call_function("shiftright", F.col(c), level) for c in at]
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    known = lambda df, lat, lon: df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    cubed = lambda df, lat, lon: df.withColumns(dict(zip(at, _cubes(F.col(lat), F.col(lon)))))
    place, place2 = [*on, "lat", "lon"], [*on, "lat2", "lon2"]
    right = known(sites.select(*names), "lat2", "lon2")
    first = right.withColumn("_i", F.row_number().over(Window.partitionBy(*place2).orderBy("site2"))).where(F.col("_i") <= k).drop("_i")
    s = cubed(right.groupBy(*place2).agg(F.count("*").alias("_c")), "lat2", "lon2").withColumn("_level", levels)
    s = s.withColumns(dict(zip(at, of_level(F.col("_level")))))
    counts = s.groupBy(*on, "_level", *at).agg(F.sum("_c").alias("_n"))
    pyramid = counts.select(*on, F.explode(_around(F.col("_level"), *map(F.col, at))).alias("_key"), "_n").groupBy(*on, "_key").agg(F.sum("_n").alias("_n"))
    q = cubed(known(queries.select(*place), "lat", "lon").distinct(), "lat", "lon")
    cells = q.select(*on, *at).distinct().withColumn("_level", levels).withColumn("_key", _key(F.col("_level"), *of_level(F.col("_level"))))
    lone = next(i for i in range(LEVELS) if FINEST_KM * 2**i >= not_closer)
    close = F.coalesce(F.max(F.when(F.col("_level") == lone, F.col("_n"))), F.lit(0)) if not_closer >= 0 else F.lit(0)
    seen = F.collect_list(F.struct("_level", "_n"))  # one of each level
    each = cells.join(_large(pyramid), [*on, "_key"], "left").groupBy(*on, *at).agg(seen.alias("_seen"), close.alias("_close"))
    enough = F.array_min(F.transform(F.filter("_seen", lambda z: z["_n"] - F.col("_close") >= k), lambda z: z["_level"]))
    each = each.select(*on, *at, F.coalesce(enough, F.lit(LEVELS)).alias("_enough"))
    wide = F.least(F.col("_enough") + 2, F.lit(LEVELS - 1))
    asked = q.join(_large(each), [*on, *at]).withColumn("_wide", wide).withColumn("_key", F.explode(_around(F.col("_wide"), *of_level(F.col("_wide")))))
    keyed = s.withColumn("_key", _key(F.col("_level"), *map(F.col, at))).select(*place2, "_key")
    chord = 2 * math.sqrt(3) * FINEST_KM * F.pow(F.lit(2.0), F.col("_enough")) / (2 * EARTH_KM)
    within = F.when(chord < 1, 2 * EARTH_KM * F.asin(F.least(chord, F.lit(1.0))) * (1 + 1e-9) + 1e-6).otherwise(F.lit(4 * EARTH_KM))
    met = asked.join(_large(keyed), [*on, "_key"]).withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    met = met.where((F.col("km") > not_closer) & (F.col("km") <= within)).select(*place, "lat2", "lon2", "km")
    nearest = met.withColumn("_r", F.rank().over(Window.partitionBy(*place).orderBy("km"))).where(F.col("_r") <= k).drop("_r")
    w = Window.partitionBy(*place).orderBy("km", "site2")
    found = nearest.join(_large(first), place2).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return queries.join(_large(found), place)


def _near(left: DataFrame, right: DataFrame, km: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Places of ``left`` (lat, lon, on) that a place of ``right`` is within ``km`` of."""
    place = ["lat", "lon", *on]
    return radius_join(left.select(*place).distinct(), right.select(*place).distinct(), km, on=on).select(*place).distinct()


def within(left: DataFrame, right: DataFrame, km: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``left`` that a row of ``right`` (of equal columns ``on``) is within ``km`` of."""
    return left.join(_large(_near(left, right, km, on)), ["lat", "lon", *on], "left_semi")


def radius_counts(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Rows of ``left`` with ``n``, the number of rows of ``right`` within ``km``, where there are any: places meet with their counts."""
    held = right.groupBy("lat", "lon").agg(F.count("*").alias("n"))
    n = radius_join(left.select("lat", "lon").distinct(), held, km).groupBy("lat", "lon").agg(F.sum("n2").alias("n"))
    return left.join(_large(n), ["lat", "lon"])


def buffered_train(test: DataFrame, train: DataFrame, km: float) -> DataFrame:
    """Training sites that no test site is within ``km`` of."""
    near = within(train, test, km).select("site").distinct()
    return train.join(_large(near), "site", "left_anti")
