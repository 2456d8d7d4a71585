"""Gridded fields as rows keyed by cell index: algebra, regridding, focal windows, gap filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.units import haversine

CELL = ("ilat", "ilon")


def month_then_year(df: DataFrame, value: str = "v", keys: tuple[str, ...] = CELL) -> DataFrame:
    """Annual mean of monthly means of what is not null, and the months that had any."""
    m = df.groupBy(*keys, "year", "mon").agg(F.avg(value).alias("m"))
    return m.groupBy(*keys, "year").agg(F.avg("m").alias("mean"), F.count("m").alias("months"))


def regrid(src: DataFrame, weights: DataFrame) -> DataFrame:
    """Sparse weights: dst_id, sum of w * v over the sources."""
    return src.join(weights, "src_id").groupBy("dst_id").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def upsample(coarse: DataFrame, factor: int) -> DataFrame:
    """Nearest neighbour: each cell becomes factor x factor cells."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    fine = coarse.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    return fine.withColumns({"ilat": F.col("ilat") * factor + F.col("dy"), "ilon": F.col("ilon") * factor + F.col("dx")}).drop("dy", "dx")


def _corners(targets: DataFrame) -> DataFrame:
    """A row per corner around (fy, fx) of each target row, which ``_row`` tells apart from equal ones."""
    y, x = F.floor("fy"), F.floor("fx")
    corner = [F.struct((y + a).alias("ilat"), (x + b).alias("ilon"), ((1 - F.abs(F.col("fy") - y - a)) * (1 - F.abs(F.col("fx") - x - b))).alias("w")) for a in (0, 1) for b in (0, 1)]
    rows = targets.select(F.monotonically_increasing_id().alias("_row"), F.struct(*targets.columns).alias("_t"), F.array(*corner).alias("_c"))
    return rows.select("_row", "_t", F.explode("_c").alias("_c")).select("_row", "_t", "_c.*")


def bilinear(coarse: DataFrame, targets: DataFrame, value: str = "v") -> DataFrame:
    """Values at fractional indices (fy, fx) of each target row, from the four corners; null if a corner is missing."""
    j = _corners(targets).where("w > 0").join(coarse.select(*CELL, value), list(CELL), "left")
    j = j.groupBy("_row").agg(F.first("_t").alias("_t"), F.sum(F.col("w") * F.col(value)).alias("s"), F.count(value).alias("c"), F.count("*").alias("n"))
    return j.select("_t.*", F.when(F.col("c") == F.col("n"), F.col("s")).alias(value))


def boxcar(df: DataFrame, before: int, after: int, value: str = "v", part: tuple[str, ...] = ()) -> DataFrame:
    """Focal mean of what is not null, separable: along the row, then along the column. Adds ``focal``.

    Beyond the border its cells repeat (edge mode nearest), so they count once more for each step outside. Needs a row for
    every cell of the extent (null where there is no value), as both passes look along rows.
    """

    def summed(x: Column, keys: tuple[str, ...], at: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(at)
        ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        low, high = F.first(at).over(ends), F.last(at).over(ends)
        outside = lambda n, end: F.greatest(n, F.lit(0)) * F.coalesce(end, F.lit(0.0))
        inside = F.coalesce(F.sum(x).over(w.rangeBetween(-before, after)), F.lit(0.0))
        return inside + outside(low - F.col(at) + before, F.first(x).over(ends)) + outside(F.col(at) + after - high, F.last(x).over(ends))

    row, column = (*part, "ilat"), (*part, "ilon")
    x = df.withColumns({"_s": summed(F.col(value).cast("double"), row, "ilon"), "_c": summed(F.col(value).isNotNull().cast("double"), row, "ilon")})
    return x.withColumn("focal", F.try_divide(summed(F.col("_s"), column, "ilat"), summed(F.col("_c"), column, "ilat"))).drop("_s", "_c")


def focal_min(df: DataFrame, before: int, after: int, value: str = "v", part: tuple[str, ...] = ()) -> DataFrame:
    row = Window.partitionBy(*part, "ilat").orderBy("ilon").rangeBetween(-before, after)
    col = Window.partitionBy(*part, "ilon").orderBy("ilat").rangeBetween(-before, after)
    return df.withColumn("_m", F.min(F.coalesce(value, F.lit(-1.0))).over(row)).withColumn("focal_min", F.min("_m").over(col)).drop("_m")


def ratio_where_positive(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def mosaic(parts: list[DataFrame]) -> DataFrame:
    """Regional grids on one global index; overlaps add up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*CELL).agg(F.sum("v").alias("v"))


def interpolate_years(df: DataFrame, year: int, left: int, right: int) -> DataFrame:
    """Linear in time between two bracketing years."""
    w = (year - left) / (right - left)
    a, b = df.where(F.col("year") == left).select(*CELL, F.col("v").alias("a")), df.where(F.col("year") == right).select(*CELL, F.col("v").alias("b"))
    return a.join(b, list(CELL)).select(*CELL, F.lit(year).alias("year"), (F.col("a") * (1 - w) + F.col("b") * w).alias("v"))


def partial_columns(vmr: Column, airden: Column, boxh: Column) -> Column:
    """Column amount of each level of the arrays. 28.97 g/mol, Avogadro."""
    return F.zip_with(F.zip_with(vmr, airden, lambda a, b: a * b), boxh, lambda x, h: x * h * F.lit(1e3 / 28.97 * 1e-4 * 6.023e23))


def column_amount(vmr: Column, airden: Column, boxh: Column, pressure: Column | None = None, tropopause: Column | None = None) -> Column:
    """Vertical column of level arrays (all levels, or those at or below the tropopause)."""
    part = partial_columns(vmr, airden, boxh)
    if pressure is not None:
        part = F.zip_with(part, pressure, lambda x, p: F.when(p >= tropopause, x).otherwise(0.0))
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x)


def tiered_fill(value: Column, model: Column, tiers: list[tuple[Column, Column]], last: Column, eta: Column | None = None) -> tuple[Column, Column]:
    """The value, else model / reference model * reference satellite of the first tier that has them, else ``last``;
    and the label of the tier: 0 for the value itself, len(tiers) + 1 for the last resort. With ``eta``, the surface over
    the column, all guesses are columns brought to the surface; the value is there already."""
    guesses = [F.when(m > 0, model / m) * s for m, s in tiers]
    if eta is not None:
        guesses, last = [g * eta for g in guesses], last * eta
    label = F.when(value.isNotNull(), 0)
    for k, g in enumerate(guesses, 1):
        label = label.when(g.isNotNull(), k)
    return F.coalesce(value, *guesses, last), label.otherwise(F.when(last.isNotNull(), len(tiers) + 1))


def bilinear_zero(coarse: DataFrame, targets: DataFrame, value: str = "v") -> DataFrame:
    """Bilinear values at (fy, fx) of each target row where a missing corner counts as 0 and weights stay in 0..1."""
    w = F.least(F.greatest("w", F.lit(0.0)), F.lit(1.0))
    j = _corners(targets).join(coarse.select(*CELL, value), list(CELL), "left")
    return j.groupBy("_row").agg(F.first("_t").alias("_t"), F.sum(w * F.coalesce(value, F.lit(0.0))).alias(value)).select("_t.*", value)


def fine_ratio(df: DataFrame, before: int, after: int, value: str = "v") -> DataFrame:
    """Cells with ``r``: value over its focal mean where the whole window is positive, else 1."""
    both = focal_min(boxcar(df, before, after, value), before, after, value)
    return both.select(*CELL, F.when(F.col("focal_min") > 0, F.col(value) / F.col("focal")).otherwise(1.0).alias("r"))


def mixed_year(sums: DataFrame, fine: DataFrame, before: int, after: int, months: int = 12) -> DataFrame:
    """Annual mean ``v`` of a year whose early months are coarse: the fine ratio times their focal mean, plus late ones.

    ``sums``: sums ``early`` and ``late`` of every cell (null counts as 0); ``fine``: the cells' ratio ``r`` (else 1).
    """
    smooth = boxcar(sums.withColumn("early", F.coalesce("early", F.lit(0.0))), before, after, "early").join(fine, list(CELL), "left")
    return smooth.select(*CELL, ((F.coalesce("r", F.lit(1.0)) * F.col("focal") + F.coalesce("late", F.lit(0.0))) / months).alias("v"))


def backcast(annual: DataFrame, base: DataFrame, months: DataFrame, floor: float = 0.01, most: float = 10.0) -> DataFrame:
    """Months ``m`` of the base year, scaled by each other year's annual ``v`` over the base's ``r``, held in 0..``most``;
    cells whose base is not over ``floor`` have no ratio and no row."""
    ratio = F.least(F.greatest(F.col("v") / F.col("r"), F.lit(0.0)), F.lit(most))
    scaled = annual.join(base.where(F.col("r") > floor), list(CELL)).select(*CELL, "year", ratio.alias("k"))
    return months.join(scaled, list(CELL)).select(*CELL, "year", "mon", (F.col("k") * F.col("m")).alias("v"))


def inside_rings(cells: DataFrame, edges: DataFrame, lat0: float, step: float) -> DataFrame:
    """Cells (site, ilat, lon) with ``land``: 1 if inside any ring, by scan lines through the rows of the grid.

    ``edges``: ring, y1, x1, y2, x2. A cell is inside a ring if an odd number of its sides cross the cell's row east of it. An edge becomes one crossing for each grid row
    (``lat0 + i * step``) between its ends; the crossings of a ring in a row, in their order, open and close it by turns.
    Along each row a running sum of opened rings meets the cells, so the work is rows x (cells + crossings), not their product.
    """
    at = lambda y: F.floor((y - lat0) / step)
    rows = edges.withColumn("ilat", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")) + 1)))
    lat = lat0 + F.col("ilat") * step
    crossed = rows.where((F.col("y1") > lat) != (F.col("y2") > lat))
    crossed = crossed.select("ring", "ilat", (F.col("x1") + (lat - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    turn = F.row_number().over(Window.partitionBy("ring", "ilat").orderBy(F.desc("x")))
    turns = crossed.select("ilat", "x", F.when(turn % 2 == 0, 1).otherwise(-1).alias("d"))
    # a ring with a missing side may have an odd number of crossings east of everything
    odd = crossed.groupBy("ring", "ilat").agg(F.count("*").alias("c")).where("c % 2 = 1").select("ilat", F.lit(float("-inf")).alias("x"), F.lit(1).alias("d"))
    opens = turns.unionByName(odd).withColumn("site", F.lit(None).cast(cells.schema["site"].dataType))
    line = opens.unionByName(cells.select(F.col("ilat").cast("long").alias("ilat"), F.col("lon").alias("x"), "site", F.lit(0).alias("d")))
    along = Window.partitionBy("ilat").orderBy("x", F.col("site").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    land = line.withColumn("_open", F.sum("d").over(along)).where("site is not null").select("site", (F.col("_open") > 0).cast("int").alias("land"))
    return cells.join(land, "site")


def cell_lengths(lines: DataFrame, keys: list[str], lat0: float, lon0: float, step: float) -> DataFrame:
    """(keys, ilat, ilon, km): length of lines (lat1, lon1, lat2, lon2) inside each cell, great-circle per piece.

    A line is cut where it crosses grid lines: the crossings' parameters are sorted, and each piece lies in the cell of its
    middle. Rows grow with the cells that lines cross, not with the grid.
    """
    def crossings(a: str, b: str, origin: float) -> Column:
        at = lambda c: (F.col(c) - origin) / F.lit(step)
        first, last = F.floor(F.least(at(a), at(b))) + 1, F.ceil(F.greatest(at(a), at(b))) - 1
        on = F.transform(F.sequence(first, last), lambda k: (k - at(a)) / (at(b) - at(a)))
        return F.when(first <= last, on).otherwise(F.array().cast("array<double>"))

    t = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings("lat1", "lat2", lat0), crossings("lon1", "lon2", lon0))))
    cut = lines.withColumn("_t", t).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_t") - 2)))
    place = lambda a, b, u: F.col(a) + (F.col(b) - F.col(a)) * u
    u, v = F.get("_t", F.col("_i")), F.get("_t", F.col("_i") + 1)
    km = haversine(place("lat1", "lat2", u), place("lon1", "lon2", u), place("lat1", "lat2", v), place("lon1", "lon2", v))
    middle = (u + v) / 2
    cell = lambda a, b, origin: F.floor((place(a, b, middle) - origin) / F.lit(step))
    return cut.select(*keys, cell("lat1", "lat2", lat0).alias("ilat"), cell("lon1", "lon2", lon0).alias("ilon"), km.alias("km")).groupBy(*keys, *CELL).agg(F.sum("km").alias("km"))


def _mean_clamped(a: Column, b: Column, top: float) -> Column:
    """Mean of a straight line from ``a`` to ``b``, held between 0 and ``top``, in closed form."""
    below = lambda t: F.when(t <= 0, 0.0).when(t >= top, top * t - top * top / 2).otherwise(t * t / 2)
    level = F.least(F.greatest((a + b) / 2, F.lit(0.0)), F.lit(top))
    return F.when(F.abs(b - a) < 1e-7, level).otherwise((below(b) - below(a)) / (b - a))


def overlap_area(edges: list[tuple[Column, Column, Column, Column]], lat: Column, lon: Column, step: float) -> Column:
    """Area of a polygon inside the cell from (lat, lon); ``edges``: its sides in order (y, x, the next x, slope).

    By Green's theorem the area is the sum over sides of the integral of the side's height above the cell's south, held
    between the cell's south and north. Each side is cut at the cell's west and east; what is left has a closed form, so no
    polygon is clipped. The sides are plain columns: lambdas over arrays would be interpreted for each cell.
    """
    hold = lambda x: F.least(F.greatest(x - lon, F.lit(0.0)), F.lit(step))

    def part(y: Column, x: Column, to: Column, slope: Column) -> Column:
        u, v, at = hold(x), hold(to), y - lat + (lon - x) * slope
        return (v - u) * _mean_clamped(at + u * slope, at + v * slope, step)

    return F.abs(reduce(lambda s, e: s + part(*e), edges, F.lit(0.0)))


def tessellate(pixels: DataFrame, keys: list[str], values: list[str], lat0: float, lon0: float, step: float, rows: int | None = None) -> DataFrame:
    """(keys, ilat, ilon, values, area, n): area-weighted means of quadrilateral pixels on the grid.

    ``pixels``: keys, values and four corners ``lats``, ``lons``, which are put in order around their middle. Longitudes are
    brought to -180..180; corners of a pixel across the date line are shifted to one side, and its cells wrap. With ``rows``,
    pixels that touch the first or last parallel of the grid, or lie beyond it, are left out whole, as the part outside
    would be lost. So are pixels with a missing corner. Each pixel is exploded to the cells of its bounding box; values
    that are null take no area.
    """
    four = lambda c: [F.get(c, F.lit(i)) for i in range(4)]
    known = lambda c: (F.size(c) == 4) & reduce(Column.__and__, [x.isNotNull() & ~F.isnan(x) for x in four(c)])
    # a small file is one task, whatever its number of pixels: they are dealt over all tasks. Pixels are left out by nulls up
    # to the end, as filters would be pushed down into that one task
    p = pixels.repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    p = p.withColumns({"lats": F.when(known("lats") & known("lons"), F.col("lats")), "lons": F.array(*[F.when(x > 180, x - 360).otherwise(x) for x in four("lons")])})
    if rows is not None:
        p = p.withColumn("lats", F.when((F.array_max("lats") < lat0 + rows * step) & (F.array_min("lats") > lat0), F.col("lats")))
    span = F.array_max("lons") - F.array_min("lons")
    p = p.withColumn("lons", F.when(span > 180, F.array(*[F.when(x < 0, x + 360).otherwise(x) for x in four("lons")])).otherwise(F.col("lons"))).withColumn("lons", F.when(F.col("lats").isNotNull(), F.col("lons")))
    middle = lambda c: (F.get(c, F.lit(0)) + F.get(c, F.lit(1)) + F.get(c, F.lit(2)) + F.get(c, F.lit(3))) / 4
    p = p.withColumns({"_my": middle("lats"), "_mx": middle("lons")})
    around = F.sort_array(F.zip_with("lats", "lons", lambda y, x: F.struct(F.atan2(y - F.col("_my"), x - F.col("_mx")).alias("t"), y.alias("y"), x.alias("x"))))
    p = p.withColumn("_c", around)
    corner = [F.get("_c", F.lit(i)) for i in range(4)]
    p = p.select(*keys, *values, "lats", "lons", *[c[k].alias(f"_{k}{i}") for i, c in enumerate(corner) for k in "yx"])
    slope = lambda i, j: F.when(F.col(f"_x{i}") == F.col(f"_x{j}"), 0.0).otherwise((F.col(f"_y{j}") - F.col(f"_y{i}")) / (F.col(f"_x{j}") - F.col(f"_x{i}")))
    p = p.withColumns({f"_s{i}": slope(i, (i + 1) % 4) for i in range(4)})
    sides = [f"_{k}{i}" for i in range(4) for k in "yxs"]
    cells = lambda c, origin: F.sequence(F.floor((F.array_min(c) - origin) / F.lit(step)), F.floor((F.array_max(c) - origin) / F.lit(step)))
    p = p.select(*keys, *values, *sides, F.explode_outer(cells("lats", lat0)).alias("ilat"), "lons")
    each = p.select(*keys, *values, *sides, "ilat", F.explode_outer(cells("lons", lon0)).alias("ilon"))
    edges = [tuple(F.col(c) for c in (f"_y{i}", f"_x{i}", f"_x{(i + 1) % 4}", f"_s{i}")) for i in range(4)]
    each = each.select(*keys, *values, "ilat", "ilon", overlap_area(edges, lat0 + F.col("ilat") * step, lon0 + F.col("ilon") * step, step).alias("_a"))
    # as a null and not by a filter, which would be pushed down and have the area worked out twice
    each = each.withColumns({"_a": F.when(F.col("_a") > 1e-12 * step * step, F.col("_a")), "ilon": F.pmod(F.col("ilon"), F.lit(round(360 / step)))})
    means = [F.try_divide(F.sum(F.col("_a") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("_a")))).alias(v) for v in values]
    return each.groupBy(*keys, *CELL).agg(*means, F.sum("_a").alias("area"), F.count("_a").alias("n")).where("n > 0")


def interpolated(at: Column, xs: Column, ys: Column, outside_zero: bool = False) -> Column:
    """Piecewise-linear values of (xs, ys) at the points of an array; xs ascend. Beyond the ends the end segments go on,
    or, if ``outside_zero``, values are 0."""
    def one(x: Column) -> Column:
        below = F.size(F.filter(xs, lambda v: v <= x))
        i = F.greatest(F.least(below, F.size(xs) - 1), F.lit(1))
        x0, x1, y0, y1 = F.get(xs, i - 1), F.get(xs, i), F.get(ys, i - 1), F.get(ys, i)
        line = y0 + (x - x0) / (x1 - x0) * (y1 - y0)
        return F.when((x < F.get(xs, F.lit(0))) | (x > F.get(xs, F.size(xs) - 1)), 0.0).otherwise(line) if outside_zero else line

    return F.transform(at, one)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def shape_factor(profile: Column, kernel: Column) -> Column:
    """Sum of profile * averaging kernel over the sum of the profile; null where that is 0."""
    return F.try_divide(_total(F.zip_with(profile, kernel, lambda a, b: a * b)), _total(profile))


def by_pressure(pressure: Column, values: Column) -> tuple[Column, Column]:
    """Levels of a profile with their pressures rising, as :func:`interpolated` wants them."""
    order = F.array_sort(F.zip_with(pressure, values, lambda p, v: F.struct(p.alias("p"), v.alias("v"))))
    return F.transform(order, lambda z: z["p"]), F.transform(order, lambda z: z["v"])


def corrected_column(df: DataFrame, to: str, slant: str, amf: str, kernel: str, sensor: str, pressure: str, profile: str, tropopause: str | None = None, floor: float | None = None) -> DataFrame:
    """Vertical column of a pixel by the model's profile shape: ``<to>_amf`` and ``to`` (null where they cannot be had).

    The profile (on ``pressure``) is interpolated to the sensor's levels; the air-mass factor times the kernel's mean over
    it is the new factor, and the slant column over that is the result. Without a tropopause the profile goes on beyond its
    ends along the end segments. With one it is the tropospheric column: layers above the tropopause (lower pressure) count
    0 in profile and kernel, and so do levels outside the profile. A new factor under ``floor`` gives no result. A pixel
    with any missing level has none either.
    """
    whole = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))
    shape, weights = F.col(profile), F.col(kernel)
    if tropopause:
        shape = F.zip_with(profile, pressure, lambda v, p: F.when(p >= F.col(tropopause), v).otherwise(0.0))
        weights = F.zip_with(kernel, sensor, lambda k, p: F.when(p >= F.col(tropopause), k).otherwise(0.0))
    x, y = by_pressure(F.col(pressure), shape)
    df = df.withColumns({"_x": x, "_y": y, "_k": weights})
    df = df.withColumn("_s", interpolated(F.col(sensor), F.col("_x"), F.col("_y"), tropopause is not None))
    if tropopause:
        df = df.withColumn("_s", F.zip_with("_s", sensor, lambda v, p: F.when(p >= F.col(tropopause), v).otherwise(0.0)))
    ok = whole(profile) & whole(pressure) & whole(sensor)
    if tropopause:
        ok = ok & (_total(F.col("_y")) > 0) & (_total(F.col("_s")) > 0)
    new = F.when(ok, F.col(amf) * shape_factor(F.col("_s"), F.col("_k")))
    df = df.withColumn(f"{to}_amf", F.when(~F.isnan(new), new))
    usable = F.col(f"{to}_amf") != 0
    if floor is not None:
        usable = usable & (F.col(f"{to}_amf") >= floor)
    return df.withColumn(to, F.when(usable, F.col(slant) / F.col(f"{to}_amf"))).drop("_x", "_y", "_k", "_s")
