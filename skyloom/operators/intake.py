"""Intake: one schema out of many file layouts."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from skyloom.functions.units import sensor_type
from skyloom.sources.tables import settled

#: Byte order mark, zero-width characters and line ends that names are freed of.
INVISIBLE = r"[\x{FEFF}\x{200B}\x{200C}\x{200D}\r\n]"


def valid_only(df: DataFrame, flag: str, least: int = 1) -> DataFrame:
    """Rows whose validity flag is at least ``least``; all rows where the source has no such column."""
    return df.where(F.col(flag) >= least) if flag in df.columns else df


@F.pandas_udf(StringType())
def _plain(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).casefold())


def plain_names(df: DataFrame, name: str, out: str = "plain") -> DataFrame:
    """Names without invisible characters, accents, outer blanks and case; worked out once for each distinct name."""
    names = df.select(name).distinct().withColumn(out, F.trim(_plain(F.regexp_replace(name, INVISIBLE, ""))))
    return df.join(names, F.equal_null(df[name], names[name]), "left").drop(names[name])


def melt_months(wide: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Columns ``{month}_{part}`` for months 1 to 12 -> one row a month; months without any part are left out."""
    month = lambda m: F.struct(F.lit(m).alias("mon"), *[F.col(f"{m}_{p}").alias(p) for p in parts])
    rows = wide.select(*keys, F.explode(F.array(*map(month, range(1, 13)))).alias("x")).select(*keys, "x.*")
    return rows.dropna("all", subset=parts)


def routed(df: DataFrame, routes: list[tuple]) -> DataFrame:
    """Union of (condition, {target: source expression}) layouts; a target that a layout lacks is null."""
    out = None
    for condition, columns in routes:
        part = df.where(condition).select(*[F.expr(e).alias(c) for c, e in columns.items()])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def select_channels(columns: list[str], include: list[str] | None = None, exclude: list[str] = ()) -> list[str]:
    """Channels to train on, in the order of ``columns``."""
    return [c for c in columns if (include is None or c in include) and c not in exclude]


def picked(columns: list[str], keys: list[str]) -> str | None:
    """The first column whose folded name holds one of the keywords, in the order of the keywords."""
    folded = {c: "".join(x for x in unicodedata.normalize("NFD", c).casefold().strip() if not unicodedata.combining(x)) for c in columns}
    return next((c for k in keys for c in columns if k in folded[c]), None)


def date_column(df: DataFrame, columns: list[str] | None = None, share: float = 0.8, form: str | None = None) -> str | None:
    """The first column of which over ``share`` of the values parse as timestamps; one aggregation looks at all of them."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    parsed = lambda c: F.try_to_timestamp(F.col(c), F.lit(form)) if form else F.try_to_timestamp(F.col(c))
    if not columns:
        return None
    row = df.agg(*[F.avg(parsed(c).isNotNull().cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return next((c for i, c in enumerate(columns) if (row[f"c{i}"] or 0) > share), None)


def resolved(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns renamed by keyword: {target: keywords}; a target without a match is null."""
    found = {t: picked(df.columns, keys) for t, keys in wanted.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(t) for t, c in found.items()])


#: Units by parameter number.
SENSOR_UNITS = {5: "µg/m³", 7: "ppm", 15: "ppb"}
LOCATION = "id long, name string, coordinates struct<latitude: double, longitude: double>, bounds array<double>, isMobile boolean, isMonitor boolean, sensors array<struct<id: long, parameter: struct<id: int>>>"


def sensors_of(df: DataFrame, json: str = "json") -> DataFrame:
    """Locations as JSON -> one row per sensor of a known parameter, with its unit; coordinates fall back to the bounds."""
    x = df.select(F.from_json(json, LOCATION).alias("x")).select("x.*").withColumn("s", F.explode("sensors"))
    unit = F.lit(None).cast("string")
    for k, u in SENSOR_UNITS.items():
        unit = F.when(F.col("s.parameter.id") == k, u).otherwise(unit)
    missing = F.col("coordinates.latitude").isNull() | F.col("coordinates.longitude").isNull()
    bound = lambda i: F.get("bounds", F.lit(i))
    usable = missing & (F.size("bounds") >= 2)
    lat = F.when(usable, bound(1)).otherwise(F.col("coordinates.latitude"))
    lon = F.when(usable, bound(0)).otherwise(F.col("coordinates.longitude"))
    return x.select(F.col("s.id").alias("sensor_id"), F.col("id").alias("location_id"), F.col("name").alias("location_name"), lat.alias("lat"), lon.alias("lon"), unit.alias("unit"), sensor_type(F.coalesce("isMobile", F.lit(False)), F.coalesce("isMonitor", F.lit(False))).alias("sensor_type")).where("unit is not null")


def _grams(df: DataFrame, name: str, side: int) -> DataFrame:
    """Adds ``_g``: the pairs of neighbouring characters of a name (marked at both ends), each with its how-manieth it is."""
    padded = F.concat(F.lit("\x02"), F.col(name), F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substr(padded, i, F.lit(2)))
    nth = F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, 1, i + 1), lambda h: h == g)).cast("string")))
    return df.withColumns({"_side": F.lit(side), "_g": nth})


#: Longest names whose one-edit neighbours are looked up by their variants.
SHORT = 100


def _alike(names: DataFrame, sites: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, name, site_name, score): all pairs of distinct names under equal keys with a score of at least ``least``.

    Each edit breaks two pairs of characters at most, so two names, the longer of n characters, share n + 1 - 2 * edits of
    them, which is at least 1 + (2 * least - 1) * n. They meet in the rarest pairs that either has over that number.
    """
    both = _grams(names.withColumnRenamed("name", "_name"), "_name", 0).unionByName(_grams(sites.withColumnRenamed("site_name", "_name"), "_name", 1))
    each = both.withColumn("_h", F.explode_outer("_g"))  # outer: else Spark asks for its size as well, below the distinct
    rare = each.groupBy(*keys, "_h").agg(F.count("*").alias("_c"))
    order = F.transform(F.sort_array(F.collect_list(F.struct("_c", "_h"))), lambda z: z["_h"])
    ranked = each.join(rare, [*keys, "_h"]).groupBy(*keys, "_name", "_side").agg(order.alias("_g"))
    shared = F.ceil(1 + (2 * (least - 1e-6) - 1) * F.length("_name"))
    first = ranked.withColumn("_h", F.explode_outer(F.slice("_g", 1, F.least(F.size("_g"), (F.size("_g") - shared + 1).cast("int")))))
    left = first.where("_side = 0").select(*keys, "_h", F.col("_name").alias("name"))
    right = first.where("_side = 1").select(*keys, "_h", F.col("_name").alias("site_name"))
    longer = F.greatest(F.length("name"), F.length("site_name"))
    met = left.join(right, [*keys, "_h"]).where(F.least(F.length("name"), F.length("site_name")) >= (least - 1e-6) * longer).select(*keys, "name", "site_name").distinct()
    return met.withColumn("score", F.bround(1 - F.levenshtein("name", "site_name") / longer, 6)).where(F.col("score") >= least)


def fuzzy_sites(names: DataFrame, sites: DataFrame, group: str, least: float = 0.7) -> DataFrame:
    """(group, name, site_name, score): the site of equal name in the group, else the most similar one of at least
    ``least`` (1 - Levenshtein distance over the longer length; ties go to the smaller name), else no row.

    Exact matches leave by an equi-join first. A name's shape has 0 for each digit; shapes are no further apart than their
    names, so only names of shapes that reach ``least`` can match, and names that merely differ in numbers are one shape.
    Of the rest, names one edit apart share the name or a variant without one character: they meet by equi-joins, and as no
    site with more edits scores as much, they leave next. The others meet over pairs of characters, under their shapes.
    ``least`` is over one half.
    """
    if least <= 0.5:
        raise ValueError("least")
    n, s = names.select(group, "name").distinct(), sites.select(group, F.col("name").alias("site_name")).distinct()
    exact = n.join(s, (n[group] == s[group]) & (n["name"] == s["site_name"])).select(n[group], "name", "site_name", F.lit(1.0).alias("score"))
    shape = lambda c: F.translate(c, "123456789", "000000000")
    rest = n.join(exact.select(group, "name"), [group, "name"], "left_anti").withColumn("_shape", shape(F.col("name")))
    s = s.withColumn("_site_shape", shape(F.col("site_name")))
    equal = F.col("name") == F.col("site_name")
    a, b = rest.select(group, F.col("_shape").alias("name")).distinct(), s.select(group, F.col("_site_shape").alias("site_name")).distinct()
    shapes = a.join(b.withColumn("name", F.col("site_name")), [group, "name"]).select(group, "name", "site_name").unionByName(_alike(a, b, [group], least).where(~equal).select(group, "name", "site_name"))
    shapes = settled(shapes.select(group, F.col("name").alias("_shape"), F.col("site_name").alias("_site_shape")), "shapes")
    rest = rest.join(shapes.select(group, "_shape"), [group, "_shape"], "left_semi")
    s = s.join(shapes.select(group, "_site_shape"), [group, "_site_shape"], "left_semi")
    longer = F.greatest(F.length("name"), F.length("site_name"))

    def variants(df: DataFrame, name: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))
        return df.where(F.length(name).between(1, SHORT)).select(group, name, F.explode_outer(F.array_distinct(F.array_append(cut, F.col(name)))).alias("_v"))

    near = variants(rest, "name").join(variants(s, "site_name"), [group, "_v"]).where(F.levenshtein("name", "site_name", 1) == 1)
    near = near.select(group, "name", "site_name", F.bround(1 - 1 / longer, 6).alias("score")).where(F.col("score") >= least)

    def best(pairs: DataFrame) -> DataFrame:
        top = pairs.groupBy(group, "name").agg(F.min(F.struct((-F.col("score")).alias("k"), "site_name")).alias("b"))
        return top.select(group, "name", "b.site_name", (-F.col("b.k")).alias("score"))

    near = settled(best(near), "near-names")
    far = rest.join(near.select(group, "name"), [group, "name"], "left_anti").join(shapes, [group, "_shape"]).select(group, "_site_shape", "name")
    return exact.unionByName(near).unionByName(best(_alike(far, s.select(group, "_site_shape", "site_name"), [group, "_site_shape"], least)))


def catalogued(grid: DataFrame, catalog: list[tuple[str, str, str]], months: DataFrame, switch: int) -> DataFrame:
    """(channel, year, mon, ilat, ilon, v) of a catalog of (channel, column, kind) for the wanted ``months`` (year, mon).

    Kinds: ``static`` (mean of all time), ``annual`` (mean of the year), ``monthly``, and ``early`` or ``late`` (monthly,
    up to the month ``switch`` = year * 100 + month, or after it), so two products can share a channel's name.
    """
    wanted = F.broadcast(months.distinct())  # one row per month
    at = F.col("year") * 100 + F.col("mon")
    when = {"monthly": F.lit(True), "early": at <= switch, "late": at > switch}
    named = lambda c, v: F.struct(F.lit(c).alias("channel"), v.cast("double").alias("v"))
    keys, parts = ["ilat", "ilon"], []
    monthly = [F.when(when[kind], named(c, F.col(column))) for c, column, kind in catalog if kind in when]
    if monthly:
        # one scan for all of them; a channel that has no row in a month has none here
        each = grid.join(wanted, ["year", "mon"]).select("year", "mon", *keys, F.explode(F.filter(F.array(*monthly), lambda x: x.isNotNull())).alias("_c"))
        parts.append(each.select("_c.channel", "year", "mon", *keys, "_c.v"))
    slow = sorted({column for _, column, kind in catalog if kind not in when})
    if slow:
        sums = [a.alias(f"_{n}_{c}") for c in slow for n, a in (("s", F.sum(c)), ("n", F.count(c)))]
        yearly = grid.groupBy(*keys, "year").agg(*sums)  # one aggregation; the static means come from its sums
        if annual := [(c, column) for c, column, kind in catalog if kind == "annual"]:
            each = yearly.join(wanted, "year").select("year", "mon", *keys, F.explode(F.array(*[named(c, F.try_divide(f"_s_{x}", f"_n_{x}")) for c, x in annual])).alias("_c"))
            parts.append(each.select("_c.channel", "year", "mon", *keys, "_c.v"))
        if static := [(c, column) for c, column, kind in catalog if kind == "static"]:
            mean = yearly.groupBy(*keys).agg(F.array(*[named(c, F.try_divide(F.sum(f"_s_{x}"), F.sum(f"_n_{x}"))) for c, x in static]).alias("_c"))
            parts.append(mean.crossJoin(wanted).select(F.explode("_c").alias("_c"), "year", "mon", *keys).select("_c.channel", "year", "mon", *keys, "_c.v"))
    return reduce(DataFrame.unionByName, parts)
