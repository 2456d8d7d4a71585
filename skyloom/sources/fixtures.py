"""Driver tables -> the domain's schemas, as DataFrames and as the same SQL text (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LAT = "cast((({k}*7919)%3000) as double)/100e0+30e0"
_LON = "cast((({k}*104729)%4000) as double)/100e0-10e0"

#: Statements that both Spark SQL and DuckDB read.
SITES = f"select c_custkey as site, {_LAT.format(k='c_custkey')} as lat, {_LON.format(k='c_custkey')} as lon, c_nationkey % 6 as region, c_mktsegment as kind from customer"
HOURLY = "select user_id % 10 as site, ts, cast(ts as date) as day, value, case event_type when 'click' then 'ppm' when 'view' then 'ppb' when 'purchase' then 'µg/m³' else 'n/a' end as unit from events"
OBS = f"select l_suppkey as site, {_LAT.format(k='l_suppkey')} as lat, {_LON.format(k='l_suppkey')} as lon, year(l_shipdate) as year, month(l_shipdate) as mon, avg(l_extendedprice)/1000e0 as no2, concat('C', cast(l_suppkey % 7 as string)) as country from lineitem group by l_suppkey, year(l_shipdate), month(l_shipdate)"
OBS2 = f"select o_custkey as site, {_LAT.format(k='o_custkey')} as lat, {_LON.format(k='o_custkey')} as lon, year(o_orderdate) as year, month(o_orderdate) as mon, avg(o_totalprice)/1000e0 as no2, concat('C', cast(o_custkey % 7 as string)) as country from orders group by o_custkey, year(o_orderdate), month(o_orderdate)"
GRID = "select l_partkey % 20 as ilat, l_suppkey % 25 as ilon, year(l_shipdate) as year, month(l_shipdate) as mon, avg(case when l_returnflag <> 'R' then l_extendedprice end) as sat, avg(l_quantity) as gchp from lineitem group by l_partkey % 20, l_suppkey % 25, year(l_shipdate), month(l_shipdate)"
CV = "select l_suppkey as site, year(l_shipdate) as year, month(l_shipdate) as mon, l_suppkey % 6 as region, l_extendedprice as obs, l_extendedprice*(1-l_discount) as pred, l_quantity*1000e0 as geo, l_quantity as pop, case when l_linenumber % 4 = 0 then 'train' else 'test' end as split from lineitem"
PATH = "select l_suppkey % 20 as model, (year(l_shipdate)-1995)*12+month(l_shipdate) as step, l_partkey % 12 as feature, max(case when l_returnflag <> 'R' then 1 else 0 end) as selected from lineitem group by l_suppkey % 20, (year(l_shipdate)-1995)*12+month(l_shipdate), l_partkey % 12"
ALL = {"sites": SITES, "hourly": HOURLY, "obs": OBS, "obs2": OBS2, "grid": GRID, "cv": CV, "hist": PATH}
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named fixture, or a driver table as it is."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = ALL[name]
    out = sql
    args = {}
    for t in TABLES:
        if f"from {t}" in sql:
            out = out.replace(f"from {t}", "from {" + t + "}")
            args[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(out, **args)


def with_(*names: str) -> str:
    """The WITH clause of the named fixtures, for DuckDB."""
    return "with " + ", ".join(f"{n} as ({ALL[n]})" for n in names) + " "
