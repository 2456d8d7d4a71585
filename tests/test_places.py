"""Many sites at one place: right rows, and no exploded side is broadcast."""

import duckdb
import pytest
from test_queries import close, rows

from skyloom.operators import label as label_ops
from skyloom.operators import spatial, splits
from skyloom.plans import coverage, fields, label, learning, model, registry  # noqa: F401


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Customers and suppliers whose numbers differ by 12000 share a place."""
    d = str(tmp_path_factory.mktemp("crowded"))
    con = duckdb.connect()
    con.execute("create table k as select cast(1 + i * 7 % 3000 + j * 12000 as bigint) as k from range(90) a(i), range(4) b(j) where (i + j) % 5 <> 0 or j = 0")
    con.execute(f"copy (select k as c_custkey, cast(k % 25 as bigint) as c_nationkey, cast(k % 997 as double) as c_acctbal, 'A' as c_mktsegment from k) to '{d}/customer.parquet'")
    con.execute(f"copy (select k as s_suppkey, cast(k % 25 as bigint) as s_nationkey, cast(k % 991 as double) as s_acctbal from k where k % 2 = 0) to '{d}/supplier.parquet'")
    con.execute(f"copy (select k % 20000 as l_partkey, k as l_suppkey, timestamp '1996-01-15' + interval (m) month as l_shipdate, cast((k * 31 + m * 577) % 900 as double) as l_extendedprice, cast(k % 50 as double) as l_quantity, 'N' as l_returnflag from k, range(3) t(m)) to '{d}/lineitem.parquet'")
    for t in ("customer", "supplier", "lineitem"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return d, con


NAMES = ["p1_fold_roles", "p2_local_reference", "p7_mahalanobis_map", *"j1_buffer_exclusion j2_self_nearest j3_test_train_nearest j4_knn j5_knn_distance j6_local_density j7_land_distance j8_period_neighbours j10_fold_report l6_buffered_leave_out l7_leave_cluster_out l8_self_isolated k1_patches k6_normalise".split()]


@pytest.mark.parametrize("name", NAMES)
def test_crowded_places(spark, crowded, name):
    d, con = crowded
    df = registry.QUERIES[name](spark, d)
    res = con.execute(registry.ORACLES[name])
    got, want = rows(df.columns, df.collect()), rows([c[0] for c in res.description], res.fetchall())
    assert len(got) == len(want) and all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_roles_at_distance_zero(spark):
    s = spark.createDataFrame([(1, 50.0, 5.0), (2, 50.0, 5.0), (3, 50.0, 6.0)], "site long, lat double, lon double")
    folds = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "site long, fold int")
    got = {(r.fold, r.site): r.role for r in splits.cluster_roles(s, folds, 2, 0.0).collect()}
    assert got == {(0, 1): 1, (0, 2): 0, (0, 3): -1, (1, 1): 0, (1, 2): 1, (1, 3): 1}


def test_fold_roles_hold_every_site(spark, crowded):
    """Each observation counts once for every radius and fold, whatever its site's number."""
    d, con = crowded
    got = registry.QUERIES["p1_fold_roles"](spark, d).groupBy("radius", "fold").sum("n").collect()
    n = con.execute("select count(*) from (select distinct l_suppkey, l_shipdate from lineitem)").fetchone()[0]
    assert sorted((r.radius, r.fold, r["sum(n)"]) for r in got) == [(radius, fold, n) for radius in (0, 60) for fold in range(4)]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_sides_are_not_broadcast(spark, crowded):
    s = spark.range(1000).selectExpr("id as site", "50.0D + id % 3 as lat", "id % 7 * 1.0D as lon")
    for df in (spatial.knn_join(s, s, 2), spatial.radius_join(s, s, 10.0), spatial.within(s, s, 10.0), registry.QUERIES["k1_patches"](spark, crowded[0])):
        assert "BroadcastExchange" not in physical(df)


def test_counts_of_crowded_places(spark):
    """A quarter of a million sites at three places: all pairs would be 2e10."""
    s = spark.range(250000).selectExpr("id as site", "50.0D + id % 3 as lat", "5.0D as lon")
    got = {r.lat: (r.n, r["count"]) for r in spatial.radius_counts(s, s, 120.0).groupBy("lat", "n").count().collect()}
    assert got == {50.0: (166667, 83334), 51.0: (250000, 83333), 52.0: (166666, 83333)}


def test_spikes_of_sites_at_one_place(spark):
    """The last site of a month meets the next month, the first one the month before, in whatever order rows come."""
    data = [(site, 50.0, 5.0, 1999, mon, 4.0 if mon != 2 else 90.0) for mon in (1, 2, 3) for site in range(1, 8)]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "site long, lat double, lon double, year int, mon int, no2 double").coalesce(1)
        assert {r.site for r in label_ops.spikes(df).where("spike").collect()} == {1, 7}
