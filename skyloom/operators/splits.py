"""Cross-validation splits by a seeded hash order that other engines can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.units import fold_of, haversine, nearest_index
from skyloom.sources.tables import settled


def hash_order(key: str, seed: int | str):
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def random_folds(sites: DataFrame, k: int, repeats: int = 1, seed: int = 20230130, key: str = "site") -> DataFrame:
    """(key, repeat, fold): folds by hash, so no global sort is needed."""
    parts = [sites.select(key, F.lit(r).alias("repeat"), fold_of(F.col(key), k, seed, r).alias("fold")) for r in range(repeats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stratified_folds(sites: DataFrame, k: int, seed: int = 20230130, key: str = "site", region: str = "region") -> DataFrame:
    """Sites dealt in hash order to k folds inside each region."""
    w = Window.partitionBy(region).orderBy(hash_order(key, seed), key)
    return sites.withColumn("fold", (F.row_number().over(w) - 1) % k)


def fixed_test(sites: DataFrame, n: int, seed: int = 20230130, key: str = "site") -> DataFrame:
    """n test sites in hash order (role 1), the rest training (role -1)."""
    h = sites.select(key, hash_order(key, seed).alias("h"))
    test = h.orderBy("h", key).limit(n).select(key, F.lit(1).alias("role"))
    return sites.join(F.broadcast(test), key, "left").withColumn("role", F.coalesce("role", F.lit(-1)))


def roles(folds: DataFrame, k: int, key: str = "site") -> DataFrame:
    """(fold, key, role): 1 in the own fold, -1 in the others."""
    return folds.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(F.col("f").alias("fold"), key, F.when(F.col("f") == F.col("fold"), 1).otherwise(-1).alias("role"))


def in_regions(sites: DataFrame, masks: DataFrame, names: list[str], lat0: float, lon0: float, step: float, rows: int, columns: int) -> DataFrame:
    """Sites whose nearest cell lies in the union of the named masks (region, ilat, ilon); all sites if no region is named.
    Names without a mask count nothing. (lat0, lon0) is the middle of the first cell."""
    if not names:
        return sites
    wanted = masks.where(F.col("region").isin(names)).select(F.col("ilat").cast("int").alias("_i"), F.col("ilon").cast("int").alias("_j")).distinct()
    at = sites.withColumns({"_i": nearest_index(F.col("lat"), lat0, step, rows), "_j": nearest_index(F.col("lon"), lon0, step, columns)})
    return at.join(wanted, ["_i", "_j"], "left_semi").drop("_i", "_j")


def isolated_folds(alone: DataFrame, k: int, seed: int = 20230130, key: str = "site") -> DataFrame:
    """(key, fold) of sites that stand alone: folds by hash; with fewer sites than folds, the sites and as many blanks as are
    missing are dealt one to a fold in hash order, so that no fold gets two and the folds of the blanks have none."""
    few = alone.select(key).limit(k).count() < k
    if not few:
        return alone.select(key, fold_of(F.col(key), k, seed).alias("fold"))
    named = alone.select(F.col(key), F.col(key).cast("string").alias("_n"))  # fewer than k rows
    blank = alone.sparkSession.range(k - named.count()).select(F.lit(None).cast(alone.schema[key].dataType).alias(key), F.concat(F.lit("blank "), F.col("id").cast("string")).alias("_n"))
    order = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col("_n"))), "_n")
    dealt = named.unionByName(blank).withColumn("fold", (F.row_number().over(order) - 1).cast("long"))
    return dealt.where(F.col(key).isNotNull()).select(key, "fold")


def cluster_folds(sites: DataFrame, k: int, seeds: int, seed: int = 20230130, key: str = "site") -> DataFrame:
    """(key, fold) by leave-cluster-out: fold after fold, ``seeds`` unused sites in hash order become cluster seeds, and
    the unused sites nearest to a seed are its test sites, up to the distance of the fold's quota-th (ties included).

    A quota under the number of seeds takes the first seeds alone. Sites that no quota reached stay without a fold.
    Each fold is a table, so that the next one does not repeat it; only the quotas (of one count) reach the driver.
    """
    n = sites.count()
    rest, out = sites.select(key, "lat", "lon"), None
    for i in range(k):
        quota = n // k + (i < n % k)
        if not quota:
            break
        order = hash_order(key, f"{seed}-{i}")
        picked = rest.withColumn("_h", order).orderBy("_h", key).limit(min(seeds, quota)).select(F.col("lat").alias("_a"), F.col("lon").alias("_o"), F.col(key).alias("_k"))
        if quota < seeds:
            test = rest.join(F.broadcast(picked.select(F.col("_k").alias(key))), key, "left_semi").select(key)
        else:
            # at most ``seeds`` rows are broadcast, whatever the number of sites
            near = rest.crossJoin(F.broadcast(picked)).groupBy(key).agg(F.min(F.bround(haversine(F.col("lat"), F.col("lon"), F.col("_a"), F.col("_o")), 6)).alias("_d"))
            radius = near.orderBy("_d").limit(quota).agg(F.max("_d").alias("_r"))
            test = near.join(F.broadcast(radius), F.col("_d") <= F.col("_r")).select(key)
        fold = settled(test.withColumn("fold", F.lit(i)), "cluster-fold")
        out = fold if out is None else out.unionByName(fold)
        rest = settled(rest.join(fold, key, "left_anti"), "cluster-rest")
    return sites.select(key, F.lit(0).alias("fold")).where("false") if out is None else out


def cluster_roles(sites: DataFrame, folds: DataFrame, k: int, km: float, key: str = "site") -> DataFrame:
    """(fold, key, role): 1 test, -1 train, 0 within ``km`` of a test site of the fold (0: at its place) and so left out."""
    from skyloom.operators.spatial import radius_join

    each = sites.select(key, "lat", "lon").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    own = folds.select("fold", key).withColumn("_own", F.lit(True))
    # places meet: many sites at one place make no more pairs
    test = folds.join(sites.select(key, "lat", "lon"), key).select("lat", "lon", "fold").distinct()
    near = radius_join(sites.select("lat", "lon").distinct(), test, km).select("lat", "lon", F.col("fold2").alias("fold")).distinct().withColumn("_near", F.lit(True))
    # exploded sites are estimated too low to be left to a broadcast
    joined = each.join(own.hint("merge"), ["fold", key], "left").join(near.hint("merge"), ["fold", "lat", "lon"], "left")
    return joined.select("fold", key, F.when(F.col("_own"), 1).when(F.col("_near"), 0).otherwise(-1).alias("role"))
