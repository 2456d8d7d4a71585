"""Gradient-boosted regression with MLlib on patch features: samples, fits that stop early, gains, tuning over a fold
column, cross-validated predictions and prediction maps."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Value of map cells without a prediction.
NO_DATA = -999.0
SEED = 20230130


def windows(places: DataFrame, grid: DataFrame, channels: list[str], reach: int = 1, when: tuple[str, ...] = ("year", "mon")) -> DataFrame:
    """(ilat, ilon, when, a column per channel): the cells around each distinct place (ilat, ilon) as an array, row by row
    from the south-west.

    ``grid``: ilat, ilon, when, channels. Cells that the grid does not have are null. Each place asks for its window's cells
    in one equi-join, and a window's rows meet in one group of bounded size.
    """
    side = 2 * reach + 1
    at = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("_i")
    asked = places.select("ilat", "ilon").distinct().select(F.col("ilat").alias("_y"), F.col("ilon").alias("_x"), at)
    asked = asked.withColumns({"ilat": F.col("_y") + F.floor(F.col("_i") / side) - reach, "ilon": F.col("_x") + F.col("_i") % side - reach})
    met = asked.join(grid.select("ilat", "ilon", *when, *channels), ["ilat", "ilon"])
    window = met.groupBy("_y", "_x", *when).agg(F.map_from_entries(F.collect_list(F.struct("_i", F.struct(*channels)))).alias("_m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.try_element_at("_m", i))
    return window.withColumn("_c", cells).select(F.col("_y").alias("ilat"), F.col("_x").alias("ilon"), *when, *[F.col(f"_c.{c}").cast("array<double>").alias(c) for c in channels])


def patches(sites: DataFrame, grid: DataFrame, channels: list[str], reach: int = 1, when: tuple[str, ...] = ("year", "mon")) -> DataFrame:
    """(site, when, a column per channel): the windows of the sites (site, ilat, ilon). Sites in one cell share theirs."""
    made = windows(sites, grid, channels, reach, when).hint("merge")
    return sites.select("site", "ilat", "ilon").join(made, ["ilat", "ilon"]).select("site", *when, *channels)


def flattened(channels: list[str], reach: int = 1, mode: str = "centre") -> Column:
    """One array of features from the patches of all channels: their middle cells, or all cells of one after the other."""
    if mode == "flatten":
        return F.concat(*channels)
    side = 2 * reach + 1
    return F.array(*[F.get(c, F.lit(side * side // 2)) for c in channels])


def filled_vector(df: DataFrame, train: DataFrame, size: int, values: str = "values", to: str = "features") -> DataFrame:
    """``to``: the array ``values`` as a vector, nulls filled with the means over ``train`` (0 where all are null)."""
    means = train.agg(*[F.coalesce(F.avg(F.get(values, F.lit(i))), F.lit(0.0)).alias(f"m{i}") for i in range(size)])
    both = df.crossJoin(F.broadcast(means.select(F.array(*means.columns).alias("_m"))))  # one row
    return both.withColumn(to, array_to_vector(F.zip_with(values, "_m", lambda v, m: F.coalesce(v, m)))).drop("_m")


def boosted(train: DataFrame, label: str, features: str = "features", validation: str | None = None, tolerance: float = 0.01, trees: int = 12, depth: int = 4, step: float = 0.3, share: float = 1.0, bins: int = 32, seed: int = SEED) -> GBTRegressionModel:
    """A model of ``label`` from the rows where it is not null.

    With a boolean column ``validation``, boosting ends once a tree lessens the error of the rows marked there by less than
    ``tolerance`` of it, and the trees up to the best stay; those rows are not learnt from.
    """
    rows = train.where(F.col(label).isNotNull())
    gbt = GBTRegressor(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=share, maxBins=bins, seed=seed, checkpointInterval=-1, validationTol=tolerance)
    return (gbt.setValidationIndicatorCol(validation) if validation else gbt).fit(rows)


def predicted(model: GBTRegressionModel, df: DataFrame, to: str = "pred") -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", to)


def gains(model: GBTRegressionModel, names: list[str]) -> DataFrame:
    """(feature, gain): shares of all gain, zero for features that no tree uses; a row per feature."""
    from pyspark.sql import SparkSession

    found = model.featureImportances.toArray()
    return SparkSession.active().createDataFrame([(n, float(g)) for n, g in zip(names, found)], "feature string, gain double")


def cross_validated(samples: DataFrame, label: str, folds: int, spans: list[tuple[int, int]], fold: str = "fold", **params) -> DataFrame:
    """Rows of the years of each span with ``span``, ``model`` (the fold left out), ``role`` (1 test, -1 train) and ``pred``.

    One fit per span and fold. Predictions of all models of a span are made in one pass over its rows.
    """
    parts = []
    for first, last in spans:
        rows = samples.where(F.col("year").between(first, last))
        models = [boosted(rows.where(F.col(fold) != k), label, **params) for k in range(folds)]
        made = reduce(lambda df, k: predicted(models[k], df, f"_p{k}"), range(folds), rows)
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(f"_p{k}").alias("pred")) for k in range(folds)]))
        kept = made.withColumn("_e", each).select(*samples.columns, F.lit(f"{first}-{last}").alias("span"), "_e.*")
        parts.append(kept.withColumn("role", F.when(F.col(fold) == F.col("model"), 1).otherwise(-1)))
    return reduce(DataFrame.unionByName, parts)


def tuned(samples: DataFrame, label: str, size: int, variants: dict[str, dict], folds: int, fold: str = "fold", validation: str | None = None, parallelism: int = 4, **fixed):
    """Cross-validation of named variants over a fold column: (held-out predictions with ``variant`` and ``pred``, the best
    variant's name, its model of all rows).

    A variant is a set of GBTRegressor parameters (maxDepth, stepSize, ...) and, under ``without``, of places in the features
    vector that it does without. One tuner fits all variants on each fold's rows, several at a time; the models it fits on
    the way give the predictions, in one pass over the rows of each fold.
    """
    slicer = VectorSlicer(inputCol="features", outputCol="_used")
    gbt = GBTRegressor(featuresCol="_used", labelCol=label, predictionCol="pred", seed=SEED, **fixed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    grid = []
    for v in variants.values():
        used = [i for i in range(size) if i not in v.get("without", ())]
        grid.append({slicer.indices: used} | {gbt.getParam(k): x for k, x in v.items() if k != "without"})
    judge = RegressionEvaluator(labelCol=label, predictionCol="pred", metricName="rmse")
    cv = CrossValidator(estimator=Pipeline(stages=[slicer, gbt]), estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol=fold, parallelism=parallelism, collectSubModels=True)
    rows = samples.where(F.col(label).isNotNull())
    model = cv.fit(rows)
    parts = []
    for k in range(folds):
        made = rows.where(F.col(fold) == k)
        for i in range(len(variants)):
            made = model.subModels[k][i].transform(made).withColumnRenamed("pred", f"_p{i}").drop("_used")
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"_p{i}").alias("pred")) for i, n in enumerate(variants)]))
        parts.append(made.withColumn("_e", each).select(*samples.columns, "_e.*"))
    best = min(range(len(variants)), key=lambda i: model.avgMetrics[i])
    return reduce(DataFrame.unionByName, parts), list(variants)[best], model.bestModel


def prediction_map(model: GBTRegressionModel, cells: DataFrame, land: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pred) of all ``cells`` (keys, features): predicted where ``land`` has the cell's (ilat, ilon), ``NO_DATA``
    elsewhere."""
    on_land = predicted(model, cells.join(land.select("ilat", "ilon").distinct(), ["ilat", "ilon"], "left_semi")).select(*keys, "pred")
    return cells.select(*keys).join(on_land, keys, "left").withColumn("pred", F.coalesce("pred", F.lit(NO_DATA)))


OBJECTIVES = ["bias", "norm_bias", "norm_species", "species", "logged"]


def objective_scales(train: DataFrame, species: str, geo: str) -> DataFrame:
    """One row: mean and deviation (1 where it is 0) of the bias and of the species over the training rows."""
    bias = F.col(species) - F.col(geo)
    one = lambda x: F.when(x == 0, 1.0).otherwise(x)
    return train.agg(F.avg(bias).alias("_mb"), one(F.stddev_pop(bias)).alias("_sb"), F.avg(species).alias("_mo"), one(F.stddev_pop(species)).alias("_so"))


def objective(kind: str, species: Column, geo: Column) -> Column:
    """What a model learns; needs the columns of :func:`objective_scales` for the normalised kinds."""
    bias = species - geo
    return {"bias": bias, "norm_bias": (bias - F.col("_mb")) / F.col("_sb"), "norm_species": (species - F.col("_mo")) / F.col("_so"), "species": species, "logged": F.log1p(species)}[kind]


def inverse_objective(kind: str, out: Column, geo: Column) -> Column:
    """Species from a model's output."""
    return {"bias": out + geo, "norm_bias": out * F.col("_sb") + F.col("_mb") + geo, "norm_species": out * F.col("_so") + F.col("_mo"), "species": out, "logged": F.expm1(out)}[kind]
