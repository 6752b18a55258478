"""Walk-forward learning, calibration and scoring with Spark ML."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squallbars.operators import folds
from squallbars.operators.layout import running_totals
from squallbars.operators.metrics import best_threshold
from squallbars.session import shared, shared_dir

col = F.col


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` = rows / (classes * rows of the class), from one count per class."""
    counts = df.groupBy(col(label).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"), F.sum("n").alias("all"),
                       F.count(F.lit(1)).alias("classes"))
    weights = table.select(F.transform_values("m", lambda k, n: col("all") / (col("classes") * n))).scalar()
    return df.withColumn("weight", F.element_at(weights, col(label).cast("string")))


MISSING = -1e6


def _assembler(features: Sequence[str]) -> Pipeline:
    """Feature vectors of all rows: a missing value stands below every other, where trees can split it off."""
    filled = ", ".join(f"coalesce(nullif(CAST(`{c}` AS DOUBLE), double('NaN')), {MISSING}D) AS `_in_{c}`" for c in features)
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
                            VectorAssembler(inputCols=[f"_in_{c}" for c in features], outputCol="features", handleInvalid="error")])


def binary_learner(features: Sequence[str], label: str, **params) -> Pipeline:
    options = {"maxIter": 10, "maxDepth": 4, "seed": 7} | params
    return Pipeline(stages=[_assembler(features), GBTClassifier(labelCol=label, weightCol="weight", **options)])


def class_learner(features: Sequence[str], label: str, **params) -> Pipeline:
    options = {"numTrees": 20, "maxDepth": 5, "seed": 7} | params
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc")
    return Pipeline(stages=[_assembler(features), index,
                            RandomForestClassifier(labelCol="_label", weightCol="weight", **options)])


def ordinal_learner(features: Sequence[str], label: str, **params) -> Pipeline:
    options = {"maxIter": 10, "maxDepth": 4, "seed": 7} | params
    return Pipeline(stages=[_assembler(features), GBTRegressor(labelCol=label, **options)])


def walk_forward(rows: DataFrame, on: str, bounds: Column, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Out-of-fold predictions: ``fit`` on each fold's training rows scores its validation rows, which get its number.

    Every row is written once, by the cell that fold borders cut it into, and a fold reads the files of its cells. Folds are
    few; every fit and every scoring runs on the cluster. Folds missing either role are left out.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    celled = folds.with_cells(rows, on, bounds)
    celled.write.partitionBy("cell").parquet(path)
    stored = spark.read.schema(celled.schema).parquet(path)
    used: dict[int, dict[str, list[int]]] = {}
    for r in folds.fold_cells(stored, on, bounds).select("fold", "role", "cell").collect():
        used.setdefault(r["fold"], {}).setdefault(r["role"], []).append(r["cell"])
    out = None
    for k in sorted(f for f, roles in used.items() if len(roles) == 2):
        train, val = (stored.filter(col("cell").isin(used[k][role])).drop("cell") for role in ("train", "val"))
        part = fit(train)(val.withColumn("fold", F.lit(k)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold has both training and validation rows")
    return out


def fit_binary(features: Sequence[str], label: str, **params):
    def fit(train: DataFrame):
        model = binary_learner(features, label, **params).fit(balanced_weights(train, label))
        return lambda df: model.transform(df).withColumn("prob", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction")

    return fit


def fit_classes(features: Sequence[str], label: str, **params):
    def fit(train: DataFrame):
        model = class_learner(features, label, **params).fit(balanced_weights(train, label))
        names = IndexToString(inputCol="prediction", outputCol="predicted", labels=model.stages[1].labels + ["OTHER"])

        def score(df: DataFrame) -> DataFrame:
            scored = names.transform(model.transform(df))
            own = F.get(vector_to_array("probability"), col("_label").cast("int"))
            return scored.withColumn("prob_true", own).drop("features", "rawPrediction", "probability", "prediction", "_label")

        return score

    return fit


def fit_ordinal(features: Sequence[str], label: str, top: int, **params):
    def fit(train: DataFrame):
        model = ordinal_learner(features, label, **params).fit(train)
        return lambda df: (model.transform(df).withColumnRenamed("prediction", "y_continuous").drop("features")
                           .withColumn("y_rounded", F.least(F.greatest(F.rint("y_continuous"), F.lit(0.0)), F.lit(float(top))).cast("int")))

    return fit


def fit_quantiles(features: Sequence[str], label: str, quantiles: Sequence[float] = (0.1, 0.5, 0.9), bins: int = 200,
                  **params):
    """Quantile regression forest (Meinshausen 2006) on a Spark forest.

    A leaf keeps the share of its training rows in each of ``bins`` bins of equal rank of the target (equal values share one),
    so a leaf's summary does not grow with the data; a prediction averages the summaries of its leaves over the trees.
    """
    options = {"numTrees": 15, "maxDepth": 5, "seed": 7} | params

    def fit(train: DataFrame):
        train = shared(train)
        forest = Pipeline(stages=[_assembler(features), RandomForestRegressor(labelCol=label, leafCol="_leaf", **options)])
        model = forest.fit(train)
        ranked = running_totals(train, [], label, {"n": F.count(F.lit(1))})
        starts = ranked.groupBy(F.floor((col("cum_n") - col("n")) * bins / col("total_n")).alias("b")).agg(F.min(label).alias("cut"))
        cuts = starts.agg(F.slice(F.array_sort(F.collect_list("cut")), 2, bins)).scalar()
        place = F.size(F.filter(col("_cuts"), lambda c: c <= col(label)))
        binned = model.transform(train).withColumn("_cuts", cuts).select(
            place.alias("bin"), col(label).alias("y"), F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))
        cells = binned.groupBy("tree", "leaf", "bin").agg(F.count(F.lit(1)).alias("n"))
        leaf = cells.groupBy("tree", "leaf").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"),
                                                 F.sum("n").alias("all"))
        shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at(
            F.col("m"), b), F.lit(0)) / col("all"))
        table = shared(leaf.select("tree", "leaf", shares.alias("shares")))
        means = shared(binned.filter("tree = 0").groupBy("bin").agg(F.avg("y").alias("y")).agg(
            F.map_from_entries(F.collect_list(F.struct("bin", "y"))).alias("v")))

        def score(df: DataFrame) -> DataFrame:
            scored = model.transform(df).withColumn("_leaf", vector_to_array("_leaf")).withColumn("_path", F.array_join("_leaf", ":"))
            # Rows that end in the same leaves of all trees share one sum, so leaf summaries meet paths, not rows.
            paths = scored.groupBy("_path").agg(F.first("_leaf").alias("_leaf")).select("_path", F.posexplode("_leaf").alias("tree", "leaf"))
            zero = F.array_repeat(F.lit(0.0), bins)
            own = F.array_sort(F.collect_list(F.struct("tree", "shares")))
            mass = paths.join(table, ["tree", "leaf"]).groupBy("_path").agg(F.aggregate(
                own, zero, lambda acc, s: F.zip_with(acc, s["shares"], lambda a, b: a + b)).alias("_mass"))
            names = [f"pred_q{q}".replace("0.", "") for q in quantiles]
            outs = [_mass_quantile(q, bins, options["numTrees"]).alias(n) for q, n in zip(quantiles, names, strict=True)]
            found = mass.withColumn("_v", means.scalar()).select("_path", *outs)
            return scored.join(found, "_path").select(*df.columns, *names)

        return score

    return fit


def _mass_quantile(q: float, bins: int, trees: int) -> Column:
    """Mean of the first bin at which the accumulated mass reaches q."""
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0).alias("i"), F.lit(-1).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["m"] + x
        reached = (acc["hit"] < 0) & (total >= q * trees - 1e-9)
        return F.struct(total.alias("m"), (acc["i"] + 1).alias("i"), F.when(reached, acc["i"]).otherwise(acc["hit"]).alias("hit"))

    return F.aggregate(col("_mass"), start, step, lambda acc: F.element_at(
        col("_v"), F.when(acc["hit"] < 0, bins - 1).otherwise(acc["hit"])))


def calibrate(oof: DataFrame, y: str, p: str, method: str = "isotonic") -> Callable[[DataFrame], DataFrame]:
    """Calibrator fitted on out-of-fold rows, adding ``calibrated``.

    Rows are first combined to one weighted point per score, which leaves the isotonic fit unchanged.
    """
    points = oof.groupBy(col(p).cast("double").alias("score")).agg(F.avg(col(y).cast("double")).alias("rate"),
                                                                   F.count(F.lit(1)).cast("double").alias("weight"))
    if method == "isotonic":
        model = IsotonicRegression(featuresCol="score", labelCol="rate", weightCol="weight").fit(points)
        return lambda df: (model.transform(df.withColumn("score", col(p).cast("double")))
                           .withColumnRenamed("prediction", "calibrated"))
    if method != "sigmoid":
        raise ValueError("method must be isotonic or sigmoid")
    sides = points.select("score", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (col("rate") * col("weight")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), ((1 - col("rate")) * col("weight")).alias("weight")))).alias("s")).select("score", "s.*")
    model = Pipeline(stages=[_assembler(["score"]), LogisticRegression(labelCol="label", weightCol="weight")]).fit(
        sides.filter("weight > 0"))
    return lambda df: (model.transform(df.withColumn("score", col(p).cast("double")))
                       .withColumn("calibrated", vector_to_array("probability")[1])
                       .drop("features", "rawPrediction", "probability", "prediction"))


class BinaryForecast(NamedTuple):
    """Out-of-fold rows with ``prob`` and ``calibrated``, the calibrator, the threshold row, and a score by the final model."""

    oof: DataFrame
    calibrator: Callable[[DataFrame], DataFrame]
    threshold: DataFrame
    score: Callable[[DataFrame], DataFrame]


def binary_forecast(rows: DataFrame, on: str, bounds: Column, features: Sequence[str], label: str, method: str = "isotonic",
                    beta: float = 2.0, **params) -> BinaryForecast:
    """A binary task from folds to forecasts.

    Out-of-fold scores are calibrated on out-of-fold rows, the threshold is the best one of the calibrated scores, and the
    learner fitted on all rows scores new ones: ``calibrated`` and ``flag``, whether it reaches the threshold.
    """
    oof = shared(walk_forward(rows, on, bounds, fit_binary(features, label, **params)))
    calibrator = calibrate(oof, label, "prob", method)
    oof = shared(calibrator(oof).drop("score"))
    best = shared(best_threshold(oof, label, "calibrated", beta))
    final = fit_binary(features, label, **params)(rows)

    def score(df: DataFrame) -> DataFrame:
        scored = calibrator(final(df.withColumn("weight", F.lit(1.0)))).drop("score", "weight")
        return scored.withColumn("flag", col("calibrated") >= best.select("threshold").scalar())

    return BinaryForecast(oof, calibrator, best, score)


def save_and_score(model: PipelineModel, path: str, df: DataFrame) -> DataFrame:
    """Batch scoring with a stored model."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path).transform(df)


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Feature importances by name, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(col("importance").desc(), "feature")
