"""The ranking model of a pool: its features, training on pooled rows, scores and signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators import ranking


def pool_features(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All price, volume, range, volatility and calendar features, and strength against the benchmark on its dates."""
    out = ranking.volume_features(ranking.realized_vol(ranking.range_features(ranking.return_features(bars))))
    return ranking.calendar_features(ranking.relative_strength(out, benchmark))


def train_pool(rows: DataFrame, features: list[str], valid_from: str, trees: int = 20, depth: int = 5, least: int = 200) -> tuple[PipelineModel | None, DataFrame]:
    """A forest of three classes (label 0, 1, 2) on complete rows before valid_from; no model for fewer than `least` of them.

    The second value has one row: n_train, n_valid and the accuracy on the rows from valid_from on (null without a model).
    """
    complete = rows.dropna(subset=[*features, "label"]).withColumn("label", F.col("label").cast("double"))
    early, late = complete.filter(F.col("Date") < F.lit(valid_from).cast("date")), complete.filter(F.col("Date") >= F.lit(valid_from).cast("date"))
    n = early.count()
    if n < least:
        return None, late.agg(F.lit(n).cast("long").alias("n_train"), F.count("*").alias("n_valid"), F.lit(None).cast("double").alias("accuracy"))
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), forest]).fit(early)
    seen = model.transform(late).agg(F.lit(n).cast("long").alias("n_train"), F.count("*").alias("n_valid"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
    return model, seen


@dataclass
class BoostedPool:
    """Boosted trees: one model a class, or one for a return; each holds the rounds that its validation rows bore out."""

    features: list[str]
    models: list[Model]

    @property
    def rounds(self) -> list[int]:
        return [m.getNumTrees for m in self.models]

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with prediction, and of classes with probability: what the models give each class, as shares of their sum."""
        out = VectorAssembler(inputCols=self.features, outputCol="_x").transform(rows)
        if len(self.models) == 1:
            return self.models[0].transform(out).drop("_x")
        own = [f"_p{k}" for k in range(len(self.models))]
        for c, model in zip(own, self.models):
            out = model.transform(out).withColumn(c, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
        total = sum((F.col(c) for c in own[1:]), F.col(own[0]))
        shares = F.array(*[F.col(c) / total for c in own])
        best = F.array_position(shares, F.array_max(shares)).cast("double") - 1
        return out.withColumns({"probability": array_to_vector(shares), "prediction": best}).drop("_x", *own)


def fold_roles(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """rows with _valid (in the test span of the last fold) and _weight: how many of the training spans before hold its date.

    The last fold trains nothing, unless it is the only one. Rows in no span go, and so do validation dates from training. folds
    has a row a fold (see walk_forward), as many as the calendar has; its dates are counted once and joined by Date.
    """
    folds = folds.withColumns({"_last": F.col("fold") == F.max("fold").over(Window.partitionBy()), "_only": F.count("*").over(Window.partitionBy()) == 1})
    dates = rows.select("Date").distinct().join(F.broadcast(folds), F.col("Date").between(F.col("train_start"), F.col("test_end")))
    trains = F.col("Date").between(F.col("train_start"), F.col("train_end")) & (~F.col("_last") | F.col("_only"))
    tests = F.col("Date").between(F.col("test_start"), F.col("test_end")) & F.col("_last")
    roles = dates.groupBy("Date").agg(F.max(tests).alias("_valid"), F.count_if(trains).cast("double").alias("_weight"))
    return rows.join(roles.filter("_valid OR _weight > 0").withColumn("_weight", F.when(F.col("_valid"), 1.0).otherwise(F.col("_weight"))), "Date")


def boost_pool(rows: DataFrame, features: list[str], folds: DataFrame, target: str = "label", classes: int = 3, rounds: int = 2000, step: float = 0.05, depth: int = 5, least: int = 200) -> tuple[BoostedPool | None, DataFrame]:
    """Boosted trees on the training spans of all folds but the last, stopped early on the last fold's test span.

    target holds classes 0, 1, .. (one model a class against the others), or with classes = 0 a return. A model grows until a
    round no longer lowers the loss on the validation rows, at most to `rounds`. Rows without all features and a target are left
    out; rows that several spans hold weigh as often.

    The second value has one row: n_train, n_valid, rounds (a number a model), accuracy (of classes) and mse (of returns) on
    the validation rows. No model, and nulls, for fewer than `least` training rows or no validation row.
    """
    held = fold_roles(rows.dropna(subset=[*features, target]), folds).withColumn("_y", F.col(target).cast("double"))
    n_train, n_valid = held.agg(F.count_if(~F.col("_valid")), F.count_if("_valid")).first()
    spark, shape = rows.sparkSession, "n_train long, n_valid long, rounds array<int>, accuracy double, mse double"
    if n_train < least or not n_valid:
        return None, spark.createDataFrame([(n_train, n_valid, None, None, None)], shape)
    data = VectorAssembler(inputCols=features, outputCol="_x").transform(held).select("_x", "_y", "_weight", "_valid").persist()
    common = {"featuresCol": "_x", "labelCol": "_t", "weightCol": "_weight", "validationIndicatorCol": "_valid", "maxIter": rounds, "stepSize": step, "maxDepth": depth, "validationTol": 0.0, "seed": 7}
    if classes:
        models = [GBTClassifier(**common).fit(data.withColumn("_t", (F.col("_y") == k).cast("double"))) for k in range(classes)]
    else:
        models = [GBTRegressor(**common).fit(data.withColumn("_t", F.col("_y")))]
    data.unpersist()
    pool = BoostedPool(features, models)
    seen = pool.transform(held.filter("_valid"))
    right = F.avg((F.col("prediction") == F.col("_y")).cast("double")) if classes else F.lit(None).cast("double")
    apart = F.lit(None).cast("double") if classes else F.avg((F.col("prediction") - F.col("_y")) ** 2)
    accuracy, mse = seen.agg(right, apart).first()
    return pool, spark.createDataFrame([(n_train, n_valid, pool.rounds, accuracy, mse)], shape)


def score_pool(rows: DataFrame, model: PipelineModel | BoostedPool | None, features: list[str], buy: float = 0.5, sell: float = 0.5) -> DataFrame:
    """p_down, p_flat, p_up, ml_score (p_up) and ml_signal (b, s, n; s wins). Rows without all features, and all rows without a model, keep nulls."""
    names = ("p_down", "p_flat", "p_up")
    if model is None:
        return rows.withColumns({c: F.lit(None).cast("double") for c in (*names, "ml_score")} | {"ml_signal": F.lit(None).cast("string")})
    whole = F.lit(True)
    for c in features:
        whole = whole & F.col(c).isNotNull()
    filled = rows.withColumns({"_whole": whole} | {f"_f_{c}": F.col(c) for c in features}).fillna(0.0, subset=features)
    p = F.when(F.col("_whole"), vector_to_array("probability"))
    out = model.transform(filled).withColumns({c: p[i] for i, c in enumerate(names)} | {c: F.col(f"_f_{c}") for c in features})
    signal = F.when(~F.col("_whole"), None).when(F.col("p_down") >= sell, "s").when(F.col("p_up") >= buy, "b").otherwise("n")
    return out.withColumns({"ml_score": F.col("p_up"), "ml_signal": signal}).select(*rows.columns, *names, "ml_score", "ml_signal")
