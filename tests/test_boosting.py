"""The boosted pool against plain arithmetic on its own trees."""

import datetime

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from marketloom.operators import model, ranking

X = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(6)
    out = []
    for i in range(300):
        for s in "uvw":
            a, b = r.normal(), r.normal()
            y = a - b + r.normal() * 0.7
            out.append((s, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), float(a), float(b) if i % 50 else None, 0 if y < -0.5 else 2 if y > 0.5 else 1, float(y)))
    return spark.createDataFrame(out, "symbol string, Date date, a double, b double, label int, fwd_ret double").coalesce(2)


@pytest.fixture(scope="module")
def folds(rows):
    return ranking.walk_forward(rows, 100, 50)


def test_roles_of_dates(rows, folds):
    spans = folds.orderBy("fold").collect()
    assert len(spans) == 4
    got = {r.Date: (r["_valid"], r["_weight"]) for r in model.fold_roles(rows, folds).select("Date", "_valid", "_weight").distinct().collect()}
    want = {}
    for r in rows.select("Date").distinct().collect():
        n = sum(f.train_start <= r.Date <= f.train_end for f in spans[:-1])
        valid = spans[-1].test_start <= r.Date <= spans[-1].test_end
        if valid or n:
            want[r.Date] = (valid, 1.0 if valid else float(n))
    assert got == want


def test_boosting_stops_where_plain_losses_do(spark, rows, folds):
    rounds, step = 15, 0.4
    pool, metrics = model.boost_pool(rows, X, folds, rounds=rounds, step=step, depth=3)
    m = metrics.first()
    data = VectorAssembler(inputCols=X, outputCol="_x").transform(model.fold_roles(rows.dropna(subset=X), folds)).coalesce(1)
    valid = data.filter("_valid").select("_x", "label").toPandas()
    assert (m.n_train, m.n_valid) == (data.filter("NOT _valid").count(), len(valid))
    shares = []
    for k, mine in enumerate(pool.models):
        whole = GBTClassifier(featuresCol="_x", labelCol="_t", weightCol="_weight", maxIter=rounds, stepSize=step, maxDepth=3, seed=7).fit(data.filter("NOT _valid").withColumn("_t", (F.col("label") == k).cast("double")))
        y = np.where(valid.label == k, 1.0, -1.0)
        margin, losses, margins = np.zeros(len(y)), [], []
        for tree, w in zip(whole.trees, whole.treeWeights):
            margin = margin + w * np.array([tree.predict(x) for x in valid._x])
            margins.append(margin)
            losses.append(2 * np.log1p(np.exp(-2 * y * margin)).mean())
        stop = next((i for i in range(1, rounds) if losses[i] > min(losses[:i])), rounds)
        assert mine.getNumTrees == stop == pool.rounds[k]
        shares.append(1 / (1 + np.exp(-2 * margins[stop - 1])))
    assert min(pool.rounds) < rounds  # it did stop early
    p = np.stack(shares, axis=1)
    assert abs((p.argmax(axis=1) == valid.label).mean() - m.accuracy) < 1e-12 and m.mse is None and m.accuracy > 0.5
    scored = model.score_pool(rows, pool, X).filter("b is not null").join(model.fold_roles(rows, folds).filter("_valid").select("symbol", "Date"), ["symbol", "Date"])
    got = np.sort(scored.select("p_up").toPandas().p_up.to_numpy())
    assert np.allclose(got, np.sort((p / p.sum(axis=1, keepdims=True))[:, 2]), atol=1e-12)


def test_boosted_returns(rows, folds):
    pool, metrics = model.boost_pool(rows, X, folds, "fwd_ret", 0, 15, 0.4, 3)
    m = metrics.first()
    seen = pool.transform(model.fold_roles(rows.dropna(subset=X), folds).filter("_valid")).select("prediction", "fwd_ret").toPandas()
    assert abs(((seen.prediction - seen.fwd_ret) ** 2).mean() - m.mse) < 1e-12 and m.accuracy is None and m.mse < seen.fwd_ret.var()


def test_too_few_rows_train_nothing(rows, folds):
    pool, metrics = model.boost_pool(rows, X, folds, least=10 ** 6)
    assert pool is None and metrics.first().accuracy is None
    assert model.score_pool(rows, pool, X).filter("ml_score is not null").count() == 0
    assert model.boost_pool(rows.filter("Date < DATE '2020-02-01'"), X, folds)[0] is None
