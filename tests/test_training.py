"""Trees on weighted cells against trees on their rows, and the split that evaluates its input once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from fairspark.operators import models
from fairspark.operators.prepare import stratified_split

FEATURES = ["a", "b", "rare"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 6, 4000) * 0.5, "b": rng.integers(0, 5, 4000) - 2.0, "rare": (rng.random(4000) < 0.01) * 1.0})
    z = pdf["a"] - 0.6 * pdf["b"] + rng.normal(size=4000) * 0.3 - 1.2
    pdf["y_true"] = np.where(pdf["rare"] == 1, z < 0, z > 0).astype(float)
    pdf["row_id"] = np.arange(4000)
    return models.stored(spark.createDataFrame(pdf), "rows")


def by_row(model, rows):
    return models.score(model, rows, FEATURES).toPandas().sort_values("row_id")


def test_boosted_trees_on_cells_equal_those_on_rows(rows, monkeypatch):
    read, plain = [], GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, df: read.append(df.count()) or plain(self, df))
    got = by_row(models.train(rows, FEATURES, "gradient_boosting", maxIter=4), rows)
    assert read[0] == rows.groupBy("y_true", *FEATURES).count().count() <= 120

    seen = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    whole = models.classifier("gradient_boosting", maxIter=4).fit(seen).transform(seen)
    want = whole.select("row_id", models.vector_to_array("probability")[1].alias("p"), "prediction").toPandas().sort_values("row_id")
    assert np.allclose(got["y_prob"], want["p"], atol=1e-9)
    assert (got["y_pred"].to_numpy() == want["prediction"].to_numpy()).all()


def test_forest_on_cells(rows, monkeypatch):
    read, plain = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: read.append(df.count()) or plain(self, df))
    model = models.train(rows, FEATURES, "random_forest", numTrees=5)
    got = by_row(model, rows)
    assert len(read) == 5 and max(read) <= 120
    assert len(got) == 4000 and list(got.columns) == [*rows.columns, "y_prob", "y_pred"]
    assert (got["y_pred"] == got["y_true"]).mean() > 0.9
    assert ((got["y_prob"] > 0.5) == (got["y_pred"] == 1)).all()
    assert models.feature_importance(model, rows, FEATURES).agg(F.sum("importance")).first()[0] == pytest.approx(1)

    forest = model.stages[-1]
    one = model.stages[0].transform(rows)
    names = list(model.stages[0].getOutputCols())
    seen = VectorAssembler(inputCols=names, outputCol="features").transform(one)
    each = [t.transform(seen).select("row_id", models.vector_to_array(t.getProbabilityCol())[1].alias("p")).toPandas().sort_values("row_id")["p"].to_numpy() for t in forest.trees]
    assert np.allclose(got["y_prob"], np.mean(each, axis=0), atol=1e-12)


def test_rows_of_a_cell_are_drawn_as_often_as_alone(spark):
    cells = spark.createDataFrame([(float(k % 2), float(k), 50.0 + k % 3) for k in range(400)], "y_true double, k double, n_rows double")
    draws = [np.array([r["draws"] for r in models._bootstrap(c, ["y_true", "k"], 30, 7).orderBy("k").collect()]) for c in (cells, cells.repartition(3))]
    assert (draws[0] == draws[1]).all()
    # A row drawn Poisson(1) times has variance 1, so a cell of n rows has mean and variance n.
    assert draws[0].mean() == pytest.approx(51, rel=0.02)
    assert draws[0][::3].var() == pytest.approx(50, rel=0.1)


def test_few_values_are_all_told_apart_and_many_by_quantiles(spark, rows):
    cuts = models._thresholds(rows, FEATURES, 32)
    assert cuts == [[0.25, 0.75, 1.25, 1.75, 2.25], [-1.5, -0.5, 0.5, 1.5], [0.5]]
    many = spark.range(10_000).select((F.col("id") * 1.0).alias("x"), F.lit(3.0).alias("same"))
    quantiles, constant = models._thresholds(many, ["x", "same"], 32)
    assert len(quantiles) == 31 and np.allclose(np.diff(quantiles), 312.5, atol=5) and constant == [3.0]


def test_few_rows_a_cell_are_fitted_as_rows(rows):
    model = models.train(rows.limit(60), FEATURES, "random_forest", numTrees=3)
    assert isinstance(model.stages[0], VectorAssembler)


def test_split_evaluates_its_input_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    once = stratified_split(rows.mapInPandas(count, rows.schema), "y_true", "row_id", once=True).select("row_id", "is_test").toPandas()
    assert seen.value == 4000
    twice = stratified_split(rows, "y_true", "row_id").select("row_id", "is_test").toPandas()
    assert once.sort_values("row_id").reset_index(drop=True).equals(twice.sort_values("row_id").reset_index(drop=True))


def test_training_table_is_written_in_small_files(spark):
    table = models.stored(spark.range(10).coalesce(1), "small", 3)
    assert len(table.inputFiles()) == 4 and table.count() == 10
    assert len(models.stored(spark.range(10).coalesce(1), "whole").inputFiles()) == 1
