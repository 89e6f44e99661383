"""Training, batch scoring and evaluation, and the user-defined metric surface."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from fairspark.functions.numeric import r6
from fairspark.functions.ordering import attach_row
from fairspark.operators import fairness as fair
from fairspark.session import stored

SEED = 42
TREE_KINDS = ("random_forest", "gradient_boosting")
#: Settings under which a tree kind is the same on weighted cells as on their rows (it counts no single rows).
CELL_SETTINGS = {"numTrees", "maxIter", "maxDepth", "maxBins", "stepSize", "impurity", "minInfoGain", "featureSubsetStrategy", "seed"}
#: Rows a cell must have on average before trees are fitted on cells.
ROWS_PER_CELL = 8
PARALLEL_FITS = 4
#: Rows of a file of the training table, which every step of a fit reads.
ROWS_PER_FILE = 500_000


def classifier(kind: str, n_rows: int | None = None, **settings):
    """An unfitted Spark ML classifier by name. The linear SVM has no probabilities.

    ``settings`` replace the parameters given here.
    """
    common = {"labelCol": "y_true", "featuresCol": "features"}
    if kind == "logistic_regression":
        return LogisticRegression(**{**common, "maxIter": 1000, "regParam": 1.0 / n_rows if n_rows else 0.0, **settings})
    if kind == "random_forest":
        return RandomForestClassifier(**{**common, "numTrees": 100, "seed": SEED, **settings})
    if kind == "gradient_boosting":
        return GBTClassifier(**{**common, "maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "seed": SEED, **settings})
    if kind == "svm":
        return LinearSVC(**{**common, **settings})
    raise ValueError(f"unknown model {kind!r}; use logistic_regression, random_forest, gradient_boosting or svm")


def train(df: DataFrame, features: Sequence[str], kind: str = "logistic_regression", written: bool = False, **settings) -> PipelineModel:
    """Assemble, scale and fit on ``y_true``; nulls count as 0.

    Counting, scaling and fitting read the rows several times, so label and features are written once;
    ``written`` tells that ``df`` is such a file already.
    """
    rows = df if written else stored(df.select("y_true", *features), "training", ROWS_PER_FILE)
    return train_kinds(rows, features, {kind: settings})[kind]


def train_kinds(rows: DataFrame, features: Sequence[str], kinds: Mapping[str, Mapping]) -> dict[str, PipelineModel]:
    """Models of several kinds, each with its settings, fitted on the same written rows.

    All share one scaling. A tree sees its rows only as bins of the features, so where the bins
    leave many rows to a cell, the tree kinds share one unscaled table of cells with their row counts; else they read the rows.
    """
    clean = rows.fillna(0, subset=list(features))
    n, session = clean.count(), rows.sparkSession
    cells, on_rows, on_cells = {}, {}, {}
    for kind, settings in kinds.items():
        whole = classifier(kind, n, **settings)
        if kind in TREE_KINDS and set(settings) <= CELL_SETTINGS:
            bins = whole.getMaxBins()
            if bins not in cells:
                cells[bins] = _cells(clean, features, n, bins)
            if cells[bins] is not None:
                on_cells[kind] = cells[bins]
                continue
        on_rows[kind] = whole

    def fit_on_rows() -> dict[str, PipelineModel]:
        assembler = VectorAssembler(inputCols=list(features), outputCol="raw_features")
        scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
        scaling = Pipeline(stages=[assembler, scaler]).fit(clean)
        scaled = _scaled(clean, features, scaling.stages[-1])
        return {kind: PipelineModel([*scaling.stages, whole.fit(scaled)]) for kind, whole in on_rows.items()}

    def fit_on_cells() -> dict[str, PipelineModel]:
        return {kind: _train_on_cells(*found, kind, kinds[kind]) for kind, found in on_cells.items()}

    # The short jobs of the cells run beside the passes over the rows; rows are held for one kind at a time.
    groups = [fit for fit, members in ((fit_on_rows, on_rows), (fit_on_cells, on_cells)) if members]
    with ThreadPool(len(groups)) as pool:
        parts = pool.map(lambda fit: fit(), [inheritable_thread_target(session)(fit) for fit in groups])
    fitted = {kind: model for part in parts for kind, model in part.items()}
    return {kind: fitted[kind] for kind in kinds}


def _scaled(clean: DataFrame, features: Sequence[str], scaler: StandardScalerModel) -> DataFrame:
    """Label and scaled features as the fitted stages give them, by plain columns and one vector per row instead of two."""
    factors = zip(features, scaler.mean, scaler.std)
    columns = [((F.col(f) - float(m)) * (1.0 / float(s) if s else 0.0)).alias(f) for f, m, s in factors]
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return assembler.transform(clean.select("y_true", *columns)).select("y_true", "features")


def _thresholds(clean: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Per feature at most ``bins - 1`` cuts: between all values where they are few, else at the quantiles of all rows."""
    shares = [i / bins for i in range(1, bins)]
    seen = clean.agg(*[F.approx_count_distinct(f) for f in features], *[F.min(f) for f in features]).first()
    distinct, least = seen[: len(features)], seen[len(features) :]
    # The count is approximate: around the limit both are taken, and the collected set decides.
    values = [F.sort_array(F.collect_set(f)).alias(f"set {f}") for f, d in zip(features, distinct) if d <= 1.2 * bins]
    quantiles = [F.percentile_approx(f, shares, 10_000).alias(f"cut {f}") for f, d in zip(features, distinct) if d >= 0.8 * bins]
    found = clean.agg(*values, *quantiles).first().asDict()
    cuts = []
    for f, low in zip(features, least):
        own = found.get(f"set {f}", [])
        between = [(a + b) / 2 for a, b in zip(own, own[1:])] if len(own) <= bins else []
        cuts.append(sorted(set(between) or {v for v in found.get(f"cut {f}", []) if v > low}) or [low])
    return cuts


def _cells(clean: DataFrame, features: Sequence[str], n: int, bins: int) -> tuple[list, DataFrame] | None:
    """Binning stages and the written cells (label, bins, ``n_rows``), or nothing where cells can be nearly as many as rows.

    At most the product of the bins in number, whatever the number of rows.
    """
    if n <= ROWS_PER_CELL * 2 ** (len(features) + 1):
        return None
    cuts = _thresholds(clean, features, bins)
    if n <= ROWS_PER_CELL * 2 * math.prod(len(c) + 1 for c in cuts):
        return None
    names = [f"__bin_{f}" for f in features]
    splits = [[-math.inf, *c, math.inf] for c in cuts]
    binner = Bucketizer(inputCols=list(features), outputCols=names, splitsArray=splits)
    counted = binner.transform(clean).groupBy("y_true", *names).agg(F.count("*").cast("double").alias("n_rows"))
    return [binner, VectorAssembler(inputCols=names, outputCol="features")], stored(counted, "cells")


def _train_on_cells(stages: list, cells: DataFrame, kind: str, settings: Mapping) -> PipelineModel:
    """The tree kind on cells weighted by their rows: the trees that the rows themselves give with the same bins."""
    assembler, bins = stages[-1], stages[-1].getInputCols()
    if kind == "gradient_boosting":
        model = classifier(kind, weightCol="n_rows", **settings).fit(assembler.transform(cells))
        return PipelineModel([*stages, model])
    whole = classifier(kind, **settings)
    n_trees, seed = whole.getNumTrees(), whole.getSeed()
    subset = whole.getFeatureSubsetStrategy()
    if subset == "auto":  # which is every feature for a single tree
        subset = "sqrt" if n_trees > 1 else "all"
    drawn = stored(_bootstrap(cells, ["y_true", *bins], n_trees, seed), "bootstrap")

    def one(tree: int):
        sample = assembler.transform(drawn).select("y_true", "features", F.col("draws")[tree].alias("weight"))
        alone = {**settings, "numTrees": 1, "bootstrap": False, "featureSubsetStrategy": subset, "seed": seed + tree}
        return classifier(kind, weightCol="weight", **alone).fit(sample)

    with ThreadPool(PARALLEL_FITS) as pool:
        trees = pool.map(inheritable_thread_target(cells.sparkSession)(one), range(n_trees))
    sizes = [len(splits) - 1 for splits in stages[0].getSplitsArray()]
    return PipelineModel([stages[0], Forest(trees, assembler, sizes, cells.sparkSession)])


def _bootstrap(cells: DataFrame, keys: Sequence[str], n_trees: int, seed: int) -> DataFrame:
    """``draws``: per tree how often the rows of a cell are drawn.

    A row is drawn a Poisson(1) number of times, so the rows of a cell together Poisson(``n_rows``) times.
    The numbers depend on cell and seed only, not on partitions or retries.
    """
    schema = StructType([*cells.schema.fields, StructField("draws", ArrayType(DoubleType()))])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = zip(pdf.pop("__cell"), pdf["n_rows"])
            draws = [np.random.default_rng([seed, cell % 2**64]).poisson(rows, n_trees).astype(float) for cell, rows in pairs]
            yield pdf.assign(draws=draws)

    return cells.withColumn("__cell", F.xxhash64(*keys)).mapInPandas(draw, schema)


class Forest(Model):
    """Trees fitted one by one on their own bootstrap weights; a row's class shares are the mean over the trees.

    They depend on the row's cell only, so all cells are scored once into a written table that rows look up.
    """

    def __init__(self, trees: Sequence[Model], assembler: VectorAssembler, sizes: Sequence[int], spark: SparkSession):
        super().__init__()
        named = enumerate(trees)
        self.trees = [t.setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"__tree_{i}") for i, t in named]
        self.bins = list(zip(assembler.getInputCols(), sizes, (math.prod(sizes[:i]) for i in range(len(sizes)))))
        cells = spark.range(math.prod(sizes)).withColumnRenamed("id", "__cell")
        place = {name: (F.floor(F.col("__cell") / step) % size).cast("double") for name, size, step in self.bins}
        scored = assembler.transform(cells.withColumns(place))
        for tree in self.trees:
            scored = tree.transform(scored)
        shares = [vector_to_array(t.getProbabilityCol()) for t in self.trees]
        mean = [sum(s[k] for s in shares) / len(shares) for k in range(self.trees[0].numClasses)]
        self.shares = stored(scored.select("__cell", F.array(*mean).alias("__shares")), "shares")

    @property
    def featureImportances(self) -> DenseVector:
        total = np.sum([t.featureImportances.toArray() for t in self.trees], axis=0)
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cell = sum((F.col(name) * step for name, _, step in self.bins), F.lit(0)).cast("bigint")
        first = F.array_position("__shares", F.array_max("__shares")) - 1
        out = dataset.withColumn("__cell", cell).join(self.shares, "__cell", "left").drop("__cell")
        return out.withColumns({"probability": array_to_vector("__shares"), "prediction": first.cast("double")}).drop("__shares")


def score(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``y_pred`` and ``y_prob`` columns; one-hot of the prediction without probabilities."""
    out = model.transform(df.fillna(0, subset=list(features)))
    has_prob = "probability" in out.columns
    prob = vector_to_array("probability")[1] if has_prob else F.col("prediction")
    return out.withColumn("y_prob", prob).withColumn("y_pred", F.col("prediction")).drop(
        "raw_features", "features", "rawPrediction", "probability", "prediction", *[f"__bin_{f}" for f in features]
    )


def score_with(model, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Batch scoring with any object that has ``predict`` and maybe ``predict_proba``.

    The model is broadcast once per executor; rows stream through in Arrow batches.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names, kept = list(features), list(keep)
    schema = df.select(*kept).schema.add("y_pred", "double").add("y_prob", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for pdf in batches:
            x = pdf[names].fillna(0).to_numpy(dtype=float)
            pred = np.asarray(fitted.predict(x), dtype=float)
            prob = np.asarray(fitted.predict_proba(x))[:, 1] if hasattr(fitted, "predict_proba") else pred
            yield pdf[kept].assign(y_pred=pred, y_prob=prob)

    return df.select(*dict.fromkeys([*kept, *names])).mapInPandas(run, schema)


@dataclass
class LinearModel:
    """Logistic model from plain coefficients, in the ``predict`` / ``predict_proba`` shape."""

    weights: list[float]
    bias: float = 0.0

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        p = 1.0 / (1.0 + np.exp(-(x @ np.asarray(self.weights) + self.bias)))
        return np.column_stack([1.0 - p, p])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.predict_proba(x)[:, 1] >= 0.5).astype(int)


def feature_importance(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Importances (trees) or abs coefficients (linear) as ``(feature, importance, rank)``."""
    fitted = model.stages[-1]
    values = fitted.featureImportances if hasattr(fitted, "featureImportances") else fitted.coefficients
    scores = sorted(((f, abs(float(v))) for f, v in zip(features, values.toArray())), key=lambda x: (-x[1], x[0]))
    rows = [(f, v, i + 1) for i, (f, v) in enumerate(scores)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, importance_rank int")


def evaluate(scored: DataFrame) -> DataFrame:
    """Confusion metrics with ROC and PR AUC of a scored table, one row."""
    auc = fair.auc_scores(fair.roc_points(scored)).select("roc_auc", "pr_auc")
    return attach_row(fair.confusion_metrics(scored), auc)


def train_test_accuracy(train_scored: DataFrame, test_scored: DataFrame) -> DataFrame:
    parts = [
        d.select(F.lit(n).alias("part"), (F.col("y_true") == F.col("y_pred")).cast("double").alias("hit"))
        for n, d in (("train", train_scored), ("test", test_scored))
    ]
    return parts[0].unionByName(parts[1]).groupBy("part").agg(F.count("*").alias("n"), r6(F.avg("hit")).alias("accuracy"))


@dataclass
class GroupMetric:
    """A user-defined fairness metric.

    ``value`` is an aggregate expression over one group of decisions (``y_true``,
    ``y_pred`` and any other column); built-in expressions keep it partially
    aggregated, a grouped-aggregate pandas UDF is possible for small groups.
    """

    name: str
    value: Column
    threshold: float = 0.1
    columns: list[str] = field(default_factory=lambda: ["y_true", "y_pred"])

    def is_fair(self, gap: float) -> bool:
        return abs(gap) <= self.threshold

    def per_group(self, df: DataFrame, attribute: str) -> DataFrame:
        clean = df.dropna(subset=[*self.columns, attribute])
        return clean.groupBy(F.col(attribute).cast("string").alias("grp")).agg(r6(self.value).alias("group_value"))

    def compute(self, df: DataFrame, attribute: str) -> DataFrame:
        groups = self.per_group(df, attribute)
        gap = F.when(F.count("*") >= 2, F.max("group_value") - F.min("group_value")).otherwise(F.lit(0.0))
        return groups.agg(
            F.lit(attribute).alias("attribute"), F.lit(self.name).alias("metric"), F.count("*").alias("n_groups"),
            r6(gap).alias("gap"), (gap <= self.threshold).alias("is_fair"),
        )

    def compute_for_all(self, df: DataFrame, attributes: Sequence[str]) -> DataFrame:
        out = self.compute(df, attributes[0])
        for a in attributes[1:]:
            out = out.unionByName(self.compute(df, a))
        return out
