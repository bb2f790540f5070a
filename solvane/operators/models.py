"""Fitting and scoring with MLlib: forests on fingerprints, kernel regression, cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from solvane.functions.hashing import hash32
from solvane.functions.kernels import Kernel
from solvane.operators.binning import with_balanced_bin
from solvane.operators.fingerprint import fingerprints, label_numbers
from solvane.operators.kernel import kernel_features, kernel_score
from solvane.operators.linear import moments
from solvane.operators.metrics import accuracy, ensemble_metrics, fold_summary, metrics_by, regression_metrics
from solvane.operators.ranking import before_key, keys_at_ranks
from solvane.operators.split import label_by_rank
from solvane.storage import cut, stage

MAX_DEPTH = 30


def as_vector(df: DataFrame, array: str, output: str = "features") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(array).cast("array<double>")))


def bit_vectors(df: DataFrame, bits: str, n_bits: int, output: str = "features") -> DataFrame:
    """Sparse 0/1 vectors from arrays of set-bit positions, whatever the number of bits."""
    names = CountVectorizerModel.from_vocabulary([str(i) for i in range(n_bits)], inputCol="_names", outputCol=output).setBinary(True).setMinTF(1.0)
    return names.transform(df.withColumn("_names", F.col(bits).cast("array<string>"))).drop("_names")


def _forest_params(params: dict, rows: int | None) -> dict:
    """Translate the usual forest parameter names to MLlib's.

    What MLlib cannot honour raises ValueError: a depth beyond 30, a split size above 2, a row count without ``rows``.
    """
    if (params.get("max_depth") or 0) > MAX_DEPTH:
        raise ValueError(f"max_depth {params['max_depth']} is beyond {MAX_DEPTH}")
    if params.get("min_samples_split", 2) != 2:
        raise ValueError("min_samples_split other than 2 is not supported")
    translated = {"seed": params.get("random_state", 0)}
    if "n_estimators" in params:
        translated["numTrees"] = int(params["n_estimators"])
    if params.get("max_depth") is not None:
        translated["maxDepth"] = int(params["max_depth"])
    if "min_samples_leaf" in params:
        translated["minInstancesPerNode"] = int(params["min_samples_leaf"])
    if "max_features" in params:
        translated["featureSubsetStrategy"] = str(params["max_features"])
    if "bootstrap" in params:
        translated["bootstrap"] = bool(params["bootstrap"])
    if params.get("max_samples") is not None:
        share = params["max_samples"]
        if not isinstance(share, float) and rows is None:
            raise ValueError("max_samples as a row count needs rows")
        translated["subsamplingRate"] = min(1.0, share if isinstance(share, float) else share / rows)
    return translated


def forest_regressor(params: dict, label: str = "measured", rows: int | None = None) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, predictionCol="predicted", **_forest_params(params, rows))


def forest_classifier(params: dict, label: str = "bin", rows: int | None = None) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, predictionCol="predicted", impurity="gini", **_forest_params(params, rows))


def run_trial(estimator: Estimator, df: DataFrame, phase: str = "ml_phase", label: str = "measured") -> tuple[Model, DataFrame]:
    """Fit on train and return the model with its metrics per phase."""
    model = estimator.fit(df.filter(F.col(phase) == "train"))
    return model, metrics_by(model.transform(df), [phase], label, "predicted")


def objective_value(metrics: DataFrame, metric: str = "mse", phase: str = "ml_phase") -> float:
    """The validation metric, or 0 if there is no validation set."""
    row = metrics.filter(F.col(phase) == "val").select(metric).first()
    return 0.0 if row is None else float(row[0])


def run_cv_trial(estimator: Estimator, df: DataFrame, id_col: str, folds: int, fold: str = "fold", label: str = "measured", extra: dict[str, DataFrame] | None = None):
    """One fit per fold: (models, summary per phase, ensemble metrics per data set).

    The summary has the mean, std and variance over folds of the train and test
    mse.  The ensemble scores the mean prediction of all fold models on the whole
    of ``df`` and on each data set in ``extra``.
    """
    models = [estimator.fit(df.filter(F.col(fold) != i)) for i in range(folds)]

    def predictions(data: DataFrame, columns: Sequence[str]) -> DataFrame:
        scored = None
        for i, model in enumerate(models):
            part = model.transform(data).select(*columns, "predicted", F.lit(i).alias("model"))
            scored = part if scored is None else scored.unionByName(part)
        return scored

    own = predictions(df, [id_col, label, fold])
    role = F.when(F.col(fold) == F.col("model"), "test").otherwise("train")
    scores = own.groupBy("model", role.alias("phase")).agg(regression_metrics(label, "predicted")[0])
    summary = fold_summary(scores, ["phase"], "mse")
    sets = {"train": own, **{name: predictions(data, [id_col, label]) for name, data in (extra or {}).items()}}
    ensemble = None
    for name, scored in sets.items():
        row = ensemble_metrics(scored, id_col, label, "predicted").withColumn("data", F.lit(name))
        ensemble = row if ensemble is None else ensemble.unionByName(row)
    return models, summary, ensemble


def grid_search(estimator: Estimator, grid: dict[str, list], df: DataFrame, fold: str = "fold", folds: int = 3, label: str = "measured", parallelism: int = 2) -> CrossValidatorModel:
    """Every combination of ``grid`` cross-validated on the given folds; the best is refitted."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    evaluator = RegressionEvaluator(labelCol=label, predictionCol="predicted", metricName="mse")
    search = CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=evaluator, numFolds=folds, foldCol=fold, parallelism=parallelism)
    return search.fit(df)


def grid_scores(search: CrossValidatorModel, grid: dict[str, list]) -> list[tuple[dict, float]]:
    """Parameter values beside the mean mse of each grid point."""
    names = list(grid)
    points = [{p.name: v for p, v in point.items() if p.name in names} for point in search.getEstimatorParamMaps()]
    return list(zip(points, search.avgMetrics))


def choose_landmarks(df: DataFrame, id_col: str, count: int, seed: int = 0) -> DataFrame:
    """``count`` rows drawn by hash."""
    keys = df.select(hash32(seed, id_col).alias("_hash"), id_col)
    cutoff = keys_at_ranks(keys, ["_hash", id_col], [count]).get(count)
    return df.filter(before_key([hash32(seed, id_col), F.col(id_col)], cutoff))


def classify_bins(df: DataFrame, id_col: str, target: str, bin_counts: Sequence[int], train_size: int, params: dict, seed: int = 0) -> DataFrame:
    """Forest accuracy on train and test for each number of balanced bins of the target."""
    split = stage(label_by_rank(df, id_col, [train_size], ["train", "test"], seed, "ml_phase"))
    result = None
    for bins in bin_counts:
        binned = with_balanced_bin(split, target, bins).filter("bin is not null")
        model = forest_classifier(params).fit(binned.filter("ml_phase = 'train'"))
        scored = model.transform(binned).groupBy("ml_phase").agg(accuracy("bin", "predicted")).withColumn("bins", F.lit(bins))
        result = scored if result is None else result.unionByName(scored)
    return result


def over_fingerprints(nodes: DataFrame, edges: DataFrame, settings: Sequence[dict], run: Callable[[DataFrame, dict], DataFrame]) -> DataFrame:
    """Results of ``run`` on the fingerprints of each setting, one after the other, with the setting beside them.

    Settings that differ in the number of bits alone fold the same labels, which are worked out and written once.
    """
    result, written = None, {}
    for setting in settings:
        labelled = {name: value for name, value in setting.items() if name not in ("kind", "n_bits")}
        key = tuple(sorted(labelled.items()))
        if key not in written:
            written[key] = stage(label_numbers(nodes, edges, **labelled), "numbers")
        part = run(fingerprints(nodes, edges, **setting, numbers=written[key]), setting)
        part = part.withColumns({name: F.lit(value) for name, value in setting.items()})
        result = part if result is None else result.unionByName(part)
    return result


class KernelRegression:
    """Linear regression with Huber loss on kernel values against landmark rows.

    A different estimator from a support vector machine: the landmarks play the
    part of support vectors and all rows take part in the fit.
    """

    def __init__(self, kernel: Kernel, features: list[str], landmarks: int = 64, reg: float = 1e-3, seed: int = 0):
        self.kernel, self.features, self.count, self.reg, self.seed = kernel, features, landmarks, reg, seed

    def fit(self, df: DataFrame, id_col: str, label: str) -> "KernelRegression":
        chosen = choose_landmarks(df.select(id_col, *self.features), id_col, self.count, self.seed)
        self.landmarks = cut(chosen.withColumnRenamed(id_col, "landmark"))
        train = self._featurise(df, id_col).select("features", F.col(label).cast("double").alias("label"))
        self.model = LinearRegression(loss="huber", regParam=self.reg, predictionCol="predicted").fit(train)
        return self

    def _featurise(self, df: DataFrame, id_col: str) -> DataFrame:
        values = kernel_features(df, id_col, self.landmarks, "landmark", self.kernel, self.features)
        return as_vector(df.join(values.withColumnRenamed("x_id", id_col), id_col), "values")

    def transform(self, df: DataFrame, id_col: str) -> DataFrame:
        return self.model.transform(self._featurise(df, id_col)).drop("features", "values")


class NystromRegression:
    """Kernel ridge regression in the space that the landmarks span.

    The landmarks' own kernel matrix is decomposed, and kernel values against
    them are whitened by it, so that products of the features are the kernel
    itself as far as the landmarks reach: with all rows as landmarks this is
    kernel ridge regression.  The loss is the mean squared error plus ``reg``
    times the squared norm of the function; with ``intercept`` a constant without a
    penalty is added.  The fit takes one aggregate of products of kernel
    values; the result is a weight for each landmark.
    """

    def __init__(self, kernel: Kernel, features: list[str], landmarks: int = 64, reg: float = 1e-3, seed: int = 0, intercept: bool = True):
        self.kernel, self.features, self.count, self.reg, self.seed, self.intercept = kernel, features, landmarks, reg, seed, intercept

    def fit(self, df: DataFrame, id_col: str, label: str) -> "NystromRegression":
        chosen = choose_landmarks(df.select(id_col, *self.features), id_col, self.count, self.seed)
        landmarks = cut(chosen.withColumnRenamed(id_col, "landmark"))
        own = kernel_features(landmarks, "landmark", landmarks, "landmark", self.kernel, self.features).orderBy("x_id").collect()  # a square of the landmarks
        values, vectors = np.linalg.eigh(np.array([row["values"] for row in own]))
        kept = values > values.max() * len(values) * np.finfo(float).eps
        whitened = vectors[:, kept] / np.sqrt(values[kept])
        rows = kernel_features(df, id_col, landmarks, "landmark", self.kernel, self.features).withColumnRenamed("x_id", id_col)
        found = moments(df.select(id_col, label).join(rows, id_col), "values", label)[None]
        fitted = found.mapped(whitened).fit(self.reg, self.intercept)
        self.offset, weights = float(fitted[0]), whitened @ fitted[1:]
        ids = [(row["x_id"], float(w)) for row, w in zip(own, weights, strict=True)]
        table = df.sparkSession.createDataFrame(ids, StructType([landmarks.schema["landmark"], StructField("weight", DoubleType())]))
        self.landmarks = cut(landmarks.join(table, "landmark"))
        return self

    def transform(self, df: DataFrame, id_col: str) -> DataFrame:
        scored = kernel_score(df, id_col, self.landmarks, "landmark", "weight", self.offset, self.kernel, self.features)
        return df.join(scored.withColumnRenamed("x_id", id_col), id_col)


def retrain_best(make: Callable[[dict], Estimator], params: dict, df: DataFrame, with_val: bool, phase: str = "ml_phase", label: str = "measured") -> tuple[Model, DataFrame, DataFrame]:
    """Fit the best parameters on train (and val): (model, predictions, metrics by set)."""
    fit_on = ["train", "val"] if with_val else ["train"]
    model = make(params).fit(df.filter(F.col(phase).isin(fit_on)))
    named = F.when(F.col(phase).isin(fit_on), "training set").when(F.col(phase) == "test", "test set").otherwise("validation set")
    scored = model.transform(df).withColumn("phase", named)
    return model, scored, metrics_by(scored, ["phase"], label, "predicted")


def apply_to(model: Model, df: DataFrame, phase: str = "ml_phase", label: str = "measured") -> DataFrame:
    """Metrics per phase of a fitted model on another data set."""
    return metrics_by(model.transform(df), [phase], label, "predicted")
