"""MLlib pipelines: preprocessing, clustering sweeps, regressors, classifiers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from math import ceil

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, functions as F

from .aggregate import regression_metrics
from .checkpoints import written

#: Lots that rows of equal features are pooled into, which the trees of a forest draw in place of rows.
LOTS = 16
#: Of a pooled row: how many rows it stands for, and their labels' squared deviations from its own.
WEIGHT, WITHIN = "_weight", "_within"

#: Rows of a partition of a fit that goes over them many times.
SHARE = 50_000


def pool(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows of equal ``features`` and ``by`` as LOTS rows at most, dealt by a hash of ``key``, with
    their number as WEIGHT, their mean ``label`` and its squared deviations as WITHIN; those without a label are left out.

    A regressor that is given the weights finds what it finds on all rows, as sums of labels and of
    products are the same: least squares to the rounding, trees to the split candidates and a
    forest to the draw, which takes a lot of equal rows at a time. Features of few values are
    fitted in memory and time that do not grow with the rows.
    """
    lot = F.pmod(F.xxhash64(*key), F.lit(LOTS)).alias("_lot")
    y = F.col(label).cast("double")
    sums = [F.count(y).cast("double").alias(WEIGHT), (F.var_pop(y) * F.count(y)).alias(WITHIN), F.avg(y).alias(label)]
    return written(df.where(y.isNotNull()).groupBy(*features, *by, lot).agg(*sums).drop("_lot"))


def pooled_mean(pooled: DataFrame, label: str) -> DataFrame:
    """(prediction): the mean label of all rows behind pooled ones."""
    return pooled.agg((F.sum(F.col(label) * F.col(WEIGHT)) / F.sum(WEIGHT)).alias("prediction"))


class PooledRmse(Evaluator):
    """The root mean squared error over the rows behind pooled ones."""

    def __init__(self, label: str):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        error = F.col("prediction") - F.col(self.label)
        return dataset.agg(F.sqrt(F.sum(error * error * F.col(WEIGHT) + F.col(WITHIN)) / F.sum(WEIGHT))).first()[0]

    def isLargerBetter(self) -> bool:
        return False


def standardise(columns: Sequence[str], out: str = "features") -> list[Estimator]:
    """Numbers to mean 0 and deviation 1 in one vector; the deviation is the sample's, larger
    than the population's by sqrt(n / (n - 1))."""
    return [VectorAssembler(inputCols=list(columns), outputCol=f"{out}_raw", handleInvalid="skip"), StandardScaler(inputCol=f"{out}_raw", outputCol=out, withMean=True)]


def one_hot(columns: Sequence[str]) -> list[Estimator]:
    """Every level a column, alphabetically; an unseen level falls in a slot of its own."""
    coded, hot = [f"{c}_code" for c in columns], [f"{c}_hot" for c in columns]
    return [
        StringIndexer(inputCols=list(columns), outputCols=coded, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=coded, outputCols=hot, dropLast=True, handleInvalid="keep"),
    ]


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, level, n): how often each slot of the one-hot codes is set."""
    model = Pipeline(stages=one_hot(columns)).fit(df)
    hot = model.transform(df).select(*(vector_to_array(f"{c}_hot").alias(c) for c in columns))
    levels = dict(zip(columns, model.stages[0].labelsArray))
    row = hot.agg(*(F.sum(F.col(c)[i]).alias(f"{c}_{i}") for c in columns for i in range(len(levels[c]))))
    items = (F.struct(F.lit(c).alias("column_name"), F.lit(v).alias("level"), F.col(f"{c}_{i}").cast("long").alias("n")) for c in columns for i, v in enumerate(levels[c]))
    return row.select(F.inline(F.array(*items)))


def rebuilt_correlations(model: PipelineModel, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) as the components of a pca() with all of them give it: the sum of loadings
    times variances, which is each pair's correlation if the components are right."""
    parts = loadings(model, df, columns).join(explained(model, df), "component")
    left, right = parts.select("component", F.col("feature").alias("a"), F.col("loading").alias("la"), "variance"), parts.select("component", F.col("feature").alias("b"), F.col("loading").alias("lb"))
    return left.join(right, "component").where("a <= b").groupBy("a", "b").agg((F.sum(F.col("la") * F.col("lb") * F.col("variance")) * len(columns)).alias("corr"))


def preprocessor(numeric: Sequence[str], categorical: Sequence[str]) -> list[Estimator]:
    parts = [*standardise(numeric, "scaled"), *(one_hot(categorical) if categorical else [])]
    return [*parts, VectorAssembler(inputCols=["scaled", *(f"{c}_hot" for c in categorical)], outputCol="features")]


def pca(columns: Sequence[str], k: int) -> Pipeline:
    """Centred and scaled first; the component scores are in ``scores``."""
    return Pipeline(stages=[*standardise(columns), PCA(k=k, inputCol="features", outputCol="scores")])


def explained(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(component, variance, cumulative) shares of a fitted pca()."""
    shares = model.stages[-1].explainedVariance.toArray().tolist()
    rows = [(i + 1, v, sum(shares[: i + 1])) for i, v in enumerate(shares)]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, cumulative double")


def loadings(model: PipelineModel, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    matrix = model.stages[-1].pc.toArray()
    rows = [(c, k + 1, float(matrix[i, k])) for i, c in enumerate(columns) for k in range(matrix.shape[1])]
    return df.sparkSession.createDataFrame(rows, "feature string, component int, loading double")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by hash of ``key`` to partitions of about SHARE rows, in its order, so that a fit
    of many rounds is shared by all cores though a small file is read as one partition, and
    starts from the same rows whatever the files."""
    n = max(1, ceil(df.count() / SHARE))
    return df.repartition(n, key).sortWithinPartitions(key)


def gmm(stages: Sequence[Estimator], k: int, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[*stages, GaussianMixture(k=k, seed=seed)])


def regressor(kind: str, numeric: Sequence[str], label: str, categorical: Sequence[str] = (), **params) -> Pipeline:
    """linear (normal equations), forest or boosted trees behind scaling and one-hot codes."""
    made = {"linear": LinearRegression, "forest": RandomForestRegressor, "boosted": GBTRegressor}[kind]
    extra = {"solver": "normal"} if kind == "linear" else {"seed": 42}
    return Pipeline(stages=[*preprocessor(numeric, categorical), made(featuresCol="features", labelCol=label, **extra | params)])


def classifier(numeric: Sequence[str], label: str, categorical: Sequence[str] = (), **params) -> Pipeline:
    return Pipeline(stages=[*preprocessor(numeric, categorical), RandomForestClassifier(featuresCol="features", labelCol=label, **{"seed": 42} | params)])


def search(pipeline: Pipeline, grid: Mapping[str, Sequence], judge: Evaluator, folds: int = 0, fold_col: str = "", parallelism: int = 2):
    """The pipeline's last stage over a grid, by folds or, with ``folds`` 0, by one split."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(pipeline.getStages()[-1].getParam(name), list(values))
    shared = {"estimator": pipeline, "estimatorParamMaps": builder.build(), "evaluator": judge, "parallelism": parallelism}
    if folds:
        return CrossValidator(numFolds=folds, seed=42, foldCol=fold_col, **shared)
    return TrainValidationSplit(trainRatio=0.8, seed=42, **shared)


def chosen(model, grid: Mapping[str, Sequence]) -> str:
    """The setting of a fitted search()'s best model, as text."""
    last = model.bestModel.stages[-1]
    return ", ".join(f"{name} {last.getOrDefault(last.getParam(name))}" for name in grid)


def majority_baseline(train: DataFrame, test: DataFrame, label: str, out: str = "prediction") -> DataFrame:
    """The training rows' commonest label, the smaller on ties, for every test row."""
    common = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    best = common.orderBy(F.desc("n"), label).limit(1).select(F.col(label).alias(out))
    return test.crossJoin(F.broadcast(best))


def importances(model: PipelineModel, transformed: DataFrame) -> DataFrame:
    """(feature, importance), largest first, with the expanded names of coded levels."""
    attributes = transformed.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attributes.values() for a in kind}
    values = model.stages[-1].featureImportances.toArray()
    rows = [(names.get(i, f"feature_{i}"), float(v)) for i, v in enumerate(values)]
    return transformed.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def ledger(model: PipelineModel, df: DataFrame, keep: Sequence[str], label: str) -> DataFrame:
    """Kept columns, truth and prediction of each row."""
    return model.transform(df).select(*keep, F.col(label).cast("double").alias("truth"), F.col("prediction"))


def per_target(train: DataFrame, test: DataFrame, targets: Sequence[str], make: Callable[[str], Pipeline]) -> DataFrame:
    """Metric rows of one model for each target column; targets that cannot be fitted are left out."""
    rows = []
    for target in targets:
        usable = train.where(F.col(target).isNotNull())
        if usable.isEmpty():
            continue
        found = make(target).fit(usable).transform(test.where(F.col(target).isNotNull()))
        rows.append(regression_metrics(found, target, "prediction").select(F.lit(target).alias("target"), "*"))
    return reduce(DataFrame.unionByName, rows)


def vector_columns(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """``df`` with a column for each entry of a vector."""
    array = vector_to_array(vector)
    return df.select("*", *(array[i].alias(n) for i, n in enumerate(names)))
