"""Contact prediction with pyspark.ml: logistic regression and a forest.

Fitting is iterative, so the prepared matrix is written to the shared folder once
and every pass reads that table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactscope.operators.features import (
    CATEGORICAL,
    NUMERIC,
    assemble,
    balanced_weights,
    booking_features,
    label_encode,
)
from contactscope.operators.metrics import ranking_metrics
from contactscope.operators.sampling import spread_sample, stratified_split
from contactscope.sources.tables import materialise

# Model settings and the most rows a model is fitted on.
SEED = 42
FIT_ROWS = 300_000
TEST_SHARE = 0.2
INVERSE_PENALTY = 0.5
MAX_ITERATIONS = 1000
TREES = 150
DEPTH = 7
LEAF_ROWS = 50

LEAST_BINS = 256  # split candidates per feature; more where a category has more levels

FEATURES = [*[f"{c}_enc" for c in CATEGORICAL], *NUMERIC]


def training_table(
    orders: DataFrame,
    rows: int | None = FIT_ROWS,
    seed: int = SEED,
    test_share: float = TEST_SHARE,
    key: str = "order_id",
) -> DataFrame:
    """Key, label, features, weight and ``is_test``: all held-out orders, and the rows to fit on.

    All orders are split. Of the training part at most ``rows`` are fitted on (None: all); the
    held-out part is whole. Levels are coded before the split, weights are balanced within the
    rows to fit on.
    """
    # Coding, splitting and weighting each count the rows again: read a table, not the links.
    coded = label_encode(materialise(booking_features(orders), "features"), CATEGORICAL)
    split = stratified_split(coded, "contacted", test_share, seed, [key])
    table = assemble(split, FEATURES).select(
        key, F.col("contacted").cast("double").alias("label"), "features", "is_test"
    )
    stored = materialise(table, "training")
    train = stored.where("is_test = 0")
    if rows is not None:
        train = materialise(spread_sample(train, rows, seed, [key]), "fit-rows")
    test = stored.where("is_test = 1").withColumn("weight", F.lit(1.0))
    return balanced_weights(train, "label").unionByName(test)


def fit_logistic(train: DataFrame, inverse_penalty: float = INVERSE_PENALTY) -> Model:
    """L2-penalised logistic regression on unscaled features, balanced classes.

    Spark divides the loss by the sum of weights, so the penalty is scaled likewise.
    """
    total = train.agg(F.sum("weight")).first()[0]
    return LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxIter=MAX_ITERATIONS,
        elasticNetParam=0.0,
        regParam=1.0 / (inverse_penalty * total),
        standardization=False,
    ).fit(train)


def fit_forest(train: DataFrame, trees: int = TREES, seed: int = SEED) -> Model:
    """Random forest whose prediction is the balanced share of contacted orders.

    A regression forest on the 0/1 label: variance and Gini choose the same splits,
    and leaves keep their own share where the classifier would merge them. Every level
    of a coded category can be a split.
    """
    values = vector_to_array("features")
    codes = F.when(F.size(values) == len(FEATURES), F.slice(values, 1, len(CATEGORICAL)))
    top = train.agg(F.max(F.array_max(codes))).first()[0]
    bins = max(LEAST_BINS, int(top or 0) + 2)
    return RandomForestRegressor(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        numTrees=trees,
        maxDepth=DEPTH,
        minInstancesPerNode=LEAF_ROWS,
        featureSubsetStrategy="sqrt",
        maxBins=bins,
        seed=seed,
    ).fit(train)


def score(model: Model, df: DataFrame, key: str = "order_id") -> DataFrame:
    """Key, label and the score of the positive class."""
    out = model.transform(df)
    if "probability" in out.columns:
        value = vector_to_array(F.col("probability"))[1]
    else:
        value = F.col("prediction")
    return out.select(key, F.col("label").cast("int").alias("label"), value.alias("score"))


def importances(model: Model, df: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Feature importances, one row per feature."""
    pairs = list(zip(names, [float(v) for v in model.featureImportances.toArray()]))
    rows = df.sparkSession.createDataFrame(pairs, "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature")


def top_importances(model: Model, df: DataFrame, k: int = 10) -> DataFrame:
    return importances(model, df).limit(k)


def compare_models(scored: dict[str, DataFrame]) -> DataFrame:
    """ROC area and average precision of each scored table."""
    out = None
    for name, df in scored.items():
        row = ranking_metrics(df).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@dataclass
class ContactModels:
    """Fitted models with the scored test part."""

    logistic: Model
    forest: Model
    table: DataFrame

    def scored(self) -> dict[str, DataFrame]:
        test = self.table.where("is_test = 1")
        return {
            "Logistic Regression": score(self.logistic, test),
            "Random Forest": score(self.forest, test),
        }


def fit_contact_models(orders: DataFrame, rows: int | None = FIT_ROWS) -> ContactModels:
    """Both models on one training table."""
    table = training_table(orders, rows)
    train = table.where("is_test = 0")
    return ContactModels(fit_logistic(train), fit_forest(train), table)
