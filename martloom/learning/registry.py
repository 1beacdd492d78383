"""Model families by name."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame

from martloom.functions.values import col
from martloom.learning.boosting import STOPPING_ROUNDS, Watched

SEED = 42  # fixed value

CLASSIFIERS = {
    "logistic_regression": LogisticRegression,
    "decision_tree": DecisionTreeClassifier,
    "random_forest": RandomForestClassifier,
    "gradient_boosting": GBTClassifier,
    "linear_svm": LinearSVC,
    "naive_bayes": lambda **kw: NaiveBayes(modelType="gaussian", **kw),
    "perceptron": MultilayerPerceptronClassifier,
}
REGRESSORS = {
    "linear": LinearRegression,
    "ridge": lambda **kw: LinearRegression(**({"regParam": 1.0, "elasticNetParam": 0.0} | kw)),
    "lasso": lambda **kw: LinearRegression(**({"regParam": 1.0, "elasticNetParam": 1.0} | kw)),
    "elastic_net": lambda **kw: LinearRegression(**({"regParam": 1.0, "elasticNetParam": 0.5} | kw)),
    "decision_tree": DecisionTreeRegressor,
    "random_forest": RandomForestRegressor,
    "gradient_boosting": GBTRegressor,
}
TWO_CLASSES = ("gradient_boosting", "linear_svm")
# Names callers know boosted trees by. All train MLlib's boosted trees; the
# parameters are the rounds, learning rate and depth these names stand for by default.
BOOSTED = {
    "gradient_boosting": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3},
    "LGBMClassifier": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5},
    "LGBMRegressor": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5},
    "XGBClassifier": {"maxIter": 100, "stepSize": 0.299, "maxDepth": 6},
    "XGBRegressor": {"maxIter": 100, "stepSize": 0.299, "maxDepth": 6},
    "CatBoostClassifier": {"maxIter": 1000, "stepSize": 0.0637660026550293, "maxDepth": 6},
    "CatBoostRegressor": {"maxIter": 1000, "stepSize": 0.0637660026550293, "maxDepth": 6},
}
# Families that watch an evaluation set.
WATCHING = tuple(n for n in BOOSTED if n != "gradient_boosting")


def family(name: str, task: str):
    table = CLASSIFIERS if task == "binary_classification" else REGRESSORS
    return table["gradient_boosting" if name in BOOSTED else name]


def init_params(name: str) -> dict:
    """Parameters a family starts from."""
    return dict(BOOSTED.get(name, {}))


def fit_params(name: str, eval_set: DataFrame | None) -> dict:
    """What a family watches while it is fitted: the rows, and the rounds without gain it stops after."""
    if name in WATCHING and eval_set is not None:
        return {"watched": eval_set, "patience": STOPPING_ROUNDS}
    return {}


def make(
    name: str,
    task: str = "binary_classification",
    label: str = "label",
    features: str = "features",
    eval_set: DataFrame | None = None,
    **params,
) -> Estimator | Watched:
    """An estimator from its family name, start parameters and overrides.

    A family that watches `eval_set` stops early on it; the others take no notice.
    """
    if name == "perceptron" and "layers" not in params:
        raise ValueError("a perceptron needs `layers`: sizes from the number of features to the number of classes")
    settings = init_params(name) | params
    if isinstance(settings.get("featureSubsetStrategy"), int | float):
        settings["featureSubsetStrategy"] = str(settings["featureSubsetStrategy"])
    estimator = family(name, task)(featuresCol=features, labelCol=label, **settings)
    if estimator.hasParam("seed") and "seed" not in params:
        estimator.setSeed(SEED)
    watching = fit_params(name, eval_set)
    return Watched(estimator, rounds=settings["maxIter"], **watching) if watching else estimator


class EachAgainstTheRest:
    """One model a class of a label 0, 1, ..., each watching the evaluation set with its own class."""

    def __init__(self, n_classes: int, name: str, label: str, features: str, eval_set: DataFrame | None, params: dict):
        self.n_classes, self.name, self.label, self.features = n_classes, name, label, features
        self.eval_set, self.params = eval_set, params

    def fit(self, rows: DataFrame) -> Model:
        def own(df: DataFrame | None, i: int) -> DataFrame | None:
            return None if df is None else df.withColumn(self.label, (col(self.label) == i).cast("double"))

        models = [
            make(self.name, label=self.label, features=self.features, eval_set=own(self.eval_set, i), **self.params).fit(own(rows, i))
            for i in range(self.n_classes)
        ]
        one = family(self.name, "binary_classification")()
        frame = OneVsRest(classifier=one, labelCol=self.label, featuresCol=self.features)
        return frame._copyValues(OneVsRestModel(models=models))


def make_for_classes(
    name: str, n_classes: int, label: str = "label", features: str = "features", eval_set: DataFrame | None = None, **params
) -> Estimator | Watched | EachAgainstTheRest:
    """`make` for a label of `n_classes` values 0, 1, ...; families that know two classes go one against the rest."""
    if n_classes <= 2 or not (name in BOOSTED or name in TWO_CLASSES):
        return make(name, "binary_classification", label, features, eval_set, **params)
    return EachAgainstTheRest(n_classes, name, label, features, eval_set, params)


def baseline(label: str = "label", features: str = "features") -> Estimator:
    """One-vs-rest logistic regression."""
    return OneVsRest(classifier=LogisticRegression(), labelCol=label, featuresCol=features)
