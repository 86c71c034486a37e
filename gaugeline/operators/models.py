"""Model registry and the estimators that are not one ready-made class.

A model is a factory ``(seed, params) -> pyspark.ml Estimator`` over the columns ``features`` (vector), ``label``
and ``prediction``; any Estimator of that shape can be registered or passed directly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import trees
from gaugeline.operators.trees import Growth
from gaugeline.session import materialize

FEATURES, LABEL, PREDICTION = "features", "label", "prediction"


class Forest(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    """Average of regression trees (``gaugeline.operators.trees``): every value is a candidate cut, or one random cut per node and feature.

    ``drawn``: each tree sees a random draw of the rows. ``maxDepth`` 0 grows until a node's rows have one target value.
    """

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    splits = Param(Params._dummy(), "splits", "best or random", TypeConverters.toString)
    drawn = Param(Params._dummy(), "drawn", "whether each tree sees a random draw of the rows", TypeConverters.toBoolean)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of each tree, 0: no limit", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows on either side of a split", TypeConverters.toInt)

    def __init__(self, numTrees=20, splits="best", drawn=True, maxDepth=0, seed=42, minInstancesPerNode=1):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION)
        self._set(numTrees=numTrees, splits=splits, drawn=drawn, maxDepth=maxDepth, seed=seed, minInstancesPerNode=minInstancesPerNode)

    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    @property
    def growth(self) -> Growth:
        g = self.getOrDefault
        return Growth(g(self.numTrees), g(self.splits), g(self.drawn), g(self.maxDepth) or None, g(self.minInstancesPerNode), self.getSeed())

    def _fit(self, df: DataFrame) -> "ForestModel":
        rows = df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "x", "y"), "train")  # numbers are fixed by writing
        head = rows.select(F.size("x").alias("n")).first()
        if head is None:
            raise ValueError("no rows to fit on")
        upper, table = trees.pieces(rows, self.growth, head["n"])
        return ForestModel(upper, materialize(table, "trees"), self.getNumTrees(), head["n"], self.getFeaturesCol(), self.getPredictionCol())


class ForestModel(Model):
    """A fitted ensemble: the splits above its pieces, and a table of pieces."""

    SENT = 1 << 22  # nodes that are sent to every task at most (about 36 bytes each); larger ensembles are joined

    def __init__(self, upper, pieces: DataFrame, count: int, width: int, features: str = FEATURES, prediction: str = PREDICTION):
        super().__init__()
        self.upper, self.pieces, self.count, self.width, self.features, self.prediction = upper, pieces, count, width, features, prediction
        self._shared = None

    def _transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        if self._shared is None and (self.pieces.agg(F.sum(F.size("feature"))).first()[0] or 0) <= self.SENT:
            found = {(p["tree"], p["node"]): trees.trees_of(p) for p in self.pieces.collect()}
            self._shared = spark.sparkContext.broadcast((self.upper, found))
        values = vector_to_array(self.features)
        if self._shared is not None:
            return df.withColumn(self.prediction, trees.sent_scorer(self._shared, self.count)(values))
        if df.isStreaming:
            raise ValueError(f"an ensemble of more than {self.SENT} nodes scores tables only")
        rows = materialize(df.withColumns({"_n": F.monotonically_increasing_id(), "_x": values}), "asked")
        scores = trees.joined_scores(rows.select(F.col("_n").alias("row"), F.col("_x").alias("x")), self.upper, self.pieces, self.width, self.count)
        return rows.join(scores.select(F.col("row").alias("_n"), F.col("predict").alias(self.prediction)), "_n").select(*df.columns, self.prediction)

    def save(self, path: str) -> None:
        self.pieces.write.mode("overwrite").parquet(f"{path}/pieces")

    def about(self) -> dict:
        splits = [[[n, f, c] for n, (f, c) in tree.items()] for tree in self.upper.splits]
        return {"splits": splits, "count": self.count, "width": self.width}

    @classmethod
    def load(cls, path: str, about: dict, spark: SparkSession) -> "ForestModel":
        upper = trees.Upper([{n: (f, c) for n, f, c in tree} for tree in about["splits"]])
        return cls(upper, spark.read.schema(trees.PIECE).parquet(f"{path}/pieces"), about["count"], about["width"])


def _forest(numTrees=20, maxDepth=0, minInstancesPerNode=1, seed=42) -> Forest:
    return Forest(numTrees, "best", True, maxDepth, seed, minInstancesPerNode)


def _extra_trees(numTrees=20, maxDepth=0, minInstancesPerNode=1, seed=42) -> Forest:
    return Forest(numTrees, "random", False, maxDepth, seed, minInstancesPerNode)


@dataclass(frozen=True)
class ModelKind:
    """A named model: how to make its estimator, and whether features are standardised first."""

    name: str
    step: str
    make: object
    scaled: bool = False
    params: dict = field(default_factory=dict)

    def estimator(self) -> Estimator:
        return self.make(**self.params)

    def growth(self) -> Growth | None:
        """How the model's trees grow; None for a model that is not made of them."""
        made = self.estimator()
        return made.growth if isinstance(made, Forest) else None

    def with_params(self, **params) -> "ModelKind":
        return ModelKind(self.name, self.step, self.make, self.scaled, {**self.params, **params})


REGISTRY: dict[str, ModelKind] = {
    kind.name: kind
    for kind in (
        ModelKind("RF", "rf", _forest),
        ModelKind("RF_SC", "rf", _forest, scaled=True),
        ModelKind("ET", "et", _extra_trees),
        ModelKind("ET_SC", "et", _extra_trees, scaled=True),
    )
}

# Parameter names users of the scikit-learn spelling give, and ours.
PARAM_NAMES = {
    "n_estimators": "numTrees",
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "random_state": "seed",
}


def register(name: str, make, step: str | None = None, scaled: bool = False) -> ModelKind:
    REGISTRY[name] = ModelKind(name, step or name.lower(), make, scaled)
    return REGISTRY[name]


def model_kind(name: str, settings: dict[str, int | str] | None = None) -> ModelKind:
    """Look a model up and set integer parameters given as ``step__parameter``, e.g. ``rf__n_estimators``."""
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; known: {sorted(REGISTRY)}")
    kind = REGISTRY[name]
    params = {}
    for key, value in (settings or {}).items():
        step, found, param = key.partition("__")
        if not found or step != kind.step:
            raise ValueError(f"{name} has no step for {key!r}; its step is {kind.step!r}")
        params[PARAM_NAMES.get(param, param)] = int(value)
    return kind.with_params(**params)


def seasonal_naive(features: DataFrame, history: str = "hist_1D") -> DataFrame:
    """Predict the value one season ago."""
    return features.withColumn("predict", F.col(history))
