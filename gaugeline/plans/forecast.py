"""Fit a registered model on a feature table, keep it with its category codes, score tables and streams."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.functions.durations import canonical
from gaugeline.operators import clean, encode
from gaugeline.operators.models import FEATURES, LABEL, PREDICTION, ForestModel, ModelKind


@dataclass
class Forecaster:
    """A fitted model together with everything needed to turn raw feature rows into its input."""

    features: list[str]
    target: str
    kind: str
    contract: T.StructType  # names, order and types of the features
    codes: dict[str, DataFrame]
    scale: dict[str, list[float]]  # feature -> [mean, deviation]
    model: Model

    def conform(self, df: DataFrame) -> DataFrame:
        """Exactly the model's input columns; anything else in ``df`` is dropped."""
        return clean.conform(df, self.contract)

    def prepare(self, df: DataFrame) -> DataFrame:
        return _prepare(df, self.features, self.codes, self.scale)

    def transform(self, df: DataFrame) -> DataFrame:
        """Input plus ``predict``; rows with a null feature cannot be scored and are left out."""
        keep = df.columns
        marked = df.withColumn("_in", F.struct(*keep))
        scored = self.model.transform(self.prepare(marked))
        return scored.select(*[F.col("_in")[c].alias(c) for c in keep], F.col(PREDICTION).alias("predict"))

    def save(self, path: str, spark: SparkSession) -> None:
        forest = self.model.about() if isinstance(self.model, ForestModel) else None
        if forest:
            self.model.save(f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        for name, table in self.codes.items():
            table.write.mode("overwrite").parquet(f"{path}/codes/{name}")
        # Written last: a folder without it is not a complete model.
        about = {
            "features": self.features, "target": self.target, "kind": self.kind, "contract": self.contract.jsonValue(),
            "codes": sorted(self.codes), "scale": self.scale, "forest": forest,
        }
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "Forecaster":
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        if about["forest"]:
            model = ForestModel.load(f"{path}/model", about["forest"], spark)
        else:
            model = PipelineModel.load(f"{path}/model")
        codes = {name: spark.read.parquet(f"{path}/codes/{name}") for name in about["codes"]}
        contract = T.StructType.fromJson(about["contract"])
        return cls(about["features"], about["target"], about["kind"], contract, codes, about["scale"], model)


def _prepare(df: DataFrame, features: list[str], codes: dict, scale: dict, fitted_on: bool = False) -> DataFrame:
    if codes:
        df = encode.encode_strings(df, list(codes), codes, ["_in"], fitted_on)
    inputs = [
        (F.col(f).cast("double") - scale[f][0]) / scale[f][1] if f in scale else F.col(f).cast("double") for f in features
    ]
    df = df.select("*", *[c.alias(f"_f{i}") for i, c in enumerate(inputs)])
    parts = [f"_f{i}" for i in range(len(features))]
    known = df.dropna(subset=parts)
    return VectorAssembler(inputCols=parts, outputCol=FEATURES).transform(known).drop(*parts)


def fit(train: DataFrame, features: list[str], target: str, kind: ModelKind) -> Forecaster:
    """Fit on all complete rows; category codes come from the same rows. Runs jobs."""
    features = [canonical(f) for f in features]
    train = train.filter(F.col(target).isNotNull()).dropna(subset=features)
    text = encode.string_columns(train, features)
    codes = {c: encode.fit_codes(train, c) for c in text}
    contract = T.StructType([train.schema[f] for f in features])
    rows = train.withColumn("_in", F.struct(*features)).withColumn(LABEL, F.col(target).cast("double"))
    scale = {}
    if kind.scaled:
        coded = encode.encode_strings(rows, text, codes, ["_in"], True) if text else rows
        row = encode.fit_scale(coded, features).first()
        scale = {f: [row[f"{f}__mean"], row[f"{f}__std"]] for f in features}
    ready = _prepare(rows, features, codes, scale, True).select(FEATURES, LABEL)
    estimator = kind.estimator()
    model = estimator.fit(ready)
    if not isinstance(model, ForestModel):
        model = PipelineModel([model])
    return Forecaster(features, target, kind.name, contract, codes, scale, model)
