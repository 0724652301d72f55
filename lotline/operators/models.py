"""Models on Spark ML: ridge and logistic, trees, boosted trees; freezing and scoring.

The linear pair equals its textbook closed form: regularisation is given per total weight. Boosted trees are an
approximation of histogram boosting: Spark's have no leaf penalty and other leaf values.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("linear", "tree", "boosted")


def medians(rows: DataFrame, features: tuple[str, ...]) -> dict[str, float]:
    """Interpolated median of each feature, 0 where it is never known."""
    row = rows.agg(*[F.percentile(F.col(f).cast("double"), F.lit(0.5)).alias(f) for f in features]).first()
    return {f: 0.0 if row[f] is None else float(row[f]) for f in features}


def imputed(rows: DataFrame, values: dict[str, float]) -> DataFrame:
    return rows.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(v)) for f, v in values.items()})


@dataclass
class CostModel:
    """A regressor of the pair cost and a classifier of favourable pairs over the same inputs."""

    features: tuple[str, ...]
    fill: dict[str, float]
    cost: PipelineModel
    favorable: PipelineModel

    def score(self, rows: DataFrame) -> DataFrame:
        """rows + predicted (cost) and probability (of a favourable pair)."""
        kept = rows.columns
        x = imputed(rows.select("*", *[F.col(f).alias(f"__raw_{f}") for f in self.features]), self.fill)
        x = self.cost.transform(x).drop("__x", "__z")
        x = self.favorable.transform(x)
        back = [F.col(f"__raw_{c}").alias(c) if c in self.features else F.col(c) for c in kept]
        return x.select(*back, F.col("__cost").alias("predicted"), vector_to_array("__p")[1].alias("probability"))

    def freeze(self, folder: str) -> str:
        """Saves both parts with the hash of every file; returns the manifest's path."""
        self.cost.write().overwrite().save(f"{folder}/cost")
        self.favorable.write().overwrite().save(f"{folder}/favorable")
        manifest = {"features": list(self.features), "fill": self.fill, "files": hashes(folder)}
        path = os.path.join(folder, "manifest.json")
        with open(path, "w", encoding="utf-8") as file:
            json.dump(manifest, file, sort_keys=True, indent=1)
        return path


def hashes(folder: str) -> dict[str, str]:
    out = {}
    for top, _, names in os.walk(folder):
        for name in names:
            if name != "manifest.json" and not name.endswith(".crc"):
                path = os.path.join(top, name)
                with open(path, "rb") as file:
                    out[os.path.relpath(path, folder)] = hashlib.sha256(file.read()).hexdigest()
    return dict(sorted(out.items()))


def load_frozen(spark: SparkSession, folder: str, features: tuple[str, ...] | None = None) -> CostModel:
    """Fails closed: any file changed, lost or added, or another order of features, is an error."""
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as file:
        manifest = json.load(file)
    if manifest["files"] != hashes(folder):
        raise ValueError("frozen model files differ from their manifest")
    if features is not None and list(features) != manifest["features"]:
        raise ValueError("features differ from the frozen order")
    return CostModel(tuple(manifest["features"]), manifest["fill"], PipelineModel.load(f"{folder}/cost"), PipelineModel.load(f"{folder}/favorable"))


def train(rows: DataFrame, features: tuple[str, ...], kind: str = "linear", weight: str = "paired_shares") -> CostModel:
    """Fits both parts on rows with pair_cost, favorable and a weight; missing inputs get the median."""
    fill = medians(rows, features)
    x = imputed(rows, fill).select(*features, F.col("pair_cost").cast("double").alias("__y"), F.col("favorable").cast("double").alias("__b"), F.col(weight).cast("double").alias("__w"))
    columns = {"labelCol": "__y", "weightCol": "__w", "predictionCol": "__cost", "featuresCol": "__z"}
    binary = {"labelCol": "__b", "weightCol": "__w", "predictionCol": "__class", "probabilityCol": "__p", "featuresCol": "__z"}
    one_class = x.agg(F.count_distinct("__b")).first()[0] < 2
    if kind == "linear":
        total, spread = x.agg(F.sum("__w"), F.sqrt(F.sum(F.col("__w") * F.col("__y") ** 2) / F.sum("__w") - (F.sum(F.col("__w") * F.col("__y")) / F.sum("__w")) ** 2)).first()
        # alpha = 1 and C = 1 on standardised inputs, in Spark's scale of a mean loss
        a = LinearRegression(**columns, regParam=(spread or 0.0) / total, elasticNetParam=0.0, standardization=False, solver="normal")
        b = LogisticRegression(**binary, regParam=1.0 / total, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10)
    elif kind == "tree":
        a = DecisionTreeRegressor(**columns, maxDepth=3, minInstancesPerNode=100, maxBins=256)
        b = DecisionTreeClassifier(**binary, maxDepth=3, minInstancesPerNode=100, maxBins=256)
    elif kind == "boosted":
        a = GBTRegressor(**columns, maxDepth=3, maxIter=100, stepSize=0.05, minInstancesPerNode=100, maxBins=256, seed=1)
        b = GBTClassifier(**{k: v for k, v in binary.items() if k != "probabilityCol"}, maxDepth=3, maxIter=100, stepSize=0.05, minInstancesPerNode=100, maxBins=256, seed=1)
    else:
        raise ValueError(f"kind is one of {KINDS}")
    if one_class:
        b = LogisticRegression(**binary, maxIter=1)
    scale = lambda: [VectorAssembler(inputCols=list(features), outputCol="__x"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True)]
    if kind == "boosted" and not one_class:
        b.setProbabilityCol("__p")
    x = x.persist()
    try:
        return CostModel(tuple(features), fill, Pipeline(stages=[*scale(), a]).fit(x), Pipeline(stages=[*scale(), b]).fit(x))
    finally:
        x.unpersist()
