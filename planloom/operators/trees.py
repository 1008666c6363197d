"""Tree ensembles of Spark ML, fitted for each fold."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import functions as F

from planloom.config import get_config
from planloom.operators.base import training
from planloom.plans.runtime import FOLD, Series, fresh


@dataclass(frozen=True)
class TreeRegressor:
    """``kind`` forest or boosted."""

    kind: str = "forest"
    trees: int = 20
    depth: int = 5
    seed: int = 42

    def _estimator(self):
        from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

        shared = {"featuresCol": "__x", "labelCol": "__y", "predictionCol": "__p", "maxDepth": self.depth, "seed": self.seed}
        return RandomForestRegressor(numTrees=self.trees, **shared) if self.kind == "forest" else GBTRegressor(maxIter=self.trees, **shared)

    @staticmethod
    def _vector(x):
        from pyspark.ml.functions import array_to_vector

        return array_to_vector(F.array(*[c.cast("double") for c in x.cols.values()])).alias("__x")

    def fit(self, x, y):
        df, keys = training(x.rows.with_all(y.rows))
        made = df.select(self._vector(x), y.col.cast("double").alias("__y"), *keys).persist()
        try:
            folds = sorted(r[FOLD] for r in made.select(FOLD).distinct().collect()) if keys else [0]
            with ThreadPoolExecutor(max(1, get_config().max_parallel_variants)) as pool:
                models = pool.map(lambda k: self._estimator().fit(made.where(F.col(FOLD) == k) if keys else made), folds)
                return dict(zip(folds, models, strict=True))
        finally:
            made.unpersist()

    def transform(self, state, x):
        name, vector = fresh("p"), self._vector(x)

        def predicted(df):
            df, out = df.withColumn("__x", vector), None
            for k, model in state.items():
                part = model.transform(df.where(F.col(FOLD) == k) if x.rows.split else df).drop("__x").withColumnRenamed("__p", name)
                out = part if out is None else out.unionByName(part)
            return out

        return Series(x.rows.extended(predicted), F.col(name), "prediction")


def RandomForestRegressor(trees: int = 20, depth: int = 5, seed: int = 42) -> TreeRegressor:
    return TreeRegressor("forest", trees, depth, seed)


def GradientBoostedRegressor(trees: int = 20, depth: int = 3, seed: int = 42) -> TreeRegressor:
    return TreeRegressor("boosted", trees, depth, seed)
