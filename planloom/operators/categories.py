"""Encoders of categories: one-hot and target means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.operators.base import by_fold, per_fold, training
from planloom.plans.runtime import FOLD, Frame, fresh, quoted


@dataclass(frozen=True)
class OneHotEncoder:
    """A column of 0.0 and 1.0 for each category of the training rows, in order; unknown and null values are all zero.

    ``drop='if_binary'`` leaves the first of two categories out. More than ``max_columns`` categories of a column are an
    error here; one_hot_sparse has no such limit.
    """

    drop: str | None = None
    max_columns: int = 200

    def fit(self, x, y=None):
        if self.drop not in (None, "if_binary"):
            raise ValueError(f"drop must be None or 'if_binary', got {self.drop!r}")
        df, keys = training(x.rows)
        state = []
        for n, c in x.cols.items():
            folds = df.select(F.col(FOLD) if keys else F.lit(0).alias(FOLD), c.alias("v"))
            known: dict[int, list] = {}
            most = self.max_columns * max(1, folds.select(FOLD).distinct().count() if keys else 1)
            for r in folds.where("v is not null").distinct().limit(most + 1).collect():
                known.setdefault(r[FOLD], []).append(r["v"])
            if any(len(v) > self.max_columns for v in known.values()) or sum(map(len, known.values())) > most:
                raise ValueError(f"{n} has more than {self.max_columns} categories: use one_hot_sparse")
            state.append({k: sorted(v) for k, v in known.items()})
        return state

    def transform(self, state, x):
        out = {}
        for (n, c), known in zip(x.cols.items(), state, strict=True):
            kept = {k: v[1:] if self.drop == "if_binary" and len(v) == 2 else v for k, v in known.items()}
            for v in sorted({v for vs in kept.values() for v in vs}):
                one = F.when(c == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))
                inside = {k: float(v in vs) for k, vs in kept.items()}
                out[f"{n}_{v}"] = one if all(inside.values()) else one * by_fold(x.rows, inside)
        return Frame(x.rows, out)


def category_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, category, code): each column's categories in order, numbered on from one column to the next."""
    from pyspark.sql import Window

    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(quoted(c)).cast("string").alias("category")) for i, c in enumerate(columns)])).alias("v")).select("v.*").where("category is not null").distinct()
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy("feature").orderBy("category")) - 1)
    sizes = {r["feature"]: r["count"] for r in long.groupBy("feature").count().collect()}  # one row for each column
    offset, at = [], 0
    for i in range(len(columns)):
        offset.append(at)
        at += sizes.get(i, 0)
    return ranked.select("feature", "category", (F.element_at(F.array(*map(F.lit, offset)), F.col("feature") + 1) + F.col("rank")).cast("bigint").alias("code"))


def one_hot_sparse(df: DataFrame, row_id: str, columns: list[str], categories: DataFrame | None = None) -> DataFrame:
    """(row_id, col, value): the ones of the one-hot matrix; categories may be those of other rows."""
    table = category_table(df, columns) if categories is None else categories
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(quoted(c)).cast("string").alias("category")) for i, c in enumerate(columns)]))
    return df.select(F.col(quoted(row_id)).alias("row_id"), cells.alias("v")).select("row_id", "v.*").join(table, ["feature", "category"]).select("row_id", F.col("code").alias("col"), F.lit(1.0).alias("value"))


@dataclass(frozen=True)
class TargetEncoder:
    """Each category's mean of y in the training rows; others, and null, have the mean of all."""

    def fit(self, x, y):
        rows = x.rows.with_all(y.rows)
        df, keys = training(rows)
        overall = {k: r["m"] for k, r in per_fold(rows, [F.avg(y.col).alias("m")]).items()}
        tables = []
        for c in x.cols.values():
            key, mean, fold = fresh("k"), fresh("m"), fresh("f")
            means = df.groupBy(*keys, c.alias(key)).agg(F.avg(y.col).alias(mean)).where(F.col(key).isNotNull())
            tables.append((means.withColumnRenamed(FOLD, fold), key, mean, fold))
        return overall, tables

    def transform(self, state, x):
        overall, tables = state
        rows, out = x.rows, {}
        for (n, c), (means, key, mean, fold) in zip(x.cols.items(), tables, strict=True):

            def looked_up(df, c=c, means=means, key=key, fold=fold):
                same = c == F.col(key)
                return df.join(means, same & (F.col(FOLD) == F.col(fold)) if x.rows.split else same, "left").drop(key, fold)

            rows = rows.extended(looked_up)
            out[n] = F.coalesce(F.col(mean), by_fold(x.rows, overall))
        return Frame(rows, out)
