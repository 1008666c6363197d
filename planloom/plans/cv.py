"""Cross-validation, hold-out evaluation and grid search: all variants and folds of a search are scored by one query."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.config import get_config
from planloom.functions.scalar import ieee_divide
from planloom.plans.nodes import Node, Op, to_dot, walk
from planloom.plans.rewrite import optimize
from planloom.plans.runtime import FOLD, TEST, Context, Frame, Rows, Series, frame
from planloom.plans.search import expand
from planloom.sources import with_row_id


@dataclass(frozen=True)
class KFold:
    """Folds of rows by a column: ``mod`` takes its remainder, ``hash`` its hash, ``block`` equal runs in its order."""

    splits: int = 5
    key: str | None = None
    method: str = "hash"

    def __post_init__(self):
        if self.splits < 2:
            raise ValueError("at least 2 folds are needed")
        if self.method not in ("mod", "hash", "block") or self.method != "hash" and not self.key:
            raise ValueError("method must be 'mod', 'hash' or 'block', and all but 'hash' need a key")

    def part(self, rows: Rows, cols: dict[str, Column]) -> tuple[DataFrame, Column]:
        df = rows.df()
        if self.method == "block":
            df = with_row_id(df.withColumn("__key", cols[self.key]), ["__key"]).drop("__key")
            n = df.count()
            size, more = divmod(n, self.splits)
            edge = more * (size + 1)  # the first folds have one row more
            at = F.col("__row_id")
            return df, F.when(at < edge, F.floor(at / (size + 1))).otherwise(F.floor((at - edge) / max(size, 1)) + more).cast("int")
        keys = [cols[self.key]] if self.key else list(cols.values())
        return df, F.pmod(keys[0] if self.method == "mod" else F.xxhash64(*keys), F.lit(self.splits)).cast("int")

    def __call__(self, rows: Rows, cols: dict[str, Column]) -> Rows:
        df, part = self.part(rows, cols)
        each = df.withColumn("__part", part).withColumn(FOLD, F.explode(F.array(*map(F.lit, range(self.splits)))))
        held = df.withColumn(FOLD, part).where(F.col(FOLD).isNotNull()).withColumn(TEST, F.lit(True)).drop("__row_id")
        return Rows(each.withColumn(TEST, F.col(FOLD) == F.col("__part")).drop("__part", "__row_id"), split=True, held=held, folds=self.splits)


@dataclass(frozen=True)
class Holdout:
    """One split; a row is a test row by the hash of its key and the seed."""

    test_size: float = 0.25
    seed: int = 0
    key: str | None = None

    def __call__(self, rows: Rows, cols: dict[str, Column]) -> Rows:
        keys = [cols[self.key]] if self.key else list(cols.values())
        at = F.pmod(F.xxhash64(F.lit(self.seed), *keys), F.lit(1_000_000))
        return Rows(rows.df().withColumn(FOLD, F.lit(0)).withColumn(TEST, at < int(self.test_size * 1_000_000)), split=True)


@dataclass(frozen=True)
class ModuloHoldout:
    """One split; test rows have a key that ``every`` divides."""

    every: int
    key: str

    def __call__(self, rows: Rows, cols: dict[str, Column]) -> Rows:
        return Rows(rows.df().withColumn(FOLD, F.lit(0)).withColumn(TEST, F.pmod(cols[self.key], F.lit(self.every)) == 0), split=True)


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r2(y: Column, p: Column) -> Column:
    return 1 - ieee_divide(F.avg((y - p) * (y - p)), F.var_pop(y))


def rmsle(y: Column, p: Column) -> Column:
    """Predictions below 0 count as 0."""
    d = F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(y)
    return F.sqrt(F.avg(d * d))


#: name -> (metric, whether more is better). Scores are the metric itself, without a sign.
SCORERS: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {
    "mse": (mse, False), "neg_mean_squared_error": (mse, False), "rmse": (rmse, False), "neg_root_mean_squared_error": (rmse, False),
    "mae": (mae, False), "neg_mean_absolute_error": (mae, False), "r2": (r2, True), "rmsle": (rmsle, False),
}


@dataclass(frozen=True)
class Scorer:
    """A metric of one's own: ``metric(y, prediction)`` is an aggregate."""

    metric: Callable[[Column, Column], Column]
    greater_is_better: bool = True


def scorer(scoring: Any) -> tuple[Callable[[Column, Column], Column], bool]:
    if scoring is None:
        return SCORERS["mse"]
    if isinstance(scoring, Scorer):
        return scoring.metric, scoring.greater_is_better
    if scoring not in SCORERS:
        raise ValueError(f"unknown scoring {scoring!r}: expected one of {', '.join(SCORERS)}")
    return SCORERS[scoring]


@dataclass(frozen=True)
class SearchResult:
    """``results``: (id, scores), best first. ``fold_scores``: (id, fold, score). ``predictions``: (id, fold, y_true, y_pred)."""

    results: DataFrame
    fold_scores: DataFrame
    predictions: DataFrame | None
    heavy_hitters: list[tuple[str, float, int]]


def _marks(root: Node) -> tuple[Node | None, Node | None]:
    found = {n.params[1].value: n for n in reversed(list(walk(root))) if n.kind == "mark"}
    return found.get("X"), found.get("y")


def _predicted(spark: SparkSession, plan: Op | Node, splitter, environment: dict) -> tuple[list[tuple[list[str], DataFrame]], Context]:
    """Test rows with fold, and y and p of each variant by its number, one table for all variants of the same rows, and their ids.

    All are lowered with one memo, so equal sub-plans are one, and variants whose rows are the same are read together.
    """
    ctx = Context(spark, dict(environment or {}), splitter)
    groups: dict[Any, list[tuple[str, Rows, Column, Column]]] = {}
    for variant, root in expand(plan):
        root = optimize(root)
        x, y = _marks(root)
        if x is None or y is None:
            raise RuntimeError("X and y nodes not found in the DAG")
        if not get_config().cse:
            ctx.memo, ctx.states = {}, {}
        ctx.run(root)
        pred = frame(ctx.in_mode("predict").run(root))
        target = frame(ctx.run(y))
        p, t = pred.series(next(iter(pred.cols))), target.series(next(iter(target.cols)))
        rows = p.rows.with_all(t.rows)
        groups.setdefault(id(rows.base), []).append((variant, rows, t.col.cast("double"), p.col.cast("double")))
    out = []
    for found in groups.values():
        rows = found[0][1]
        for _, more, _, _ in found[1:]:
            rows = rows.with_all(more)
        values = [c.alias(f"{n}{i}") for i, (_, _, t, p) in enumerate(found) for n, c in (("y", t), ("p", p))]
        out.append(([v for v, *_ in found], rows.test().select(F.col(FOLD).alias("fold"), *values)))
    return out, ctx


def _stacked(ids: list[str], rows: DataFrame, fields: Callable[[int], list[Column]], *more: str) -> DataFrame:
    """Rows of (id, *more, *fields) for each row and variant."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("id"), *fields(i)) for i, v in enumerate(ids)]))
    found = rows.select(*more, each.alias("v"))
    return found.select("v.id", *more, *[f"v.{c}" for c in found.schema["v"].dataType.names if c != "id"])


def _pairs(ids: list[str], rows: DataFrame, *more: str) -> DataFrame:
    return _stacked(ids, rows, lambda i: [F.col(f"y{i}").alias("y_true"), F.col(f"p{i}").alias("y_pred")], *more)


def heavy_hitters(times: dict[str, list[float]], top: int) -> list[tuple[str, float, int]]:
    """(node, seconds, calls), the longest first."""
    return sorted(((n, sum(s), len(s)) for n, s in times.items()), key=lambda r: -r[1])[:top]


def grid_search(spark: SparkSession, plan: Op | Node, cv: Any = None, scoring: Any = None, environment: dict | None = None, return_predictions: bool = False) -> SearchResult:
    """Scores every combination of a plan's choices under cross-validation."""
    metric, greater = scorer(scoring)
    if get_config().debug_graph:
        print(to_dot(plan))
    parts, ctx = _predicted(spark, plan, KFold(5 if cv is None else cv) if cv is None or isinstance(cv, int) else cv, environment)
    tagged = _union([_pairs(ids, df, "fold") for ids, df in parts])
    of_fold = [(ids, df.groupBy("fold").agg(*[metric(F.col(f"y{i}"), F.col(f"p{i}")).alias(f"s{i}") for i in range(len(ids))])) for ids, df in parts]
    scored = _union([_stacked(ids, df, lambda i: [F.col(f"s{i}").alias("score")], "fold") for ids, df in of_fold])
    if get_config().stats:  # then scoring counts too; it gives a row for each variant and fold
        began, schema = time.perf_counter(), scored.schema
        scored = spark.createDataFrame(scored.collect(), schema)
        ctx.times.setdefault("score", []).append(time.perf_counter() - began)
    results = scored.groupBy("id").agg(F.avg("score").alias("scores"))
    hitters = heavy_hitters(ctx.times, get_config().stats_top_k)
    if get_config().stats:
        print("Heavy hitters\n" + "\n".join(f"{n:<40} {s:.3f} s {c}" for n, s, c in hitters))
    return SearchResult(results.orderBy(F.desc("scores") if greater else "scores", "id"), scored, tagged if return_predictions else None, hitters)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate(spark: SparkSession, plan: Op | Node, split: Any = None, environment: dict | None = None) -> Any:
    """The test rows' predictions of every variant under a hold-out split; without marks, each variant's value by its id."""
    root = plan.node if isinstance(plan, Op) else plan
    if not any(n.kind == "mark" for n in walk(root)):
        ctx = Context(spark, dict(environment or {}))
        return {v: ctx.run(optimize(p)) for v, p in expand(root)}
    parts, _ = _predicted(spark, root, split or Holdout(), environment)
    return _union([_pairs(ids, df) for ids, df in parts])


def value(spark: SparkSession, plan: Op | Node, environment: dict | None = None, preview: bool = False) -> Any:
    """A plan's value: tables and columns as DataFrames, anything else as it is."""
    ctx = Context(spark, dict(environment or {}), preview=preview)
    out = ctx.run(optimize(plan))
    return out.df() if isinstance(out, (Frame, Series)) else out


def choice_table(spark: SparkSession, plan: Op | Node, environment: dict | None = None) -> DataFrame:
    """(id, vals) of scalar outcomes."""
    found = evaluate(spark, plan, environment=environment)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "id string, vals double")
