"""One registered query for each operator of the engine, with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations


from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import planloom as pl
from planloom.operators import categories, text
from planloom.plans import cv
from planloom.plans.cv import ModuloHoldout, choice_table, value
from planloom.plans.runtime import Frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op(spark: SparkSession, sf: str, name: str) -> pl.Op:
    return pl.table(read(spark, sf, name))


# scans


@query("SELECT r_regionkey, r_name FROM region")
def scan_frame(spark, sf):
    return value(spark, pl.table(read(spark, sf, "region").toPandas())[["r_regionkey", "r_name"]])


@query("SELECT n_nationkey, n_name FROM nation")
def scan_parquet(spark, sf):
    return value(spark, pl.scan("parquet", f"{sf}/nation.parquet")[["n_nationkey", "n_name"]])


@query("SELECT s_suppkey, s_acctbal * 2.5 AS v FROM supplier")
def scan_param(spark, sf):
    t = pl.scan("parquet", pl.param("path"))
    return value(spark, t.assign(v=t["s_acctbal"] * pl.param("factor"))[["s_suppkey", "v"]], {"path": f"{sf}/supplier.parquet", "factor": 2.5})


@query("SELECT (SELECT count(*) FROM nation) AS full_rows, CAST(7 AS BIGINT) AS preview_rows")
def preview_vs_full(spark, sf):
    plan = op(spark, sf, "nation").subsample(7)
    both = value(spark, plan).select(F.lit("full").alias("k")).unionAll(value(spark, plan, preview=True).select(F.lit("preview").alias("k")))
    return both.agg(F.sum(F.when(F.col("k") == "full", 1)).alias("full_rows"), F.sum(F.when(F.col("k") == "preview", 1)).alias("preview_rows"))


# columns


@query("SELECT o_orderkey, o_totalprice FROM orders")
def project_cols(spark, sf):
    return value(spark, op(spark, sf, "orders")[["o_orderkey", "o_totalprice"]])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def filter_mask(spark, sf):
    t = op(spark, sf, "orders")
    return value(spark, t[(t["o_totalprice"] > 100000) & (t["o_orderstatus"] == "F")][["o_orderkey", "o_totalprice"]])


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey FROM customer")
def rename_cols(spark, sf):
    return value(spark, op(spark, sf, "customer").rename(columns={"c_custkey": "id", "c_name": "name", "missing": "x"})[["id", "name", "c_nationkey"]])


@query("SELECT c_custkey, c_nationkey FROM customer")
def drop_cols(spark, sf):
    return value(spark, op(spark, sf, "customer").drop(["c_name", "c_acctbal"]).drop(columns=["c_mktsegment", "nothing"], errors="ignore"))


@query("SELECT p_partkey, p_retailprice * 2 AS twice, 'x' AS tag, CAST(p_size AS BIGINT) + 1 AS p_size FROM part")
def assign_derived(spark, sf):
    t = op(spark, sf, "part")
    return value(spark, t.assign(twice=t["p_retailprice"] * 2, tag="x", p_size=t["p_size"].astype("int") + 1)[["p_partkey", "twice", "tag", "p_size"]])


@query("SELECT (SELECT count(*) FROM nation) AS n_rows, CAST(3 AS BIGINT) AS n_columns")
def shape_of(spark, sf):
    return spark.createDataFrame([value(spark, op(spark, sf, "nation").shape)], "n_rows bigint, n_columns bigint")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / l_quantity AS a, floor(l_extendedprice / 7) AS b, ((l_linenumber - 4) % 3 + 3) % 3 AS c,
  l_discount + l_tax - 1 AS d, pow(l_discount, 3) AS e, CASE WHEN l_tax = 0 THEN 'Infinity'::DOUBLE ELSE 1 / l_tax END AS f FROM lineitem""")
def binop_arith(spark, sf):
    t = op(spark, sf, "lineitem")
    out = t.assign(a=t["l_extendedprice"] / t["l_quantity"], b=(t["l_extendedprice"] // 7), c=(t["l_linenumber"] - 4) % 3, d=t["l_discount"] + t["l_tax"] - 1, e=t["l_discount"] ** 3, f=1 / t["l_tax"])
    return value(spark, out[["l_orderkey", "l_linenumber", "l_quantity", "a", "b", "c", "d", "e", "f"]]).withColumn("b", F.col("b").cast("double"))


@query("SELECT o_orderkey, o_totalprice >= 50000 AS ge, o_orderstatus <> 'O' AS ne, o_totalprice < o_custkey AS lt, 100000 > o_totalprice AS gt FROM orders")
def binop_compare(spark, sf):
    t = op(spark, sf, "orders")
    return value(spark, t.assign(ge=t["o_totalprice"] >= 50000, ne=t["o_orderstatus"] != "O", lt=t["o_totalprice"] < t["o_custkey"], gt=100000 > t["o_totalprice"])[["o_orderkey", "ge", "ne", "lt", "gt"]])


@query("SELECT c_custkey, (c_acctbal > 0) AND (c_nationkey < 10) AS a, (c_acctbal > 0) OR (c_nationkey < 10) AS o, (c_acctbal > 0) <> (c_nationkey < 10) AS x FROM customer")
def binop_bool(spark, sf):
    t = op(spark, sf, "customer")
    p, q = t["c_acctbal"] > 0, t["c_nationkey"] < 10
    return value(spark, t.assign(a=p & q, o=p | q, x=p ^ q)[["c_custkey", "a", "o", "x"]])


@query("SELECT s_suppkey, s_acctbal, s_acctbal * 3 AS triple, s_name FROM supplier")
def concat_axis1(spark, sf):
    t = op(spark, sf, "supplier")
    return value(spark, t[["s_suppkey", "s_acctbal"]].concat([(t[["s_acctbal"]] * 3).rename({"s_acctbal": "triple"}), t[["s_name"]]], axis=1))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_numeric(spark, sf):
    return value(spark, op(spark, sf, "customer").select(pl.Numeric()))


@query("SELECT c_name, c_mktsegment FROM customer")
def select_non_numeric(spark, sf):
    return value(spark, op(spark, sf, "customer").select(~pl.Numeric()))


# methods and functions


def _with_nulls(spark, sf):
    return pl.table(read(spark, sf, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS status", "nullif(o_orderpriority, '5-LOW') AS priority"))


_NULLS = "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '5-LOW') AS priority FROM orders)"


@query(f"SELECT * FROM {_NULLS} WHERE status IS NOT NULL AND priority IS NOT NULL")
def method_dropna(spark, sf):
    return value(spark, _with_nulls(spark, sf).dropna())


@query(f"SELECT o_orderkey, coalesce(status, 'none') AS status, priority IS NULL AS missing FROM {_NULLS}")
def method_fillna(spark, sf):
    t = _with_nulls(spark, sf)
    return value(spark, t.fillna({"status": "none"}).assign(missing=t["priority"].isna()).drop("priority"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, avg(l_discount) AS discount, count(l_orderkey) AS n, max(l_tax) AS tax FROM lineitem GROUP BY ALL")
def method_groupby_agg(spark, sf):
    g = op(spark, sf, "lineitem").groupby(["l_returnflag", "l_linestatus"])
    return value(spark, g.agg(quantity=("l_quantity", "sum"), discount=("l_discount", "mean"), n=("l_orderkey", "count"), tax=("l_tax", "max"))).withColumn("discount", F.round("discount", 9))


ORACLES["method_groupby_agg"] = ORACLES["method_groupby_agg"].replace("avg(l_discount)", "round(avg(l_discount), 9)")


@query("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def method_merge(spark, sf):
    return value(spark, op(spark, sf, "nation").rename({"n_regionkey": "k"}).merge(op(spark, sf, "region").rename({"r_regionkey": "k"}), on="k", how="inner")[["n_name", "r_name"]])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def method_sort_head(spark, sf):
    return value(spark, op(spark, sf, "orders").sort_values(["o_totalprice", "o_orderkey"], ascending=[False, True]).head(25)[["o_orderkey", "o_totalprice"]])


@query("SELECT DISTINCT p_brand, p_type FROM part")
def method_distinct(spark, sf):
    return value(spark, op(spark, sf, "part")[["p_brand", "p_type"]].drop_duplicates())


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_brand")
def apply_func(spark, sf):
    return value(spark, op(spark, sf, "part").apply_func(lambda df, least: df.where(F.col("p_size") > least).groupBy("p_brand").agg(F.count("*").alias("n")), 25))


# union


@query("SELECT c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def concat_axis0(spark, sf):
    a = op(spark, sf, "customer").rename({"c_custkey": "id", "c_acctbal": "bal"})[["id", "bal"]]
    return value(spark, a.concat([op(spark, sf, "supplier").rename({"s_suppkey": "id", "s_acctbal": "bal"})[["id", "bal"]]], axis=0))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name, CAST(NULL AS DOUBLE) AS price FROM nation UNION ALL SELECT p_brand, NULL, p_retailprice FROM part")
def concat_axis0_diagonal(spark, sf):
    a = op(spark, sf, "nation").rename({"n_nationkey": "k"})[["k", "n_name"]]
    return value(spark, a.concat([op(spark, sf, "part").rename({"p_brand": "k", "p_retailprice": "price"})[["k", "price"]]], axis=0))


# numbers


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 9) WHEN c_acctbal = 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END AS v FROM customer")
def math_log(spark, sf):
    t = op(spark, sf, "customer")
    return value(spark, t.assign(v=np.log(t["c_acctbal"]))[["c_custkey", "v"]]).withColumn("v", F.when(F.isnan("v") | (F.abs("v") == float("inf")), F.col("v")).otherwise(F.round("v", 9)))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, round(exp(l_discount), 9) AS v FROM lineitem")
def math_exp(spark, sf):
    t = op(spark, sf, "lineitem")
    return value(spark, t.assign(v=np.exp(t["l_discount"]))[["l_orderkey", "l_linenumber", "l_extendedprice", "v"]]).withColumn("v", F.round("v", 9))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NaN'::DOUBLE ELSE sqrt(c_acctbal) END AS v FROM customer")
def math_sqrt(spark, sf):
    t = op(spark, sf, "customer")
    return value(spark, t.assign(v=np.sqrt(t["c_acctbal"]))[["c_custkey", "v"]])


@query("SELECT c_custkey, abs(c_acctbal) AS v FROM customer")
def math_abs(spark, sf):
    t = op(spark, sf, "customer")
    return value(spark, t.assign(v=np.abs(t["c_acctbal"]))[["c_custkey", "v"]])


@query("SELECT c_custkey, c_acctbal * c_acctbal AS v, c_acctbal * c_acctbal AS w FROM customer")
def math_square(spark, sf):
    t = op(spark, sf, "customer")
    return value(spark, t.assign(v=np.square(t["c_acctbal"]), w=t["c_acctbal"] ** 2)[["c_custkey", "v", "w"]])


@query("SELECT p_partkey, round(ln(1 + p_retailprice), 9) AS a, CAST(floor(p_retailprice) AS BIGINT) AS b, greatest(p_size, 10) AS c, least(greatest(p_retailprice, 950.0), 1000.0) AS d, sign(p_retailprice - 1000) AS e FROM part")
def math_generic(spark, sf):
    t = op(spark, sf, "part")
    r = t["p_retailprice"]
    return value(spark, t.assign(a=np.log1p(r), b=np.floor(r), c=np.maximum(t["p_size"], 10), d=r.clip(950.0, 1000.0), e=np.sign(r - 1000))[["p_partkey", "a", "b", "c", "d", "e"]]).withColumns({"a": F.round("a", 9), "e": F.col("e").cast("tinyint")})


@query("SELECT o_orderkey, round(sin(o_totalprice), 6) AS s, round(cos(o_totalprice), 6) AS c FROM orders")
def udf_sin_cos_native(spark, sf):
    t = op(spark, sf, "orders")
    return value(spark, t.assign(s=t["o_totalprice"].apply(np.sin), c=t["o_totalprice"].apply(np.cos))[["o_orderkey", "s", "c"]]).withColumns({"s": F.round("s", 6), "c": F.round("c", 6)})


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size / 2.0 ELSE 3.0 * p_size + 1 END AS v FROM part")
def udf_scalar(spark, sf):
    t = op(spark, sf, "part")
    return value(spark, t.assign(v=t["p_size"].apply(lambda n: n / 2 if n % 2 == 0 else 3.0 * n + 1))[["p_partkey", "v"]]).withColumn("v", F.col("v").cast("double"))


ORACLES["udf_scalar"] = "SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN p_size / 2.0 ELSE 3.0 * p_size + 1 END AS DOUBLE) AS v FROM part"


@query("SELECT c_custkey, upper(substr(c_mktsegment, 1, 3)) || '!' AS v, c_name LIKE '%7' AS seven FROM customer")
def udf_string(spark, sf):
    t = op(spark, sf, "customer")
    return value(spark, t.assign(v=t["c_mktsegment"].apply(lambda s: s[:3].upper() + "!"), seven=t["c_name"].apply(lambda s: s.endswith("7")))[["c_custkey", "v", "seven"]])


@query("SELECT coalesce(CASE WHEN p_size % 3 <> 0 THEN p_size END, 0) * 2.0::DOUBLE AS p_size, p_retailprice * 2.0::DOUBLE AS p_retailprice FROM part")
def udf_frame(spark, sf):
    t = pl.table(read(spark, sf, "part").selectExpr("double(CASE WHEN p_size % 3 <> 0 THEN p_size END) AS p_size", "p_retailprice"))
    return value(spark, t.apply(lambda c: c.fillna(0) * 2))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) ** 2 AS v FROM lineitem")
def method_of_pandas(spark, sf):
    t = op(spark, sf, "lineitem")
    return value(spark, t.assign(v=t["l_quantity"].pow(2.0))[["l_orderkey", "l_linenumber", "v"]])


@query("SELECT p_partkey, CAST(p_size + p_partkey AS DOUBLE) AS v FROM part")
def udf_multi_col(spark, sf):
    t = op(spark, sf, "part")
    return value(spark, t.assign(v=t[["p_size", "p_partkey"]].apply_rows(lambda pdf: pdf.sum(axis=1).astype("float64")))[["p_partkey", "v"]])


@query("SELECT p_partkey, abs(p_retailprice - 1000) AS v, (p_retailprice - 1000) AS w FROM part")
def rewrite_sqrt_square(spark, sf):
    t = op(spark, sf, "part")
    d = t["p_retailprice"] - 1000
    return value(spark, t.assign(v=np.sqrt(d**2), w=np.log(np.exp(d)))[["p_partkey", "v", "w"]])


@query("SELECT o_orderkey, o_totalprice AS v, round(ln(1 + o_totalprice), 9) AS w FROM orders")
def rewrite_log_exp(spark, sf):
    t = op(spark, sf, "orders")
    return value(spark, t.assign(v=np.exp(np.log(t["o_totalprice"])), w=np.log1p(np.log(np.exp(t["o_totalprice"]))))[["o_orderkey", "v", "w"]]).withColumn("w", F.round("w", 9))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice / l_quantity AS per_unit, l_discount / (1 + l_tax) AS ratio, (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def feature_ratios(spark, sf):
    t = op(spark, sf, "lineitem")
    return value(spark, t.assign(per_unit=t["l_extendedprice"] / t["l_quantity"], ratio=t["l_discount"] / (1 + t["l_tax"]), charge=(1 - t["l_discount"]) * (1 + t["l_tax"]))[["l_orderkey", "l_linenumber", "l_extendedprice", "per_unit", "ratio", "charge"]])


# dates


def _dated(spark, sf):
    return pl.table(read(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day")))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m FROM orders")
def to_datetime_strict(spark, sf):
    import pandas as pd

    t = _dated(spark, sf)
    d = t["day"].apply(pd.to_datetime, format="%Y-%m-%d %H:%M:%S")
    return value(spark, t.assign(y=d.dt.year.astype("int"), m=d.dt.month.astype("int")).drop("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(day(o_orderdate) AS BIGINT) END AS d FROM orders")
def to_datetime_coerce(spark, sf):
    import pandas as pd

    t = pl.table(read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "not a date").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day")))
    return value(spark, t.assign(d=t["day"].apply(pd.to_datetime, format="%d/%m/%Y", errors="coerce").dt.day.astype("int")).drop("day"))


@query("SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(quarter(ts) AS BIGINT) AS q FROM events")
def dt_parts(spark, sf):
    t = op(spark, sf, "events")
    parts = {"y": "year", "m": "month", "d": "day", "h": "hour", "q": "quarter"}
    return value(spark, t.assign(**{k: getattr(t["ts"].dt, v).astype("int") for k, v in parts.items()})[["event_id", *parts]])


@query("SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS w FROM orders")
def dt_weekday(spark, sf):
    t = op(spark, sf, "orders")
    return value(spark, t.assign(w=t["o_orderdate"].dt.weekday.astype("int"))[["o_orderkey", "w"]])


@query("SELECT o_orderkey, CAST(dayofyear(o_orderdate) AS BIGINT) AS d FROM orders")
def dt_dayofyear(spark, sf):
    t = op(spark, sf, "orders")
    return value(spark, t.assign(d=t["o_orderdate"].dt.dayofyear.astype("int"))[["o_orderkey", "d"]])


@query("SELECT event_id, CAST(ts AS DATE) = last_day(CAST(ts AS DATE)) AS e FROM events")
def dt_month_end(spark, sf):
    t = op(spark, sf, "events")
    return value(spark, t.assign(e=t["ts"].dt.is_month_end)[["event_id", "e"]])


@query("SELECT event_id, round(sin(hour(ts) * 2 * pi() / 24), 9) AS hs, round(cos(hour(ts) * 2 * pi() / 24), 9) AS hc, round(sin(month(ts) * 2 * pi() / 12), 9) AS ms FROM events")
def cyclical_features(spark, sf):
    t = op(spark, sf, "events")
    h, m = t["ts"].dt.hour, t["ts"].dt.month
    out = t.assign(hs=(h * (2 * np.pi / 24)).apply(np.sin), hc=(h * (2 * np.pi / 24)).apply(np.cos), ms=(m * (2 * np.pi / 12)).apply(np.sin))
    return value(spark, out[["event_id", "hs", "hc", "ms"]]).withColumns({c: F.round(c, 9) + 0.0 for c in ("hs", "hc", "ms")})


ORACLES["cyclical_features"] = ORACLES["cyclical_features"].replace(", 9)", ", 9) + 0.0")


# choices


@query("SELECT id, CAST(vals AS DOUBLE) AS vals FROM (VALUES ('base:1', 6), ('base:2.5', 7.5)) t(id, vals)")
def choice_scalar(spark, sf):
    return choice_table(spark, pl.choose_from([1, 2.5], name="base") + 5)


@query("SELECT 'v:asis' AS id, count(*) AS n, round(sum(p_retailprice), 2) AS s FROM part UNION ALL SELECT 'v:twice', count(*), round(sum(2 * p_retailprice), 2) FROM part")
def choice_two(spark, sf):
    t = op(spark, sf, "part")
    plan = pl.choose_from({"asis": t["p_retailprice"], "twice": 2 * t["p_retailprice"]}, name="v")
    out = [value(spark, p).toDF("v").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("s")).select(F.lit(i).alias("id"), "n", "s") for i, p in pl.plans.search.expand(plan)]
    return out[0].unionByName(out[1])


@query("SELECT id, CAST(vals AS DOUBLE) AS vals FROM (VALUES ('base:1, f:times', 13), ('base:1, f:over', 3), ('base:2.5, f:times', 16), ('base:2.5, f:over', 3.5)) t(id, vals)")
def choice_nested(spark, sf):
    x = pl.choose_from([1, 2.5], name="base") + 5
    return choice_table(spark, pl.choose_from({"times": x * 2, "over": x / 3}, name="f") + 1)


@query("SELECT 'x:plain' AS id, round(sum(ln(p_retailprice)), 4) AS s FROM part UNION ALL SELECT 'x:more', round(sum(ln(p_retailprice + 10)), 4) FROM part")
def choice_before_log(spark, sf):
    t = op(spark, sf, "part")
    t = t.assign(v=pl.choose_from({"plain": t["p_retailprice"], "more": t["p_retailprice"] + 10}, name="x"))
    plan = np.log(t["v"])
    out = [value(spark, p).toDF("v").agg(F.round(F.sum("v"), 4).alias("s")).select(F.lit(i).alias("id"), "s") for i, p in pl.plans.search.expand(plan)]
    return out[0].unionByName(out[1])


# splits and scores


def _price(spark, sf):
    """Key, feature and target of the model queries."""
    return pl.table(read(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_extendedprice / 1000 AS x", "l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 AS y"))


_PRICE = "(SELECT l_orderkey AS k, l_extendedprice / 1000 AS x, l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 AS y FROM lineitem)"


def _xy(t):
    return t[["k", "x"]].mark_x(), t["y"].mark_y()


@query("SELECT f AS fold, count(*) FILTER (k % 3 <> f) AS train, count(*) FILTER (k % 3 = f) AS test FROM (SELECT o_orderkey AS k FROM orders), range(3) r(f) GROUP BY f")
def split_counts(spark, sf):
    f = Frame.of(read(spark, sf, "orders"))
    rows = cv.KFold(3, "o_orderkey", "mod")(f.rows, f.cols)
    return rows.df().groupBy(F.col("__fold").cast("bigint").alias("fold")).agg(F.sum(F.when(F.col("__test"), 0).otherwise(1)).alias("train"), F.sum(F.when(F.col("__test"), 1).otherwise(0)).alias("test"))


@query("""SELECT fold, count(*) AS n, min(k) AS first_key, max(k) AS last_key FROM (SELECT k, CASE WHEN r < (n % 7) * (n // 7 + 1) THEN r // (n // 7 + 1) ELSE (r - (n % 7) * (n // 7 + 1)) // (n // 7) + n % 7 END AS fold
  FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders)) GROUP BY fold""")
def cv_folds(spark, sf):
    f = Frame.of(read(spark, sf, "orders"))
    df, part = cv.KFold(7, "o_orderkey", "block").part(f.rows, f.cols)
    return df.groupBy(part.cast("bigint").alias("fold")).agg(F.count("*").alias("n"), F.min(f.cols["o_orderkey"]).alias("first_key"), F.max(f.cols["o_orderkey"]).alias("last_key"))


def _fold_sql(models: dict[str, str], folds: int, score: str = "avg((y - p) * (y - p))", digits: int = 4, prep: str = "x", source: str = _PRICE) -> str:
    """Scores of one-feature models; a model is an expression of the training moments n, mx, my, sxx, sxy and of x."""
    each = " UNION ALL ".join(f"SELECT '{i}' AS id, f, y, {e} AS p FROM joined" for i, e in models.items())
    return f"""
WITH d AS (SELECT k, {prep} AS x, y FROM {source}), folds AS (SELECT * FROM range({folds}) r(f)),
fit AS (SELECT f, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, covar_pop(y, x) AS sxy FROM d, folds WHERE k % {folds} <> f GROUP BY f),
joined AS (SELECT * FROM d JOIN fit ON k % {folds} = f), each_model AS ({each}),
scored AS (SELECT id, f, {score} AS s FROM each_model GROUP BY id, f)
SELECT id, round(avg(s), {digits}) AS scores FROM scored GROUP BY id"""


_LINE = "my + {} * (x - mx)"
_OLS, _RIDGE1, _RIDGE100 = _LINE.format("sxy / sxx"), _LINE.format("sxy / (sxx + 1.0 / n)"), _LINE.format("sxy / (sxx + 100.0 / n)")


def _scores(result, digits=4):
    return result.results.select("id", F.round("scores", digits).alias("scores"))


def _model(x, y, model):
    return x[["x"]].fit_apply(model, y=y)


@query(_fold_sql({"": "my"}, 5))
def cv_scores_dummy(spark, sf):
    x, y = _xy(_price(spark, sf))
    return _scores(pl.grid_search(spark, _model(x, y, pl.DummyRegressor()), cv=cv.KFold(5, "k", "mod")))


@query(_fold_sql({"model:mean": "my", "model:ols": _OLS, "model:ridge": _RIDGE1}, 5))
def cv_scores_linear(spark, sf):
    x, y = _xy(_price(spark, sf))
    models = {"mean": pl.DummyRegressor(), "ols": pl.LinearRegression(), "ridge": pl.Ridge(1.0)}
    return _scores(pl.grid_search(spark, pl.choose_from({n: _model(x, y, m) for n, m in models.items()}, name="model"), cv=cv.KFold(5, "k", "mod")))


@query(f"SELECT count(*) AS n, round(avg(y), 4) AS y_true, round(avg(p), 4) AS y_pred FROM (SELECT y, (SELECT avg(y) FROM {_PRICE} WHERE k % 4 <> 0) AS p FROM {_PRICE} WHERE k % 4 = 0)")
def holdout_eval(spark, sf):
    x, y = _xy(_price(spark, sf))
    out = pl.evaluate(spark, _model(x, y, pl.DummyRegressor()), ModuloHoldout(4, "k"))
    return out.agg(F.count("*").alias("n"), F.round(F.avg("y_true"), 4).alias("y_true"), F.round(F.avg("y_pred"), 4).alias("y_pred"))


def _scored(scoring):
    def run(spark, sf):
        x, y = _xy(_price(spark, sf))
        return _scores(pl.grid_search(spark, _model(x, y, pl.LinearRegression()), cv=cv.KFold(3, "k", "mod"), scoring=scoring), 6)

    return run


for _name, _sql in (("mse", "avg((y - p) * (y - p))"), ("mae", "avg(abs(y - p))"), ("r2", "1 - avg((y - p) * (y - p)) / var_pop(y)"), ("rmsle", "sqrt(avg(pow(ln(1 + greatest(p, 0)) - ln(1 + y), 2)))")):
    QUERIES[f"score_{_name}"] = _scored(_name)
    ORACLES[f"score_{_name}"] = _fold_sql({"": _OLS}, 3, _sql, 6)


@query(_fold_sql({"": "exp(my) - 1"}, 3, digits=4, source=_PRICE).replace("avg(y) AS my", "avg(ln(1 + y)) AS my"))
def log_target_expm1(spark, sf):
    x, y = _xy(_price(spark, sf))
    by_mode = lambda train, predict: (lambda v, mode: train(v) if mode == "fit_transform" else predict(v))
    logged = y.apply_func(by_mode(lambda v: v.with_col(F.log1p(v.col)), lambda v: v), pl.eval_mode())
    pred = _model(x, logged, pl.DummyRegressor())
    return _scores(pl.grid_search(spark, pred.apply_func(by_mode(lambda v: v, lambda v: v.with_col(F.expm1(v.col))), pl.eval_mode()), cv=cv.KFold(3, "k", "mod")))


_GRID_MODELS = {"mean": pl.DummyRegressor(), "ols": pl.LinearRegression(), "ridge1": pl.Ridge(1.0), "ridge100": pl.Ridge(100.0)}


@query()
def grid_search_2x4(spark, sf):
    x, y = _xy(_price(spark, sf))
    scaled = x[["x"]].fit_apply(pl.StandardScaler())
    logged = np.log(x[["x"]]).fit_apply(pl.StandardScaler())
    prep = pl.choose_from({"scaled": scaled, "log": logged}, name="prep")
    return _scores(pl.grid_search(spark, pl.choose_from({n: prep.fit_apply(m, y=y) for n, m in _GRID_MODELS.items()}, name="model"), cv=cv.KFold(3, "k", "mod")))


def _grid_sql() -> str:
    z = "my + {} * (x - mx)"  # in units of x: a ridge on x / s is one on x with alpha / s^2
    models = {"mean": "my", "ols": _OLS, "ridge1": z.format("sxy / (sxx * (1 + 1.0 / n))"), "ridge100": z.format("sxy / (sxx * (1 + 100.0 / n))")}
    return " UNION ALL ".join(f"SELECT * FROM ({_fold_sql({f'prep:{p}, model:{m}': e for m, e in models.items()}, 3, prep=x)})" for p, x in (("scaled", "x"), ("log", "ln(x)")))


ORACLES["grid_search_2x4"] = _grid_sql()


@query(_fold_sql({f"alpha:{a}": _LINE.format(f"sxy / (sxx + {float(a)} / n)") for a in (0.1, 1, 10, 100, 1000, 10000)}, 3))
def grid_ridge_alphas(spark, sf):
    x, y = _xy(_price(spark, sf))
    return _scores(pl.grid_search(spark, pl.choose_from({str(a): _model(x, y, pl.Ridge(float(a))) for a in (0.1, 1, 10, 100, 1000, 10000)}, name="alpha"), cv=cv.KFold(3, "k", "mod")))


@query()
def grid_search_rich(spark, sf):
    """Numbers and one-hot flags, four kinds of model."""
    t = pl.table(read(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_quantity", "l_extendedprice / 1000 AS price", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 AS y"))
    x, y = t.drop("y").mark_x(), t["y"].mark_y()
    f = x.drop("k").fit_apply(pl.OneHotEncoder(drop="if_binary"), cols=["l_returnflag", "l_linestatus"])
    models = {"ols": pl.LinearRegression(), "ridge": pl.Ridge(1.0), "lasso": pl.Lasso(0.1), "enet": pl.ElasticNet(0.1)}
    return _scores(pl.grid_search(spark, pl.choose_from({n: f.fit_apply(m, y=y) for n, m in models.items()}, name="model"), cv=cv.KFold(3, "k", "mod"), scoring="r2"))


# models


def _fitted(spark, sf, model):
    f = Frame.of(read(spark, sf, "lineitem").selectExpr("l_extendedprice / 1000 AS x", "l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 AS y"))
    (intercept, w) = model.fit(f.choose(["x"]), f.series("y"))[0]
    return spark.createDataFrame([(round(float(w[0]), 6), round(float(intercept), 5))], "slope double, intercept double")


def _line_sql(slope: str) -> str:
    return f"SELECT round(b, 6) AS slope, round(my - b * mx, 5) AS intercept FROM (SELECT {slope} AS b, mx, my FROM (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, covar_pop(y, x) AS sxy FROM {_PRICE}))"


for _name, _estimator, _slope in (
    ("lr_ols", pl.LinearRegression(), "sxy / sxx"),
    ("lr_ridge", pl.Ridge(500.0), "sxy / (sxx + 500.0 / n)"),
    ("lr_lasso", pl.Lasso(10.0), "greatest(sxy - 10.0, 0) / sxx"),
    ("lr_enet", pl.ElasticNet(10.0, 0.3), "greatest(sxy - 3.0, 0) / (sxx + 7.0)"),
):
    QUERIES[_name] = lambda spark, sf, m=_estimator: _fitted(spark, sf, m)
    ORACLES[_name] = _line_sql(_slope)


def _trees(make):
    def run(spark, sf):
        t = pl.table(read(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_quantity AS q", "l_extendedprice / 1000 AS x", "l_discount AS d", "l_extendedprice * (1 - l_discount) / 1000 AS y"))
        x, y = t[["k", "q", "x", "d"]].mark_x(), t["y"].mark_y()
        return pl.grid_search(spark, x.drop("k").fit_apply(make(trees=5, depth=3), y=y), cv=cv.KFold(2, "k", "mod"), scoring="r2").results

    return run


QUERIES["model_rf"], QUERIES["model_gbt"] = _trees(pl.RandomForestRegressor), _trees(pl.GradientBoostedRegressor)


# encoders


@query("SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 9) AS p_size, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 9) AS p_retailprice FROM part")
def standard_scale(spark, sf):
    out = op(spark, sf, "part")[["p_partkey", "p_size", "p_retailprice"]].fit_apply(pl.StandardScaler(), cols=["p_size", "p_retailprice"])
    return value(spark, out).withColumns({c: F.round(c, 9) for c in ("p_size", "p_retailprice")})


@query("SELECT c_custkey, c_name, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 9) AS c_acctbal FROM customer")
def apply_cols_subset(spark, sf):
    out = op(spark, sf, "customer")[["c_custkey", "c_name", "c_acctbal"]].fit_apply(pl.StandardScaler(), cols="c_acctbal")
    return value(spark, out).withColumn("c_acctbal", F.round("c_acctbal", 9))


def _means(table: str, key: str, cols: dict[str, str], target: str) -> str:
    picks = ", ".join(f"round(coalesce(m{i}.v, g.v), 6) AS {n}" for i, n in enumerate(cols.values()))
    joins = " ".join(f"LEFT JOIN (SELECT {c} AS c, avg({target}) AS v FROM {table} WHERE {key} % 2 = 0 GROUP BY 1) m{i} ON t.{c} = m{i}.c" for i, c in enumerate(cols))
    return f"SELECT t.{key}, {picks} FROM {table} t {joins}, (SELECT avg({target}) AS v FROM {table} WHERE {key} % 2 = 0) g WHERE t.{key} % 2 <> 0"


@query(_means("part", "p_partkey", {"p_brand": "brand", "p_name": "name"}, "p_retailprice"))
def target_encode(spark, sf):
    return _target(spark, sf, {"p_brand": "brand", "p_name": "name"})


@query(_means("part", "p_partkey", {"p_type": "kind"}, "p_retailprice"))
def target_encode_join(spark, sf):
    return _target(spark, sf, {"p_type": "kind"})


def _target(spark, sf, cols):
    df = read(spark, sf, "part")
    train, test = Frame.of(df.where("p_partkey % 2 = 0")), Frame.of(df.where("p_partkey % 2 <> 0"))
    encoder = pl.TargetEncoder()
    state = encoder.fit(train.choose(list(cols)), train.series("p_retailprice"))
    out = encoder.transform(state, test.choose(list(cols)))
    return Frame(out.rows, {"p_partkey": test.cols["p_partkey"], **{n: F.round(out.cols[c], 6) for c, n in cols.items()}}).df()


@query("SELECT CAST(f AS INT) AS feature, category, row_number() OVER (ORDER BY f, category) - 1 AS code FROM (SELECT DISTINCT 0 AS f, p_brand AS category FROM part UNION SELECT DISTINCT 1, p_type FROM part)")
def ohe_fit_categories(spark, sf):
    return categories.category_table(read(spark, sf, "part"), ["p_brand", "p_type"])


@query("SELECT l_returnflag AS flag, " + ", ".join(f"CAST(l_returnflag = '{v}' AS DOUBLE) AS is_{v}" for v in "ANR") + ", count(*) AS n FROM lineitem GROUP BY ALL")
def ohe_dense(spark, sf):
    t = op(spark, sf, "lineitem")
    out = value(spark, t[["l_returnflag"]].rename({"l_returnflag": "is"}).fit_apply(pl.OneHotEncoder()).concat([t[["l_returnflag"]].rename({"l_returnflag": "flag"})], axis=1))
    return out.groupBy("flag", "is_A", "is_N", "is_R").agg(F.count("*").alias("n"))


@query("SELECT CAST(l_linestatus = 'O' AS DOUBLE) AS l_linestatus_O, count(*) AS n FROM lineitem GROUP BY ALL")
def ohe_if_binary(spark, sf):
    return value(spark, op(spark, sf, "lineitem")[["l_linestatus"]].fit_apply(pl.OneHotEncoder(drop="if_binary"))).groupBy("l_linestatus_O").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS s_BUILDING, CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS s_MACHINERY FROM customer")
def ohe_unknown_zero(spark, sf):
    df = read(spark, sf, "customer").withColumnRenamed("c_mktsegment", "s")
    encoder, f = pl.OneHotEncoder(), Frame.of(df)
    state = encoder.fit(Frame.of(df.where(F.col("s").isin("BUILDING", "MACHINERY"))).choose(["s"]))
    return Frame(f.rows, {"c_custkey": f.cols["c_custkey"], **encoder.transform(state, f.choose(["s"])).cols}).df()


@query("""WITH c AS (SELECT f, category, row_number() OVER (ORDER BY f, category) - 1 AS code FROM (SELECT DISTINCT 0 AS f, p_brand AS category FROM part UNION SELECT DISTINCT 1, p_type FROM part))
  SELECT p_partkey AS row_id, code AS col, 1.0::DOUBLE AS value FROM part JOIN c ON (f = 0 AND category = p_brand) OR (f = 1 AND category = p_type)""")
def ohe_sparse(spark, sf):
    return categories.one_hot_sparse(read(spark, sf, "part"), "p_partkey", ["p_brand", "p_type"])


@query("SELECT o_orderkey, coalesce(CAST(CASE WHEN o_custkey % 3 = 0 THEN 'NaN'::DOUBLE WHEN o_custkey % 3 = 1 THEN NULL ELSE o_custkey::DOUBLE END AS VARCHAR), '') AS v FROM orders")
def clean_strings(spark, sf):
    df = read(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_custkey % 3 = 0 THEN double('NaN') WHEN o_custkey % 3 = 1 THEN NULL ELSE double(o_custkey) END AS v")
    return df.select("o_orderkey", text.clean(F.col("v")).alias("v"))


ORACLES["clean_strings"] = "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 2 THEN CAST(o_custkey::DOUBLE AS VARCHAR) ELSE '' END AS v FROM orders"


def _grams_sql(t: str, low: int, high: int) -> str:
    lists = ", ".join(f"CASE WHEN length(t) >= {n} THEN list_transform(generate_series(1, length(t) - {n - 1}), lambda i: substring(t, i, {n})) ELSE [] END" for n in range(low, high + 1))
    return f"(SELECT id, unnest(flatten([{lists}])) AS token FROM (SELECT {t}))"


@query(f"SELECT id, token, count(*) AS n FROM {_grams_sql('doc_id AS id, text AS t FROM documents', 2, 3)} GROUP BY ALL")
def ngrams_char(spark, sf):
    return text.token_counts(read(spark, sf, "documents"), "doc_id", "text", "char", 2, 3).select(F.col("row_id").alias("id"), "token", F.col("tf").alias("n"))


_WORDS = "p_partkey AS id, ' ' || p_name || ' ' AS t FROM part"


@query(f"SELECT id, token, count(*) AS n FROM {_grams_sql(_WORDS, 3, 4)} GROUP BY ALL")
def ngrams_char_wb(spark, sf):
    return text.token_counts(read(spark, sf, "part"), "p_partkey", "p_name").select(F.col("row_id").alias("id"), "token", F.col("tf").alias("n"))


def _counts(spark, sf, buckets=None):
    """(counts, rows, partitions)."""
    df = read(spark, sf, "part")
    n, parts = text.extent(df, "p_name")
    return text.token_counts(df, "p_partkey", "p_name", buckets=buckets, parts=parts), n, parts


_IDF_SQL = f"""tf AS (SELECT id, token, count(*) AS tf FROM {_grams_sql(_WORDS, 3, 4)} GROUP BY ALL),
  idf AS (SELECT token, count(*) AS df, ln((1 + (SELECT count(*) FROM part)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY token)"""


@query(f"WITH {_IDF_SQL} SELECT token, df, round(idf, 9) AS idf FROM idf")
def tfidf_df_idf(spark, sf):
    counts, n, _ = _counts(spark, sf)
    return text.inverse_frequency(counts, n).withColumn("idf", F.round("idf", 9))


@query(f"WITH {_IDF_SQL}, w AS (SELECT id, token, tf * idf AS v FROM tf JOIN idf USING (token)) SELECT id AS row_id, token, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM w")
def tfidf_vocab(spark, sf):
    counts, n, parts = _counts(spark, sf)
    return text.tfidf(counts, text.inverse_frequency(counts, n), parts).withColumn("value", F.round("value", 6))


@query(f"""WITH tf AS (SELECT id, token, count(*) AS tf FROM {_grams_sql(_WORDS, 3, 4)} GROUP BY ALL), n AS (SELECT count(*) AS n FROM part WHERE p_partkey % 10 = 0),
  idf AS (SELECT token, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tf, n WHERE id % 10 = 0 GROUP BY token), w AS (SELECT id, token, tf * idf AS v FROM tf JOIN idf USING (token) WHERE id % 10 <> 0)
  SELECT id AS row_id, token, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM w""")
def tfidf_transform_oov(spark, sf):
    counts, _, parts = _counts(spark, sf)
    fitted = text.inverse_frequency(counts.where("row_id % 10 = 0"), read(spark, sf, "part").where("p_partkey % 10 = 0").count())
    return text.tfidf(counts.where("row_id % 10 <> 0"), fitted, parts).withColumn("value", F.round("value", 6))


_HASHED = f"tf AS (SELECT id, ('0x' || substr(md5(token), 1, 8))::UBIGINT % {text.BUCKETS} AS token, count(*) AS tf FROM {_grams_sql(_WORDS, 3, 4)} GROUP BY ALL)"
#: t and the sign that a token's hash gives it.
_SIGNS = "(SELECT CAST(t AS INT) AS t FROM range(46) r(t)) s, (SELECT *, ('0x' || substr(md5('42:' || token), 17, 16))::UBIGINT AS bits FROM x) y"
_PROJECTED = f"""WITH {_IDF_SQL}, w AS (SELECT id, token, tf * idf AS v FROM tf JOIN idf USING (token)), x AS (SELECT id, token, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM w),
  y AS (SELECT id AS row_id, t, sum(CASE WHEN (bits >> t::UBIGINT) & 1 = 1 THEN -v ELSE v END) AS value FROM {_SIGNS} GROUP BY ALL)"""


@query(f"SELECT DISTINCT token, CAST(('0x' || substr(md5(token), 1, 8))::UBIGINT % {text.BUCKETS} AS BIGINT) AS bucket FROM {_grams_sql(_WORDS, 3, 4)}")
def hash_buckets(spark, sf):
    return _counts(spark, sf)[0].select("token", text.hash_bucket(F.col("token")).alias("bucket")).distinct()


@query(f"""WITH {_HASHED}, idf AS (SELECT token, ln((1 + (SELECT count(*) FROM part)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY token), w AS (SELECT id, token, tf * idf AS v FROM tf JOIN idf USING (token))
  SELECT id AS row_id, CAST(token AS VARCHAR) AS token, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM w""")
def tfidf_hashing(spark, sf):
    hashed, n, parts = _counts(spark, sf, text.BUCKETS)
    return text.tfidf(hashed, text.inverse_frequency(hashed, n), parts).select("row_id", F.col("token").cast("string").alias("token"), F.round("value", 6).alias("value"))


def _projected(spark, sf):
    counts, n, parts = _counts(spark, sf)
    return text.project(text.tfidf(counts, text.inverse_frequency(counts, n), parts), 46)


@query(f"{_PROJECTED} SELECT row_id, t, round(value, 6) + 0.0 AS value FROM y")
def random_projection(spark, sf):
    return _projected(spark, sf).select("row_id", F.posexplode("values").alias("t", "value")).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(f"{_PROJECTED} SELECT a.t AS i, b.t AS j, round(sum(a.value * b.value), 6) + 0.0 AS gram FROM y a JOIN y b USING (row_id) GROUP BY ALL")
def embed_gram(spark, sf):
    return text.gram(_projected(spark, sf), "values", 46).withColumn("gram", F.round("gram", 6) + F.lit(0.0))


@query()
def string_encode_shape(spark, sf):
    return value(spark, op(spark, sf, "part")[["p_name"]].fit_apply(pl.StringEncoder()))


@query()
def string_encode_svd(spark, sf):
    return value(spark, op(spark, sf, "part")[["p_name"]].fit_apply(pl.StringEncoder(reduction="svd")))


@query()
def string_encode_cols(spark, sf):
    return value(spark, op(spark, sf, "part")[["p_name", "p_type"]].fit_apply(pl.StringEncoder(), how="cols"))


_SCALED = "round(({0} - (SELECT avg({0}) FROM part)) / (SELECT stddev_pop({0}) FROM part), 9) AS {0}"


@query(f"SELECT p_partkey, p_name, {_SCALED.format('p_size')}, {_SCALED.format('p_retailprice')} FROM part")
def apply_to_cols(spark, sf):
    """Each column by itself; one that is no number is rejected and passed on."""
    out = op(spark, sf, "part")[["p_partkey", "p_name", "p_size", "p_retailprice"]].fit_apply(pl.StandardScaler(), cols=["p_name", "p_size", "p_retailprice"], how="cols", allow_reject=True)
    return value(spark, out).withColumns({c: F.round(c, 9) for c in ("p_size", "p_retailprice")})


@query()
def tsvd(spark, sf):
    sigma, _, _ = text.truncated_svd(read(spark, sf, "part"), "p_name", 30)
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(sigma)], "i int, sigma double")


@query()
def tsvd_transform(spark, sf):
    part = read(spark, sf, "part")
    _, right, idf = text.truncated_svd(part, "p_name", 30)
    return text.svd_transform(part, "p_partkey", "p_name", right, idf).select("row_id", *[F.element_at("values", i + 1).alias(f"v{i}") for i in range(30)])


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT CAST(o_totalprice AS DOUBLE) AS o_totalprice, " + ", ".join(f"CAST({p}(o_orderdate) AS DOUBLE) AS o_orderdate_{p}" for p in ("year", "month", "day", "hour")) + ", "
       + ", ".join(f"CAST(o_orderstatus = '{s}' AS DOUBLE) AS o_orderstatus_{s}" for s in "FOP") + ", " + ", ".join(f"CAST(o_orderpriority = '{p}' AS DOUBLE) AS \"o_orderpriority_{p}\"" for p in _PRIORITIES) + " FROM orders")
def table_vectorizer(spark, sf):
    return value(spark, op(spark, sf, "orders")[["o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]].fit_apply(pl.TableVectorizer()))


@query("SELECT b AS bin, count(*) AS n FROM (SELECT ntile(4) OVER (ORDER BY p_retailprice, p_partkey) AS b FROM part) GROUP BY b")
def qcut_counts(spark, sf):
    df = read(spark, sf, "part").select("p_retailprice", "p_partkey")
    from planloom.sources import with_row_id

    ranked, n = with_row_id(df, ["p_retailprice", "p_partkey"]), df.count()
    size, more = divmod(n, 4)
    at, edge = F.col("__row_id"), more * (size + 1)
    return ranked.select(F.when(at < edge, F.floor(at / (size + 1))).otherwise(F.floor((at - edge) / max(size, 1)) + more).cast("bigint").alias("b")).groupBy((F.col("b") + 1).alias("bin")).agg(F.count("*").alias("n"))


#: The query of the smoke check.
FLAGSHIP = grid_search_2x4
