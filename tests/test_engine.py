"""Operators on tiny tables."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import planloom as pl
from planloom import sources
from planloom.functions.scalar import spark_pattern
from planloom.operators import linear, text
from planloom.plans import cv
from planloom.plans.cv import KFold, ModuloHoldout, value
from planloom.plans.runtime import Frame, PlanError, RejectColumn
from planloom.streaming import on_stream


@pytest.fixture(scope="module")
def days(spark):
    stamps = [f"2025-11-{d:02d} {h:02d}:30:00" for d, h in zip(range(1, 11), (10, 15, 9, 12, 14, 16, 18, 20, 22, 1), strict=True)]
    return spark.createDataFrame([(i + 1, i + 4, s) for i, s in enumerate(stamps)], "x int, y int, datetime string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scans(spark, tmp_path):
    pd.DataFrame({"a": [1, 2]}).to_csv(tmp_path / "a.csv", index=False)
    (tmp_path / "b.csv").write_text("col;d\n1;x\n2;y\n")
    np.save(tmp_path / "v.npy", np.array([1, 2, 3]))
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    assert rows(value(spark, pl.scan("csv", str(tmp_path / "a.csv")))) == [(1,), (2,)]
    t = pl.scan("csv", pl.param("p"), sep=pl.param("s"))
    assert rows(value(spark, t["col"], {"p": str(tmp_path / "b.csv"), "s": ";"})) == [(1,), (2,)]
    assert rows(value(spark, pl.scan("npy", str(tmp_path / "v.npy")))) == [(0, 1), (1, 2), (2, 3)]
    assert rows(value(spark, pl.scan("npy", str(tmp_path / "m.npy"))))[2] == (2, [4.0, 5.0])
    with pytest.raises(RuntimeError, match="unsupported format"):
        value(spark, pl.scan("xls", "x"))
    with pytest.raises(RuntimeError, match="parameter 'p'"):
        value(spark, t)


def test_columns_stay_aligned_through_derivations(spark, days):
    t = pl.table(days)
    a = t.assign(z=t["x"] + 33)
    b = a.rename({"z": "w"}).drop("datetime")
    out = b.assign(sum=b["w"] + t["y"], old=a["z"])
    assert rows(value(spark, out))[0] == (1, 4, 34, 38, 34)
    swapped = t.assign(x=t["y"], y=t["x"])[["x", "y"]]
    assert rows(value(spark, swapped))[0] == (4, 1)
    other = pl.table(days)
    with pytest.raises(RuntimeError, match="different tables"):
        value(spark, t.assign(q=pl.table(days.limit(3))["x"]))
    assert rows(value(spark, t.assign(q=other["x"])[["q"]]))[0] == (1,)


def test_plan_is_one_projection(spark, days):
    t = pl.table(days)
    a = t.assign(z=t["x"] * 2)
    out = value(spark, a.assign(w=a["z"] + t["y"]).drop("datetime").rename({"w": "v"})[["x", "v"]])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1
    assert "Join" not in plan


def test_item_attribute_and_errors(spark, days):
    t = pl.table(days)
    assert value(spark, t.columns) == ["x", "y", "datetime"]
    assert value(spark, t.shape) == (10, 3)
    assert value(spark, t[t["x"] > 8]).count() == 2
    assert value(spark, (t + 1)["x"] if False else t[["x"]] + 1).first()[0] == 2
    for bad, message in ((t["nope"], "no column"), (t.drop("nope"), "no columns"), (t.rename({"x": "y"}), "same name"), (t["x"].frobnicate(), "no method"), (t.frobnicate(), "no method"), (t["x"].dt.nope, "no date attribute")):
        with pytest.raises(PlanError, match=message):
            value(spark, bad)


def test_operators_on_special_values(spark):
    t = pl.table(spark.createDataFrame([(-7, 0.0, None), (7, -2.0, 1.0)], "a int, b double, c double"))
    a, b = t["a"], t["b"]
    out = t.assign(m=a % 3, d=a // 3, q=a / b, l=np.log(b), s=np.sqrt(b), n=t["c"].isna(), r=4 - a, g=b.fillna(1.0).clip(-1, 1), e=a**2)
    first, second = value(spark, out.drop(["a", "b", "c"])).collect()
    assert (first.m, first.d, first.q, first.l, first.s, first.n, first.r, first.g, first.e) == (2, -3, -np.inf, -np.inf, 0.0, True, 11, 0.0, 49)
    assert (second.m, second.d, second.q) == (1, 2, -3.5)
    assert np.isnan(second.l)
    assert np.isnan(second.s)


def test_dates(spark):
    t = pl.table(spark.createDataFrame([("2025-01-31 23:59:59",), ("2025-01-06 00:00:00",)], "s string"))
    d = t["s"].apply(pd.to_datetime, format="%Y-%m-%d %H:%M:%S")
    out = t.assign(w=d.dt.weekday, e=d.dt.is_month_end, y=d.dt.dayofyear)[["w", "e", "y"]]
    assert rows(value(spark, out)) == [(4, True, 31), (0, False, 6)]
    assert spark_pattern("%d/%m/%Y at %H") == "dd/MM/yyyy 'a''t' HH"
    bad = pl.table(spark.createDataFrame([("nope",)], "s string"))
    assert rows(value(spark, bad["s"].apply_func(pd.to_datetime, errors="coerce"))) == [(None,)]
    with pytest.raises(Exception, match="nope"):
        value(spark, bad["s"].apply_func(pd.to_datetime)).collect()


def test_strings(spark):
    t = pl.table(spark.createDataFrame([(" Ab ",)], "s string"))
    s = t["s"]
    out = t.assign(u=s.str.upper(), n=s.str.len(), t=s.str.strip(), c=s.str.contains("b"), p=s.str.slice(1, 3), r=s.str.replace("A", "x")).drop("s")
    assert rows(value(spark, out)) == [(" AB ", 4, "Ab", True, "Ab", " xb ")]


def test_functions_of_values_frames_and_rows(spark, days):
    t = pl.table(days)[["x", "y"]]
    assert rows(value(spark, t["x"].apply(lambda v: v * 1.5)))[1] == (3.0,)
    assert rows(value(spark, t.apply(lambda c: c * 2)))[1] == (4, 10)
    assert rows(value(spark, t.apply_rows(lambda pdf: pdf["x"] * 10.0 + pdf["y"])))[0] == (14.0,)
    assert value(spark, np.heaviside(t["x"] - 5.0, 0.5)).collect()[4][0] == 0.5
    assert value(spark, t.apply_func(lambda df, n: df.limit(n), 3)).count() == 3


def test_types_and_rows_of_functions(spark):
    import datetime

    t = pl.table(spark.createDataFrame([(1, "a", 2.5), (2, None, None), (3, "c", -1.0)], "k int, s string, x double"))
    got = lambda op: [r[0] for r in value(spark, op).collect()]
    assert got(t["s"].apply(lambda v: v + "!")) == ["a!", None, "c!"]
    assert got(t["k"].apply(lambda v: f"n{v}")) == ["n1", "n2", "n3"]
    assert got(t["k"].apply(lambda v: v > 1)) == [False, True, True]
    assert got(t["k"].apply(lambda v: datetime.date(2020, 1, v))) == [datetime.date(2020, 1, d) for d in (1, 2, 3)]
    assert got(t["s"].apply(lambda v: len(v), returns="int")) == [1, None, 1]
    assert got(t["x"].apply(lambda v: 0.0 if v != v else v)) == [2.5, 0.0, -1.0]
    assert got(t[["x"]].apply(lambda c: c.fillna(0.0) + 1)) == [3.5, 1.0, 0.0]
    assert got(t["x"].pow(2))[0] == 6.25
    assert got(t["s"].replace("a", "z")) == ["z", None, "c"]

    def to_datetime(v):
        return v + "?"

    assert got(t["s"].apply(to_datetime)) == ["a?", None, "c?"]
    for bad in (t["k"].cumsum(), t[["k"]].apply(lambda c: c - c.mean())):
        with pytest.raises(RuntimeError, match="depends on that row alone"):
            got(bad)


def test_apply_options(spark):
    class Picky:
        def fit(self, x, y):
            if len(x.cols) != 1:
                raise ValueError("one column")
            if dict(x.df().dtypes)[next(iter(x.cols))] == "string":
                raise RejectColumn("no text")
            assert y is None
            return None

        def transform(self, state, x):
            return Frame(x.rows, {f"{n}_2": c * 2 for n, c in x.cols.items()})

    t = pl.table(spark.createDataFrame([(1, "a", 2.5, 1.0)], "k int, s string, x double, y double"))
    x = t.drop("y")
    out = value(spark, x.fit_apply(Picky(), y=t["y"], how="cols", allow_reject=True, unsupervised=True))
    assert out.columns == ["k_2", "s", "x_2"]
    assert rows(out) == [(2, "a", 5.0)]
    assert value(spark, x.fit_apply(Picky(), cols=["x"], how="cols")).columns == ["k", "s", "x_2"]
    for bad in ({"how": "cols"}, {}, {"how": "no"}, {"how": "no_wrap", "cols": ["x"]}):
        with pytest.raises(RuntimeError):
            value(spark, x.fit_apply(Picky(), **bad))


def test_numpy_files_are_read_by_runs(spark, tmp_path, monkeypatch):
    from planloom import sources

    monkeypatch.setattr(sources, "NPY_RUN", 400)
    monkeypatch.setattr(sources, "NPY_HELD", 96)
    for k, a in enumerate((np.arange(1000), np.random.default_rng(0).normal(size=(77, 3)), np.zeros((0, 2)), np.arange(5, dtype=np.float32), np.array([True, False]))):
        path = str(tmp_path / f"{k}.npy")
        np.save(path, a)
        df = value(spark, pl.scan("npy", path))
        got = sorted((r.row_id, r.value) for r in df.collect())
        assert [i for i, _ in got] == list(range(len(a)))
        assert np.allclose(np.array([v for _, v in got], float).reshape(a.shape), a)
    np.save(tmp_path / "bad.npy", np.zeros((2, 2, 2)))
    with pytest.raises(RuntimeError, match="one or two dimensions"):
        value(spark, pl.scan("npy", str(tmp_path / "bad.npy")))


def test_ties_of_a_key_are_not_one_range(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(4000)], "i int, k int")
    got = sources.with_row_id(df, ["k"])
    assert sorted(r["__row_id"] for r in got.collect()) == list(range(4000))
    assert max(r.k * 10000 + r["__row_id"] for r in got.collect() if not r.k) < 2000


def test_searches_read_test_rows_once(spark, days):
    """Statistics of folds from those of parts, and one read of the table for all variants."""
    rng = np.random.default_rng(3)
    data = [(int(i), float(a), float(b), float(2 * a - b + e)) for i, (a, b, e) in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(data, "k int, a double, b double, y double")
    t = pl.table(df)
    x, y = t[["k", "a", "b"]].mark_x(), t["y"].mark_y()
    f = x[["a", "b"]]
    preps = {"plain": f, "scaled": f.fit_apply(pl.StandardScaler()), "few": f.fit_apply(pl.StandardScaler(), cols="a")}
    models = {"mean": pl.DummyRegressor(), "ols": pl.LinearRegression(), "lasso": pl.Lasso(0.1)}
    plan = pl.choose_from({m: pl.choose_from(preps, name="prep").fit_apply(e, y=y) for m, e in models.items()}, name="model")
    found = pl.grid_search(spark, plan, cv=pl.KFold(4, "k", "mod"), scoring="mse", return_predictions=True)
    m = np.array(data)
    scores = {"ols": [], "mean": [], "scaled": []}
    for k in range(4):
        train, test = m[m[:, 0] % 4 != k], m[m[:, 0] % 4 == k]
        w = np.linalg.lstsq(np.c_[np.ones(len(train)), train[:, 1:3]], train[:, 3], rcond=None)[0]
        scores["ols"].append(((np.c_[np.ones(len(test)), test[:, 1:3]] @ w - test[:, 3]) ** 2).mean())
        scores["mean"].append(((train[:, 3].mean() - test[:, 3]) ** 2).mean())
    got = {r.id: r.scores for r in found.results.collect()}
    assert len(got) == 9
    for p in preps:
        assert np.isclose(got[f"prep:{p}, model:ols"], np.mean(scores["ols"]))
        assert np.isclose(got[f"prep:{p}, model:mean"], np.mean(scores["mean"]))
    assert got["prep:plain, model:lasso"] != got["prep:scaled, model:lasso"]
    assert found.predictions.count() == 9 * 200
    assert found.results._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_concat(spark):
    a, b = pl.table(spark.createDataFrame([(1,), (2,)], "a int")), pl.table(spark.createDataFrame([(3, "x"), (4, "y")], "a int, b string"))
    assert sorted(rows(value(spark, a.concat([b]))), key=str) == [(1, None), (2, None), (3, "x"), (4, "y")]
    text_and_number = value(spark, a.concat([b.drop("a").rename({"b": "a"})]))
    assert sorted(rows(text_and_number)) == [("1",), ("2",), ("x",), ("y",)]
    with pytest.raises(RuntimeError, match="several tables"):
        value(spark, a.concat([a], axis=1))


def test_row_ids_follow_the_key(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    got = {r["k"]: r["__row_id"] for r in sources.with_row_id(df, ["k"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))}


def regression(n=300, p=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(5, 2, (n, p))
    return x, x @ np.arange(1, p + 1) + 4 + rng.normal(0, 0.5, n)


def plain_fit(x, y, model):
    n = len(x)
    mx, my = x.mean(0), y.mean()
    c, t = (x - mx).T @ (x - mx) / n, (x - mx).T @ (y - my) / n
    if isinstance(model, pl.Ridge):
        w = np.linalg.solve(c + model.alpha / n * np.eye(len(t)), t)
    elif isinstance(model, pl.ElasticNet):
        w, step = np.zeros(len(t)), 1 / np.linalg.eigvalsh(c).max()
        for _ in range(20000):  # proximal gradient
            z = w - step * (c @ w - t + model.alpha * (1 - model.l1_ratio) * w)
            w = np.sign(z) * np.maximum(np.abs(z) - step * model.alpha * model.l1_ratio, 0)
    else:
        w = np.linalg.lstsq(c, t, rcond=None)[0]
    return my - mx @ w, w


@pytest.mark.parametrize("model", [pl.LinearRegression(), pl.Ridge(20.0), pl.Lasso(0.7), pl.ElasticNet(0.9, 0.4)])
@pytest.mark.parametrize("p", [3, linear.FEW + 2])
def test_linear_models_against_numpy(spark, model, p):
    x, y = regression(p=p)
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"x{i}" for i in range(p)]).assign(y=y, k=range(len(x))))
    t = pl.table(df)
    pred = t.drop("y").mark_x().drop("k").fit_apply(model, y=t["y"].mark_y())
    got = pl.grid_search(spark, pred, cv=KFold(3, "k", "mod")).results.first()["scores"]
    part = np.arange(len(x)) % 3
    expected = []
    for f in range(3):
        b, w = plain_fit(x[part != f], y[part != f], model)
        expected.append(np.mean((y[part == f] - b - x[part == f] @ w) ** 2))
    assert abs(got - np.mean(expected)) < 1e-5 * max(1, np.mean(expected))


def test_search_over_two_pipelines_and_predictions(spark, days):
    t = pl.table(days)
    x, y = t[["x", "datetime"]].mark_x(), t["y"].mark_y()

    def pipeline(parts, seed):
        x1 = x.assign(datetime=x["datetime"].apply(pd.to_datetime, format="%Y-%m-%d %H:%M:%S"))
        x2 = x1.assign(**{p: getattr(x1["datetime"].dt, p) for p in parts})
        return x2.drop(["datetime"]).fit_apply(pl.RandomForestRegressor(trees=3, depth=2, seed=seed), y=y)

    plan = pl.choose_from({"one": pipeline(["year", "month"], 42), "two": pipeline(["month", "dayofweek", "hour"], 7)}, name="p")
    found = pl.grid_search(spark, plan, cv=KFold(2, "x", "mod"), scoring="neg_mean_squared_error", return_predictions=True)
    got = found.results.collect()
    assert {r["id"] for r in got} == {"p:one", "p:two"}
    assert got[0]["scores"] <= got[1]["scores"]
    assert found.predictions.count() == 20
    assert any("fit" in name for name, _, _ in found.heavy_hitters)


def test_fold_states_see_training_rows_only(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "b", 5.0), (3, "c", 7.0)], "k int, g string, y double")
    t = pl.table(df)
    x, y = t[["k", "g"]].mark_x(), t["y"].mark_y()
    pred = x[["g"]].fit_apply(pl.TargetEncoder(), y=y)
    out = pl.grid_search(spark, pred, cv=KFold(2, "k", "mod"), return_predictions=True).predictions
    got = {r["y_true"]: r["y_pred"] for r in out.collect()}
    assert got == {1.0: 3.0, 5.0: 5.0, 3.0: 1.0, 7.0: 3.0}
    with_ohe = x[["g"]].fit_apply(pl.OneHotEncoder()).fit_apply(pl.Ridge(0.1), y=y)
    assert pl.grid_search(spark, with_ohe, cv=KFold(2, "k", "mod")).results.first()["scores"] > 0


def test_modes_marks_and_messages(spark, days):
    t = pl.table(days)
    x, y = t[["x"]].mark_x(), t["y"].mark_y()
    for plan in (pl.literal(True).apply_func(lambda a: a), t[["x"]].fit_apply(pl.DummyRegressor(), y=y), x.fit_apply(pl.DummyRegressor(), y=t["y"])):
        with pytest.raises(RuntimeError, match="X and y nodes not found in the DAG"):
            pl.grid_search(spark, plan)
    broken = x.fit_apply(pl.DummyRegressor(), y=y).apply_func(lambda v, mode: v if mode != "predict" else int("grr"), pl.eval_mode())
    with pytest.raises(RuntimeError, match=r"^\[predict\] Error processing"):
        pl.grid_search(spark, broken)
    with pytest.raises(ValueError, match="unknown scoring"):
        pl.grid_search(spark, x, scoring="nope")
    added = (x + pl.choose_from([0, 1], name="add")).fit_apply(pl.DummyRegressor(), y=y)
    assert pl.grid_search(spark, added, cv=KFold(3, "x", "mod")).results.count() == 2
    own = pl.Scorer(lambda y, p: F.max(F.abs(y - p)), greater_is_better=False)
    assert pl.grid_search(spark, added, cv=3 if False else KFold(3, "x", "mod"), scoring=own).results.count() == 2
    assert pl.grid_search(spark, x.fit_apply(pl.DummyRegressor(), y=y), cv=3).results.count() == 1
    held = pl.evaluate(spark, x.fit_apply(pl.DummyRegressor(), y=y), ModuloHoldout(5, "x"))
    assert held.count() == 2
    assert pl.evaluate(spark, pl.choose_from([1, 2.5]) + 5) == {"Choice0:1": 6, "Choice0:2.5": 7.5}


def test_stats_and_custom_estimator(spark, days, capsys):
    class Middle:
        def fit(self, x, y):
            return None

        def transform(self, state, x):
            return x.series("x")

    t = pl.table(days)
    pred = t[["x"]].mark_x().fit_apply(Middle(), y=t["y"].mark_y())
    with pl.config(stats=True, stats_top_k=2):
        found = pl.grid_search(spark, pred, cv=2, scoring="mae")
    assert "Heavy hitters" in capsys.readouterr().out
    assert len(found.heavy_hitters) == 2
    assert found.results.first()["scores"] == 3.0


def test_one_hot(spark):
    df = spark.createDataFrame([("x", "c"), ("y", "c"), ("x", "d"), (None, "e"), ("z", "d"), ("y", None)], "a string, b string")
    out = value(spark, pl.table(df).fit_apply(pl.OneHotEncoder(drop="if_binary")))
    assert out.columns == ["a_x", "a_y", "a_z", "b_c", "b_d", "b_e"]
    assert rows(out)[0] == (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    assert rows(out)[3] == (0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    many = spark.range(300).select(F.col("id").cast("string").alias("a"))
    with pytest.raises(RuntimeError, match="more than 200 categories"):
        value(spark, pl.table(many).fit_apply(pl.OneHotEncoder()))
    with pytest.raises(RuntimeError, match="if_binary"):
        value(spark, pl.table(df).fit_apply(pl.OneHotEncoder(drop="first")))


def tokens(s, analyzer, low, high):
    s = f" {s} " if analyzer == "char_wb" else s
    return [s[i : i + n] for n in range(low, high + 1) for i in range(len(s) - n + 1)]


def tfidf(strings, features):
    """Dense rows of length one."""
    counts = np.zeros((len(strings), features))
    for i, s in enumerate(strings):
        for t in tokens(s or "", "char_wb", 3, 4):
            counts[i, int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % features] += 1
    m = counts * (np.log((1 + len(strings)) / (1 + (counts > 0).sum(0))) + 1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


STRINGS = ["Foo bar baz", "bar   baz!!!", "", None, "lorem ipsum dolor sit amet", "BaZ foo BAR", "foo", "test string encoding", "another test case"]


def test_tokens_are_the_same_on_both_sides(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*STRINGS, "héy 你好", "ab"])], "i int, s string")
    for analyzer, low, high in (("char", 2, 3), ("char", 3, 5), ("char_wb", 3, 4), ("char", 1, 8)):
        got = {r["i"]: list(r["t"]) for r in df.select("i", text.ngrams(F.col("s"), analyzer, low, high).alias("t")).collect()}
        for i, s in enumerate([*STRINGS, "héy 你好", "ab"]):
            assert got[i] == tokens(s or "", analyzer, low, high)


def test_string_encoder_keeps_the_geometry(spark):
    df = spark.createDataFrame([(s,) for s in STRINGS], "s string")
    encoder = pl.StringEncoder(components=9, buckets=1 << 12)
    f = Frame.of(df)
    state = encoder.fit(f)
    z = np.array([list(r) for r in encoder.transform(state, f).df().collect()])
    assert z.shape == (9, 9)
    bits = text._signs(42, 1 << 12)
    y = tfidf(STRINGS, 1 << 12) @ (1.0 - 2.0 * ((bits[:, None] >> np.arange(encoder.width, dtype=np.uint64)) & np.uint64(1)))
    own = y @ text.top_directions(y.T @ y, 9)
    assert np.allclose(z, own / np.sqrt(own.var(0).sum()), atol=1e-9)
    assert np.allclose(own @ own.T, y @ y.T, atol=1e-8)  # nine rows have rank nine at most
    new = encoder.transform(state, Frame.of(spark.createDataFrame([("foo",), (None,), ("zzz",)], "s string"))).df().collect()
    assert np.allclose(list(new[0]), z[6])
    assert np.allclose(list(new[1]), z[2])


def test_string_encoder_of_nothing_and_padding(spark):
    for values in ([""], ["", None], ["a", "b"]):
        df = spark.createDataFrame([(v,) for v in values], "s string")
        z = value(spark, pl.table(df).fit_apply(pl.StringEncoder(components=30, buckets=1 << 10))).collect()
        assert len(z[0]) == 30
        assert np.isfinite(np.array([list(r) for r in z])).all()
    with pytest.raises(ValueError):
        pl.StringEncoder(components=60)
    with pytest.raises(ValueError):
        pl.StringEncoder(analyzer="word")


def test_truncated_svd_against_numpy(spark):
    texts = [f"text {i % 7} number {i % 11} of some {i % 3}" for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    sigma, right, idf = text.truncated_svd(df, "s", 5, features=256)
    m = tfidf(texts, 256)
    u, s, _ = np.linalg.svd(m)
    assert np.allclose(sigma, s[:5], rtol=1e-4)
    assert np.allclose(np.linalg.norm(m @ right, axis=0), s[:5], rtol=1e-4)
    new = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:9], "text 3 of none", "", None])], "i int, s string")
    got = {r.row_id: list(r["values"]) for r in text.svd_transform(new, "i", "s", right, idf).collect()}
    assert np.allclose([got[i] for i in range(9)], m[:9] @ right, atol=1e-9)
    assert not np.any([got[10], got[11]])
    assert not text.truncated_svd(spark.createDataFrame([("",), (None,)], "s string"), "s", 2, features=64)[0].any()
    with pytest.raises(ValueError):
        text.truncated_svd(df, "s", 0)


def test_string_encoder_by_svd(spark):
    """Distances of rows are those of the TF-IDF's best approximation, scaled; and it is fitted on each fold's training rows."""
    texts = [f"text {i % 7} number {i % 11} of some {i % 3}" for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    encoder = pl.StringEncoder(components=4, buckets=256, reduction="svd")
    f = Frame.of(df)
    z = np.array([list(r) for r in encoder.transform(encoder.fit(f), f).df().collect()])
    u, s, _ = np.linalg.svd(tfidf(texts, 256))
    best = u[:, :4] * s[:4]
    assert np.allclose(z @ z.T, best @ best.T / best.var(0).sum(), atol=1e-4)
    t = pl.table(spark.createDataFrame([(i, t, float(i % 7)) for i, t in enumerate(texts)], "k int, s string, y double"))
    x, y = t[["k", "s"]].mark_x(), t["y"].mark_y()
    plan = x.drop("k").fit_apply(pl.StringEncoder(components=16, buckets=256, reduction="svd")).fit_apply(pl.Ridge(0.1), y=y)
    assert pl.grid_search(spark, plan, cv=pl.KFold(3, "k", "mod"), scoring="r2").results.first()["scores"] > 0.2
    with pytest.raises(ValueError):
        pl.StringEncoder(reduction="none")


def test_table_vectorizer(spark):
    df = spark.createDataFrame([(1.5, "a", "2025-01-02", f"text {i}") for i in range(50)], "n double, low string, d string, high string").withColumn("d", F.to_timestamp("d"))
    out = value(spark, pl.table(df).fit_apply(pl.TableVectorizer(high=pl.StringEncoder(components=2, buckets=256))))
    assert out.columns == ["n", "d_year", "d_month", "d_day", "d_hour", "low_a", "high_0", "high_1"]
    assert rows(out)[0][:6] == (1.5, 2025.0, 1.0, 2.0, 0.0, 1.0)


def test_standard_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert rows(value(spark, pl.table(df).fit_apply(pl.StandardScaler()))) == [(-1.0, 0.0), (1.0, 0.0)]


def test_streams_run_row_local_plans(spark, days, tmp_path):
    days.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(days.schema).parquet(str(tmp_path / "in"))
    t = pl.param("stream")
    plan = t.assign(z=np.sqrt(t["x"] * 4))
    plan = plan[plan["z"] > 4][["x", "z"]]
    query = on_stream(plan, stream).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("streamed").count() == 6
    with pytest.raises(ValueError, match="row by row"):
        on_stream(t.groupby("x"), stream)


def test_preview_and_choice_before_a_numeric_node(spark, days):
    t = pl.table(days).subsample(4)
    assert value(spark, t).count() == 10
    assert value(spark, t, preview=True).count() == 4
    assert t.preview(spark, 2).count() == 2
    assert t.run(spark).count() == 10
    assert "subsample" in t.to_dot()
    assert t[["x"]].mark_x().fit_apply(pl.DummyRegressor(), y=t["y"].mark_y()).grid_search(spark, cv=2).results.count() == 1
    plan = np.log(pl.choose_from({"a": t["x"], "b": t["y"]}, name="c"))
    assert len(pl.evaluate(spark, plan)) == 2


def test_scorers():
    assert {"mse", "rmse", "mae", "r2", "rmsle"} <= set(cv.SCORERS)
    for bad in ({"splits": 1}, {"method": "nope"}, {"method": "mod"}):
        with pytest.raises(ValueError):
            KFold(**bad)
