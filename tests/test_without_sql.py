"""Registered queries that SQL can't express, against numpy or a plainer model."""

import hashlib

import numpy as np
import pandas as pd

from planloom import queries
from planloom.operators import text


def lineitem(data):
    return pd.read_parquet(f"{data}/lineitem.parquet")


def scores(y, p):
    return 1 - ((y - p) ** 2).mean() / y.var()


def descent(x, y, l1, l2):
    """Minimises |y - xw|^2 / 2n + l1 |w| + l2 w'w / 2 over the rows, coordinate by coordinate."""
    w, n = np.zeros(x.shape[1]), len(y)
    rest = y - x @ w
    for _ in range(3000):
        before = w.copy()
        for i in range(len(w)):
            rest += x[:, i] * w[i]
            c = x[:, i] @ rest / n
            w[i] = np.sign(c) * max(abs(c) - l1, 0) / (x[:, i] @ x[:, i] / n + l2)
            rest -= x[:, i] * w[i]
        if np.abs(w - before).max() < 1e-13:
            break
    return w


def test_grid_search_rich(spark, data):
    t = lineitem(data)
    price = t.l_extendedprice / 1000
    x = np.column_stack([t.l_quantity, price, t.l_discount, t.l_tax, *[t.l_returnflag == f for f in "ANR"], t.l_linestatus == "O"]).astype(float)
    y, fold = (t.l_extendedprice * (1 - t.l_discount) * (1 + t.l_tax) / 1000).to_numpy(), t.l_orderkey.to_numpy() % 3
    solve = {
        "ols": lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0],
        "ridge": lambda a, b: np.linalg.solve(a.T @ a + np.eye(a.shape[1]), a.T @ b),
        "lasso": lambda a, b: descent(a, b, 0.1, 0.0),
        "enet": lambda a, b: descent(a, b, 0.05, 0.05),
    }
    got = {r["id"]: r["scores"] for r in queries.QUERIES["grid_search_rich"](spark, data).collect()}
    assert len(got) == 4
    for name, f in solve.items():
        each = []
        for k in range(3):
            train, test = fold != k, fold == k
            mx, my = x[train].mean(0), y[train].mean()
            each.append(scores(y[test], (x[test] - mx) @ f(x[train] - mx, y[train] - my) + my))
        assert np.isclose(got[f"model:{name}"], np.mean(each), atol=6e-5), name  # they are rounded to four digits


def test_trees_beat_the_mean(spark, data):
    """Few shallow trees: a forest explains a good part of the held-out variance, boosting nearly all."""
    for name, least in (("model_rf", 0.4), ("model_gbt", 0.85)):
        (row,) = queries.QUERIES[name](spark, data).collect()
        assert least < row["scores"] < 1.0


def tfidf(texts, buckets):
    """Dense rows over the buckets that occur."""
    hashed = []
    for s in texts:
        t = f" {s} "
        hashed.append([int(hashlib.md5(t[i : i + n].encode()).hexdigest()[:8], 16) % buckets for n in (3, 4) for i in range(len(t) - n + 1)])
    known = {b: i for i, b in enumerate(sorted({b for h in hashed for b in h}))}
    m = np.zeros((len(texts), len(known)))
    for i, h in enumerate(hashed):
        for b in h:
            m[i, known[b]] += 1
    m *= np.log((1 + len(texts)) / (1 + (m > 0).sum(0))) + 1
    return m / np.linalg.norm(m, axis=1, keepdims=True), np.array(sorted(known))


def scaled(z):
    return z / np.sqrt(z.var(0).sum())


def products(df, prefix=""):
    """The rows' inner products, which no sign of a direction changes, in no order of the rows."""
    z = np.array([[v for n, v in r.asDict().items() if n.startswith(prefix) and n != "row_id"] for r in df.collect()])
    return np.sort((z @ z.T).ravel()), z


def test_string_encoders(spark, data):
    part = pd.read_parquet(f"{data}/part.parquet")
    m, known = tfidf(part.p_name, text.BUCKETS)
    bits = text._signs(42, text.BUCKETS)[known]
    y = m @ (1.0 - 2.0 * ((bits[:, None] >> np.arange(46, dtype=np.uint64)) & np.uint64(1)))
    own = scaled(y @ text.top_directions(y.T @ y, 30))
    got, z = products(queries.QUERIES["string_encode_shape"](spark, data))
    assert z.shape == (len(part), 30)
    assert np.allclose(got, np.sort((own @ own.T).ravel()), atol=1e-7)
    both = products(queries.QUERIES["string_encode_cols"](spark, data), "p_name")[0]
    assert np.allclose(both, got, atol=1e-7)


def test_singular_vectors(spark, data):
    part = pd.read_parquet(f"{data}/part.parquet")
    m, _ = tfidf(part.p_name, text.SVD_BUCKETS)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    sigma = [r.sigma for r in queries.QUERIES["tsvd"](spark, data).orderBy("i").collect()]
    assert np.allclose(sigma[:10], s[:10], rtol=1e-2)
    assert (np.array(sigma) <= s[:30] * (1 + 1e-9)).all()
    _, z = products(queries.QUERIES["tsvd_transform"](spark, data))
    assert np.allclose(np.linalg.norm(z, axis=0), sigma, rtol=1e-6)
    _, e = products(queries.QUERIES["string_encode_svd"](spark, data))
    assert np.isclose(e.var(0).sum(), 1.0)
    best = scaled(u[:, :10] * s[:10])
    assert np.corrcoef(np.sort((e @ e.T).ravel()), np.sort((best @ best.T).ravel()))[0, 1] > 0.95
