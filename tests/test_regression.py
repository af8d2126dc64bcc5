"""Logistic models and principal components against plain fits."""

import numpy as np
import pytest

from tracelake.operators import regression


def plain(x, y, rounds=60):
    x = np.column_stack((np.ones(len(x)), x))
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (p * (1 - p))[:, None]).T @ x
        beta += np.linalg.solve(h, x.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_logistic_equals_a_plain_fit(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(900, 4))
    y = r.random(900) < 1 / (1 + np.exp(-(0.4 + x @ [1.0, -2.0, 0.0, 0.5])))
    key = ["a", "b", None]
    rows = [(key[i % 3], *map(float, x[i]), bool(y[i])) for i in range(900)] + [("a", None, 0.0, 0.0, 0.0, True), ("b", 1.0, 1.0, 1.0, 1.0, None)]
    rows += [("sep", float(i), 0.5 * (i % 3), 1.0 * (i % 2), 0.3 * (i % 5), i > 10) for i in range(20)] + [("flat", 1.0, 1.0, float(i % 2), float(i % 3), i % 4 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, p double, q double, r double, s double, y boolean").repartition(4)
    got = {m["key"]: m for m in regression.logistic(df, ["key"], ["p", "q", "r", "s"], "y").collect()}
    for k, name in enumerate(key):
        beta, error = plain(x[k::3], y[k::3].astype(float))
        t = got[name]["terms"]
        assert [v["term"] for v in t] == ["intercept", "p", "q", "r", "s"] and got[name]["n"] == 300
        assert np.allclose([v["coefficient"] for v in t], beta, atol=1e-6) and np.allclose([v["error"] for v in t], error, atol=1e-6)
    assert all(v["coefficient"] is None for name in ("sep", "flat") for v in got[name]["terms"]) and len(got) == 5


def test_logistic_without_keys_or_rows(spark):
    df = spark.createDataFrame([(float(i % 5), i % 3 == 0) for i in range(60)], "x double, y boolean")
    (m,) = regression.logistic(df, [], ["x"], "y").collect()
    beta, _ = plain(np.array([[i % 5] for i in range(60)], float), np.array([i % 3 == 0 for i in range(60)], float))
    assert np.allclose([t["coefficient"] for t in m["terms"]], beta, atol=1e-6)
    assert regression.logistic(df.limit(0), [], ["x"], "y").count() == 0


def test_components_equal_a_plain_svd(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 6)) @ r.normal(size=(6, 6)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6)], "id long, v array<double>").repartition(5)
    mean, axes, values = regression.principal_components(df, "v", 3)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(mean, x.mean(0)) and np.allclose(values, s[:3] ** 2 / 500) and np.allclose(np.abs((axes * vt[:3]).sum(1)), 1)
    got = {p["id"]: p["projection"] for p in regression.projected(df, "v", mean, axes).collect()}
    assert got[900] is None and got[901] is None and all(np.allclose(got[i], (x[i] - x.mean(0)) @ axes.T) for i in range(500))
    assert regression.moments(df.limit(0), "v")[0] == 0
    with pytest.raises(Exception, match="different lengths"):
        regression.moments(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v")
