"""The learned router against plain computations, and exact p values against enumeration and published values."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from tracelake.functions import stats
from tracelake.operators import router_model, significance


def table(spark, n=240):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        c = i % 3
        words = ["which", "how many refines", "derives from REQ-1"][c] if rng.random() < 0.6 else "plain"
        rows.append((i, f"{words} {'x ' * int(rng.integers(1, 9))}", (rng.normal(size=6) + 1.2 * np.eye(6)[c]).tolist(), "abc"[c]))
    return router_model.features(spark.createDataFrame(rows, "id long, query string, vector array<double>, target string").repartition(3))


def test_newton_finds_the_minimum():
    rng = np.random.default_rng(1)
    x, y = np.c_[rng.normal(size=(80, 3)), np.ones(80)], np.eye(3)[rng.integers(0, 3, 80)]
    penalty = np.array([1.0, 1.0, 1.0, 0.0])
    w = router_model._newton(x, y, penalty)
    p = np.exp(x @ w)
    p /= p.sum(1, keepdims=True)
    assert np.abs(x.T @ (p - y) + penalty[:, None] * w).max() < 1e-4


def test_every_row_is_predicted_by_models_that_have_not_seen_it(spark):
    x = table(spark)
    got = {r["id"]: r for r in router_model.out_of_fold(x, "target", "id", k=5).collect()}
    assert len(got) == 240 and sum(r["predicted"] == r["target"] for r in got.values()) > 170 and all(1 / 3 <= r["confidence"] <= 1 for r in got.values())
    rows = sorted(router_model.places(x, "target", 42, "id").collect(), key=lambda r: (r["target"], r["place"]))
    assert sorted((r["target"], r["place"]) for r in rows) == [(c, i) for c in "abc" for i in range(80)]
    text, vectors = np.array([r["_x"] for r in rows]), np.array([r["_e"] for r in rows])
    label, fold = np.array(["abc".index(r["target"]) for r in rows]), np.array([r["place"] % 5 for r in rows])
    seen = fold != 2
    models = router_model.train(text[seen], vectors[seen], label[seen], 3)
    p = router_model.scores(models, text[~seen], vectors[~seen])
    for r, row in zip([r for r, s in zip(rows, seen) if not s], p):
        assert got[r["id"]]["predicted"] == "abc"[int(row.argmax())] and abs(got[r["id"]]["confidence"] - row.max()) < 1e-9


def test_cross_validation_and_bounded_samples(spark):
    x = table(spark)
    cv = router_model.cross_validation(x, "target", "id", k=10, repeats=5).collect()
    assert len(cv) == 50 and {r["n"] for r in cv} == {24} and 0.6 < np.mean([r["macro_f1"] for r in cv]) < 1
    small = router_model.out_of_fold(x, "target", "id", k=3, per_class=12).collect()
    assert len(small) == 240 and all(r["predicted"] for r in small)
    none = router_model.out_of_fold(x.limit(0), "target", "id")
    assert none.count() == 0 and router_model.cross_validation(x.limit(0), "target", "id").count() == 0


def test_exact_signed_rank_p_equals_enumeration(spark):
    ranks = [[1.0], [1.0, 2.0], [2.0, 2.0, 2.0], [1.5, 1.5, 3.0, 4.5, 4.5], [float(i) for i in range(1, 10)], [1.0, 2.5, 2.5, 4.0, 6.0, 6.0, 6.0, 8.0]]
    cases = [(r, float(w)) for r in ranks for w in sorted({sum(s) for k in range(len(r) + 1) for s in itertools.combinations(r, k)})]
    df = spark.createDataFrame([*cases, (None, 3.0), ([], 0.0)], "r array<double>, w double")
    got = {(tuple(x["r"] or ()), x["w"]): x["p"] for x in df.withColumn("p", stats.signed_rank_p("r", "w")).collect()}
    for r, w in cases:
        sums = [sum(x for x, s in zip(r, signs) if s) for signs in itertools.product((0, 1), repeat=len(r))]
        low, high = sum(s <= w for s in sums) / len(sums), sum(s >= w for s in sums) / len(sums)
        p = got[tuple(r), w]
        assert abs(p["two"] - min(1, 2 * min(low, high))) < 1e-12 and abs(p["upper"] - high) < 1e-12
    assert got[(2.0, 2.0, 2.0), 4.0]["two"] == 1.0  # three equal differences, one of them negative


def test_cells_of_ties_and_large_cells(spark):
    rows = [("s", "a", "b", float(i % 3), 0.0) for i in range(1, 30)] + [("t", "a", "b", 1.0 + i, 0.0) for i in range(60)] + [("u", "a", "b", 1.0, 1.0)] * 3
    w = {r["stratum"]: r for r in significance.signed_rank_p(significance.wilcoxon(spark.createDataFrame(rows, "stratum string, pipeline_i string, pipeline_j string, x double, y double"), ["stratum"])).collect()}
    assert w["s"]["n_nonzero"] == 20 and w["s"]["exact_p"] == w["s"]["wilcoxon_p"] == 2 / 2**20 and w["s"]["upper_p"] == 1 / 2**20
    assert w["t"]["exact_p"] is None and w["t"]["wilcoxon_p"] < 1e-9 and w["t"]["upper_p"] < 1e-9
    assert w["u"]["wilcoxon_p"] is None and w["u"]["n_nonzero"] == 0


def test_correlation_p(spark):
    #: Published two-sided critical values of Student's t, as correlations: r = t / sqrt(t^2 + n - 2).
    critical = [(12.706, 3, 0.05), (2.776, 6, 0.05), (3.169, 12, 0.01), (2.042, 32, 0.05), (2.750, 32, 0.01)]
    rows = [(t / (t * t + n - 2) ** 0.5, n, p) for t, n, p in critical] + [(-0.5, 2, 0.0), (1.0, 9, 0.0), (0.0, 9, 1.0)]
    for r in spark.createDataFrame(rows, "r double, n long, p double").withColumn("got", stats.correlation_p("r", "n")).collect():
        assert r["got"] is None if r["n"] < 3 else abs(r["got"] - r["p"]) < 2e-4
    one = spark.range(1).select(stats.correlation_p(F.lit(None).cast("double"), F.lit(5)).alias("p")).first()
    assert one["p"] is None


def test_intervals_of_small_and_constant_cells(spark):
    from tracelake.operators import significance

    rows = [("few", float(i % 2), i) for i in range(4)] + [("flat", 1.0, i) for i in range(9)] + [("some", float(i % 3), i) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, v double, i long")
    plain = {r["k"]: r for r in significance.bca_mean(df, ["k"], "v", ["i"]).collect()}
    assert plain["few"]["method"] in ("BCa", "percentile") and plain["flat"]["ci_lo"] is None
    strict = {r["k"]: r for r in significance.bca_mean(df, ["k"], "v", ["i"], least=5, constant_is_point=True).collect()}
    assert (strict["few"]["ci_lo"], strict["few"]["method"]) == (None, "n<5")
    assert (strict["flat"]["ci_lo"], strict["flat"]["ci_hi"], strict["flat"]["method"]) == (1.0, 1.0, "constant")
    assert strict["some"]["ci_lo"] == plain["some"]["ci_lo"] < strict["some"]["mean"] < strict["some"]["ci_hi"]


def test_draws_of_a_tree_are_a_multinomial():
    n = 256 * 37 + 11
    leaves = -(-n // significance.LEAF)
    draws = np.array([significance.leaf_draws(5, n, i, 1000, 3) for i in range(leaves)])
    assert (draws.sum(0) == n).all()
    size = np.array([significance.LEAF] * (leaves - 1) + [11])
    p = size / n
    assert np.abs(draws.mean(1) - n * p).max() < 5 * np.sqrt(n * p.max() / 1000) and np.abs(draws.var(1) / (n * p * (1 - p)) - 1).max() < 0.25
    cov = np.cov(draws[:3])
    assert abs(cov[0, 1] / (-n * p[0] * p[1]) - 1) < 12  # small and negative, within noise


def test_resamples_have_exactly_as_many_draws(spark, monkeypatch):
    from tracelake.operators import significance as sig

    monkeypatch.setattr(sig, "ranges_for", lambda rows: 5)
    rows = [(k, i, float(i % 7)) for k, n in (("a", 1000), ("b", 3), (None, 300)) for i in range(n)] + [("a", 5, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    got = sig.resampled_sums(df, ["k"], "v", ["i"], resamples=200).collect()
    assert len(got) == 600 and {(r["k"], r["w"]) for r in got} == {("a", 1000), ("b", 3), (None, 300)}
    means = np.array([r["s"] / r["w"] for r in got if r["k"] == "a"])
    plain = np.array([x[2] for x in rows if x[0] == "a" and x[2] is not None])
    assert abs(means.mean() - plain.mean()) < 4 * plain.std() / np.sqrt(1000 * 200) and abs(means.std() / (plain.std() / np.sqrt(1000)) - 1) < 0.2
    assert sig.resampled_sums(df.limit(0), ["k"], "v", ["i"]).count() == 0
