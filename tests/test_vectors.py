"""Exact top-k: odd vectors, several lengths, blocks, tags and extreme scales, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import vectors

RNG = np.random.default_rng(4)
ROWS = [(i, RNG.normal(size=8).round(2).tolist(), "a" if i % 3 else None) for i in range(120)] + [(i, RNG.normal(size=5).tolist(), "a") for i in range(120, 150)]
ROWS += [(200, None, "a"), (201, [], "a"), (202, [0.0] * 8, "a"), (203, [1.0, None] + [0.0] * 6, "a"), (204, [math.nan] * 8, "a"), (205, [math.inf] + [0.0] * 7, "a"), (206, [1e200] * 8, ""), (207, [1e-200] * 8, "a"), (208, ROWS[1][1], "a")]


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(k, match, skip):
    out = set()
    unit = {i: np.array(v) / max(map(abs, v)) for i, v, _ in ROWS if good(v)}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in unit.items()}
    tag = {i: t or "" for i, _, t in ROWS}
    for q in unit:
        if q % 2 == 0:
            near = sorted((round(float(1 - unit[q] @ v), 6) + 0.0, i) for i, v in unit.items() if len(v) == len(unit[q]) and (not match or tag[i] == tag[q]) and not (skip and i == q))
            out |= {(q, i, d, r + 1) for r, (d, i) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("match, skip, block", [(False, False, 1000), (True, False, 40), (False, True, 25), (True, True, 7)])
def test_top_k_equals_brute_force(spark, match, skip, block):
    df = spark.createDataFrame(ROWS, "id long, vector array<double>, tag string").repartition(3)
    asked = df.filter("id % 2 = 0").withColumnRenamed("id", "query_id")
    got = {tuple(r) for r in vectors.top_k(asked, df, 6, match, skip, block).collect()}
    want = brute(6, match, skip)
    assert {(q, i, r) for q, i, _, r in got} == {(q, i, r) for q, i, _, r in want}
    assert max(abs(a[2] - b[2]) for a, b in zip(sorted(got, key=lambda t: (t[0], t[3])), sorted(want, key=lambda t: (t[0], t[3])))) < 2e-6


def test_blocks_are_bounded_by_bytes_and_empty_tables_work(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 8 * 10)
    df = spark.createDataFrame(ROWS, "id long, vector array<double>, tag string")
    asked = df.filter("id % 2 = 0").withColumnRenamed("id", "query_id")
    assert {(q, i, r) for q, i, _, r in vectors.top_k(asked, df, 4).collect()} == {(q, i, r) for q, i, _, r in brute(4, False, False)}
    assert vectors.top_k(asked, df.limit(0)).count() == vectors.top_k(asked.limit(0), df).count() == 0


def test_pooled_means(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(300, 5))
    rows = [(["a", "b", None][i % 3], v[i].tolist()) for i in range(300)] + [("a", None), ("z", [0.0] * 5)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(4)
    got = {x["k"]: x["pooled"] for x in vectors.mean_pooled(df, ["k"], "v").collect()}
    assert set(got) == {"a", "b", None}
    for i, k in enumerate(("a", "b", None)):
        m = v[i::3].mean(0)
        assert np.allclose(got[k], m / np.sqrt(m @ m))
    assert vectors.mean_pooled(df.limit(0), ["k"], "v").count() == 0
    with pytest.raises(Exception, match="different lengths"):
        vectors.mean_pooled(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], df.schema), ["k"], "v").collect()


def test_pools_of_given_token_vectors(spark):
    rows = [(1, [[1.0, 0.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[1.0, 2.0]], [0]), (3, [], []), (4, [[0.0, 0.0], [5.0, 5.0]], [1, 0]), (5, None, None)]
    df = spark.createDataFrame(rows, "k int, t array<array<double>>, m array<int>")
    got = {r["k"]: r for r in df.select("k", vectors.masked_mean(F.col("t"), F.col("m")).alias("mean"), vectors.first_token(F.col("t")).alias("first")).collect()}
    assert np.allclose(got[1]["mean"], np.array([2.0, 2.0]) / math.sqrt(8)) and got[1]["first"] == [1.0, 0.0]
    assert got[2]["mean"] is None and np.allclose(got[2]["first"], np.array([1.0, 2.0]) / math.sqrt(5))
    assert got[3]["mean"] is got[3]["first"] is got[5]["mean"] is got[5]["first"] is None and got[4]["mean"] == got[4]["first"] == [0.0, 0.0]


def test_a_limited_reranker_scores_its_input_only(spark):
    rows = [(1, i, i, "b" * 200 + "z" * i if i != 7 else "z" * 3) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "query_id int, id int, rank int, full_text string")
    z = lambda t: F.length(t) - F.length(F.replace(t, F.lit("z"), F.lit("")))
    got = [(r["id"], r["found"], r["rank"]) for r in vectors.rerank_limited(df, z).orderBy("rank").collect()]
    assert got == [(7, 7, 1), (1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 4, 5)]
