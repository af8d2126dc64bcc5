"""Neighbours by inner product under unequal and extreme norms, in several shards, against brute force."""

import numpy as np
import pytest

from tracelake.llm import ann

RNG = np.random.default_rng(8)
BASE = RNG.normal(size=(6000, 32))


def longer(at, factor):
    x = BASE.copy()
    x[at] *= factor
    return x


CASES = {
    "equal": BASE / np.linalg.norm(BASE, axis=1)[:, None],
    "one x 10^2": longer([77], 1e2),
    "one x 10^4": longer([77], 1e4),
    "one x 10^6": longer([77], 1e6),
    "log-normal": BASE * np.exp(RNG.normal(size=(6000, 1))),
    "some x 10^160": longer([5, 60, 61], 1e160),
    "some x 10^-170": longer([5, 60, 61, 80], 1e-170),
    "all x 10^160": longer(slice(None), 1e160),
    "all x 10^-170": longer(slice(None), 1e-170),
    "any scale": BASE * 10.0 ** RNG.integers(-150, 150, size=(6000, 1)),
}


@pytest.mark.parametrize("case", CASES)
def test_recall(spark, case):
    x = CASES[case]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest(df, every=40, shard_rows=1500).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    with np.errstate(all="ignore"):
        for q in range(0, len(x), 40):
            s = (x * x[q]).sum(1)
            want = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
            found = sorted(got[q])
            assert [f[0] for f in found] == list(range(1, 21))
            assert np.array_equal(np.array([f[2] for f in found]), s[[f[1] for f in found]], equal_nan=True)
            hits += len(set(want) & {f[1] for f in found})
    assert hits >= 0.95 * 20 * len(got) and len(got) == 150
    print(case, hits / 20 / len(got))


def test_shards_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_BYTES", 8 * 32 * 100)
    seen = []
    whole = ann._shard_answers
    monkeypatch.setattr(ann, "_shard_answers", lambda nodes, names, shards, *a: seen.append(shards) or whole(nodes, names, shards, *a))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(BASE[:300])], "vec_id long, embedding array<double>")
    assert ann.nearest(df).count() == 15 * 20 and seen == [3]
