"""The vector index against the full search, and upserts that leave other files alone."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import vectors
from tracelake.sources import vector_index
from tracelake.sources.keyed import KeyedTable
from tracelake.sources.vector_index import VectorIndex


def clustered(spark, n=3000, dims=16, groups=30, seed=1):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, dims))
    rows = [(i, (centre[i % groups] + 0.35 * r.normal(size=dims)).tolist(), f"t{i % 3}" if i % 7 else None) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, "t0"), (n + 1, [0.0] * dims, "t0"), (n + 2, [float("nan")] * dims, "t1")], "id long, vector array<double>, tag string").repartition(5)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    corpus = clustered(spark).persist()
    path = str(tmp_path_factory.mktemp("index"))
    return corpus, *VectorIndex.build(corpus, path), corpus.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", "tag")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 6)) for r in df.collect())


@pytest.mark.parametrize("match", [False, True])
def test_exact_search_equals_the_full_search(built, match):
    corpus, index, _, queries = built
    assert rows(index.search(queries, 10, probes=2, match=match, exact=True)) == rows(vectors.top_k(queries, corpus, 10, match=match))


def test_recall_and_share(built):
    corpus, index, _, queries = built
    want = {(q, i) for q, _, i, _ in rows(vectors.top_k(queries, corpus, 10))}
    got = {(q, i) for q, _, i, _ in rows(index.search(queries, 10))}
    assert len(want & got) / len(want) >= 0.95 and index.scanned(queries) < 0.3


def test_other_folders_and_tags_are_pruned(built):
    _, index, _, queries = built
    df = index.search(queries.limit(1), 5, probes=2, match=True)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and "PushedFilters: [" in plan and "tag" in plan.split("PushedFilters")[1][:60]


def test_a_large_cell_is_split(spark, built, tmp_path, monkeypatch):
    corpus, _, _, queries = built
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 100)
    index, _ = VectorIndex.build(corpus, str(tmp_path / "one"), cells=1)
    assert index.rows.tolist() == [3000] and len(glob.glob(str(tmp_path / "one/vectors/cell=0/*.parquet"))) > 10
    assert rows(index.search(queries, 10)) == rows(vectors.top_k(queries, corpus, 10))


def test_builds_once_and_by_force(spark, built):
    corpus, index, first, _ = built
    assert first and not VectorIndex.build(corpus, index.path)[1] and VectorIndex.build(corpus, index.path, force=True)[1]
    assert VectorIndex.build(corpus.filter("id > 5"), index.path)[1] and VectorIndex.build(corpus, index.path)[1]


def test_odd_indexes(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vector array<double>")
    index, _ = VectorIndex.build(none, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "query_id long, vector array<double>")
    assert index.search(asked, 3, exact=True).collect() == []
    few, _ = VectorIndex.build(spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 0.0])], none.schema), str(tmp_path / "few"))
    assert rows(few.search(asked, 3, exact=True)) == [(1, 1, 7, 0.552786), (1, 2, 8, 0.552786)]
    with pytest.raises(ValueError):
        VectorIndex.build(spark.createDataFrame([(7, [1.0]), (8, [1.0, 0.0])], none.schema), str(tmp_path / "odd"))


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    t = KeyedTable.create(spark.createDataFrame([(i, f"v{i}", [float(i), 1.0]) for i in range(500)], "id long, name string, vector array<double>"), path, ["id"], buckets=16, vector="vector")
    before = files(path)
    changes = spark.createDataFrame([(3, "new", [0.0, 0.0]), (3, "new", [0.0, 0.0]), (9000, "added", [1.0, 1.0])], "id long, name string, vector array<double>")
    n = t.upsert(changes)
    after = files(path)
    assert n in (1, 2) and len({f.split("_bucket=")[1].split("/")[0] for f in set(before) - set(after)}) <= n
    same = set(before) & set(after)
    assert len(same) >= 14 and all(before[f] == after[f] for f in same)
    got = {r["id"]: r["name"] for r in KeyedTable(spark, path).read().collect()}
    assert got == {**{i: f"v{i}" for i in range(500)}, 3: "new", 9000: "added"}
    assert sorted(r["name"] for r in t.get(spark.createDataFrame([(9000,), (4,), (77777,)], "id long")).collect()) == ["added", "v4"]


def test_upsert_checks_lengths_and_takes_empty_changes(spark, tmp_path):
    rows_ = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<double>")
    t = KeyedTable.create(rows_, str(tmp_path / "t"), ["id"], vector="vector")
    with pytest.raises(ValueError):
        t.upsert(spark.createDataFrame([(1, [1.0])], rows_.schema))
    assert t.upsert(rows_.limit(0)) == 0 and t.read().count() == 1
    with pytest.raises(ValueError):
        KeyedTable.create(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], rows_.schema), str(tmp_path / "u"), ["id"], vector="vector")
