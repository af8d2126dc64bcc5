"""Scratch tables, the shared folder, range buckets and ranks."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tracelake import scratch
from tracelake.operators import runs


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda *a: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "localhost-like".replace("local", "remote")):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.shared_dir(fake(master))
        assert scratch.shared_dir(fake(master, "hdfs:///x")) == "hdfs:///x"
    assert os.path.isdir(scratch.shared_dir(fake("local[2]")))


def test_scratch_tables_go_when_told(spark):
    t, u = (scratch.written(spark.range(5), n) for n in ("one", "two"))
    home = scratch._home(spark)
    assert t._scratch.startswith(home) and os.path.isdir(t._scratch) and t.count() == 5
    scratch.forget(t)
    assert not os.path.exists(t._scratch) and u.count() == 5
    scratch.clean(spark)
    assert not os.path.exists(home)


@pytest.mark.parametrize("bounds", [[3], [1, 4, 4 + 2, 2**62], [-1.5, 0.25, 1e300], list(range(0, 60000, 2))])
def test_buckets_count_the_bounds_below(spark, bounds):
    rows = [(float(x),) for x in (-2, -1.5, 0, 0.25, 3, 3.5, 4, 59998, 1e18)] if isinstance(bounds[0], float) else [(x,) for x in (-2, 0, 1, 3, 4, 5, 59998, 2**62)]
    df = spark.createDataFrame(rows, "x double" if isinstance(bounds[0], float) else "x long")
    got = {r["x"]: r["b"] for r in df.withColumn("b", scratch.bucket_of(F.col("x"), bounds)).collect()}
    assert got == {x: sum(b <= x for b in bounds) for (x,) in rows}


def test_weighted_bounds_cut_equal_weights(spark):
    df = spark.range(4000).withColumn("w", F.when(F.col("id") < 100, 97).otherwise(1))
    bounds = scratch.quantile_bounds(df, "id", 8, F.col("w"))
    sums = df.groupBy(scratch.bucket_of(F.col("id"), bounds).alias("b")).agg(F.sum("w").alias("s")).collect()
    assert len(sums) == 8 and max(r["s"] for r in sums) < 1.3 * 13600 / 8


def test_following_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ranges_for", lambda rows: 7)
    rows = [(g, i) for g in ("a", "b", None) for i in range(0, 300, 3)] + [("c", 5)]
    got = {(r["g"], r["i"]): r["next"] for r in scratch.following(spark.createDataFrame(rows, "g string, i long"), "g", "i", "i").collect()}
    assert got == {(g, i): None if i == 297 or g == "c" else i + 3 for g, i in rows}


def test_positions_and_ranks_over_ranges(spark, monkeypatch):
    for m in (scratch, runs):
        monkeypatch.setattr(m, "ranges_for", lambda rows: 5)
    df = spark.range(0, 1000, 7).withColumn("v", F.col("id") % 10)
    got = sorted((r["id"], r["pos"]) for r in runs.row_positions(df, "id").collect())
    assert got == [(i, k) for k, i in enumerate(range(0, 1000, 7))]
    values = sorted(i % 10 for i in range(0, 1000, 7))
    for r in scratch.average_ranks(df.withColumn("g", F.lit(1)), ["g"], "v").collect():
        lo, hi = values.index(r["v"]) + 1, len(values) - values[::-1].index(r["v"])
        assert r["rank"] == (lo + hi) / 2 and r["ties"] == hi - lo + 1


def test_paced_calls_equal_a_loop(spark, monkeypatch):
    import random

    monkeypatch.setattr(runs, "ranges_for", lambda rows: 6)
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "b", None]), float(r.choice([r.randrange(90), 40]))) for i in range(300)]
    got = {x["i"]: x["start"] for x in runs.paced(spark.createDataFrame(rows, "i long, s string, due double").repartition(3), "s", "due", 0.75, ["i"]).collect()}
    last = {}
    for i, s, due in sorted(rows, key=lambda x: (x[2], x[0])):
        last[s] = due if s not in last else max(due, last[s] + 0.75)
        assert abs(got[i] - last[s]) < 1e-9
    assert len(got) == 300


def test_queries_leave_no_folder_behind(spark):
    """What queries write lies in the application's folder and goes with it."""
    from tracelake.plans import catalog, further  # noqa: F401

    scratch.clean(spark)
    before = set(os.listdir(scratch.shared_dir(spark)))
    for name in ("appended_runs", "jsonl_edges", "manifest_last_wins", "csv_runs", "streamed_run_keys", "vector_upsert", "index_top_k"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert set(os.listdir(scratch.shared_dir(spark))) - before == {os.path.basename(scratch._home(spark))}
    scratch.clean(spark)
    assert set(os.listdir(scratch.shared_dir(spark))) == before
