"""Personalized PageRank: both ways against a plain power iteration, and how often the graph travels."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tracelake.operators import graph


def plain(seeds, edges, cap=30, alpha=0.15, rounds=20):
    near, nodes = defaultdict(set), set()
    for a, b, rel in edges:
        nodes |= {a, b}
        if rel in graph.WALK_TYPES and a != b:
            near[a].add(b)
            near[b].add(a)
    out = []
    for q in sorted({q for q, _ in seeds}):
        mine = {i for p, i in seeds if p == q and i in nodes}
        first = {i: 1 / len(mine) for i in mine}
        mass = dict(first)
        for _ in range(rounds):
            new = defaultdict(float)
            for i, m in mass.items():
                for j in near[i] or {i}:
                    new[j] += m * (1 - alpha) / max(len(near[i]), 1)
            for i, m in first.items():
                new[i] += m * alpha
            mass = new
        best = sorted(((-round(m, 9), i) for i, m in mass.items() if i not in mine))[:cap]
        out += [(q, i, 1, -m, k + 1) for k, (m, i) in enumerate(best)]
    return out


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 120), r.choice([0, r.randint(0, 120)]), r.choice(["REFERENCES", "SATISFIES", "MENTIONS"])) for _ in range(260)] + [(500, 500, "REFERENCES"), (600, 601, "MENTIONS")]
    seeds = [(q, r.randint(0, 130)) for q in range(9) for _ in range(4)] + [(20, 500), (21, 600), (22, 9999), (23, 0), (23, 0)]
    e = spark.createDataFrame(edges, "src long, dst long, rel string")
    return seeds, edges, spark.createDataFrame(seeds, "query_id long, id long"), e


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_equals_a_plain_power_iteration(spark, tables, monkeypatch, most):
    monkeypatch.setattr(graph, "MOST_MOVES", most)
    seeds, edges, s, e = tables
    got = sorted(map(tuple, graph.walk_ppr(s, e).collect()))
    want = sorted(plain(seeds, edges))
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want] and all(abs(x[3] - y[3]) < 2e-9 for x, y in zip(got, want))


def test_a_large_graph_is_exchanged_once(spark, tables, monkeypatch):
    monkeypatch.setattr(graph, "MOST_MOVES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = graph.walk_ppr(tables[2], tables[3])
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning(a#" in x]
    assert len([x for x in exchanges if "Reused" not in x]) == 1 and len([x for x in exchanges if "Reused" in x]) == 19


def test_a_graph_of_many_moves_goes_to_the_tasks_and_no_round_is_exchanged(spark, monkeypatch):
    """A ring with chords whose moves are more than a million: what is exchanged doesn't follow from the rounds, and masses are those of
    a plain iteration over the nodes that a few rounds reach."""
    n = 300_000
    e = spark.range(n).selectExpr("id AS src", "(id + 1) % 300000 AS dst", "'REFERENCES' AS rel").union(spark.range(n).selectExpr("id", "(id * 3 + 1) % 300000", "'REFERENCES'"))
    seeds = [(q, i * 1000 + q) for q in range(3) for i in range(3)]
    df = graph.walk_ppr(spark.createDataFrame(seeds, "query_id long, id long"), e, rounds=4)
    got = sorted(map(tuple, df.collect()))
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") < 12
    edges, near = {(a, b, "REFERENCES") for a in range(n) for b in ((a + 1) % n, (a * 3 + 1) % n)}, {i for _, i in seeds}
    by = defaultdict(list)
    for x in edges:
        by[x[0]].append(x)
        by[x[1]].append(x)
    for _ in range(5):
        near |= {i for j in near for x in by[j] for i in x[:2]}
    want = sorted(plain(seeds, {x for j in near for x in by[j]}, rounds=4))
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want] and all(abs(x[3] - y[3]) < 2e-9 for x, y in zip(got, want))


@pytest.mark.parametrize("sparse, step", [(1, 7), (10**9, 7), (16, 1 << 16)])
def test_sparse_and_full_rounds_agree(spark, tables, monkeypatch, sparse, step):
    monkeypatch.setattr(graph, "SPARSE", sparse)
    monkeypatch.setattr(graph, "STEP", step)
    seeds, edges, _, _ = tables
    moves = defaultdict(set)
    for a, b, rel in edges:
        for x, y in ((a, b), (b, a)):
            moves[x] |= {y} if rel in graph.WALK_TYPES and a != b else set()
    pairs = np.array([(a, b) for a in moves for b in moves[a] or {a}])
    g = graph._Graph([(p[:, 0], p[:, 1]) for p in np.array_split(pairs, 5)])
    mine = sorted({i for q, i in seeds if q == 0 and i in moves})
    _, mass = g.masses([{"id": i, "mass": 1 / len(mine)} for i in mine], 0.15, 20)
    want = {i: s for _, i, _, s, _ in plain([(0, i) for i in mine], edges, cap=10**6)}
    assert abs(mass.sum() - 1) < 1e-9 and all(abs(mass[k] - want[i]) < 2e-9 for k, i in enumerate(g.names.tolist()) if i in want)
