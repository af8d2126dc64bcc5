"""Two-step walks: against brute force, and past hubs."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import graph


def brute(seeds, edges, cap):
    near = {}
    for a, b, rel in edges:
        if rel in graph.WALK_TYPES and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for q in {q for q, _ in seeds}:
        mine = {i for p, i in seeds if p == q}
        one = set().union(*(near.get(i, set()) for i in mine)) - mine
        two = set().union(*(near.get(i, set()) for i in one)) - mine - one
        found = [(1, i) for i in sorted(one)] + [(2, i) for i in sorted(two)]
        out += [(q, i, h, k + 1) for k, (h, i) in enumerate(found[:cap])]
    return sorted(out)


@pytest.mark.parametrize("cap", [1, 3, 30])
def test_walks_equal_brute_force(spark, cap):
    r = random.Random(cap)
    edges = [(r.randint(0, 60), r.choice([0, 1, r.randint(0, 60)]), r.choice(["REFINES", "VERIFIES", "MENTIONS"])) for _ in range(150)]
    seeds = [(q, r.randint(0, 70)) for q in range(25) for _ in range(1 + q % 5)] + [(30, 0), (30, 0), (31, 999)]
    got = graph.walk_2hop(spark.createDataFrame(seeds, "query_id long, id long"), spark.createDataFrame(edges, "src long, dst long, rel string"), cap=cap)
    assert sorted(map(tuple, got.collect())) == brute(seeds, edges, cap)


def test_a_hub_is_not_expanded(spark):
    leaves = 1_000_000
    star = spark.range(1, leaves + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("REFINES").alias("rel"))
    seeds = spark.createDataFrame([(1, 0), (2, 77), (3, 0), (3, 1)], "query_id long, id long")
    df = graph.walk_2hop(seeds, star)
    got = sorted(map(tuple, df.collect()))
    assert got == sorted([(1, i, 1, i) for i in range(1, 31)] + [(2, 0, 1, 1)] + [(2, i, 2, i + 1) for i in range(1, 30)] + [(3, i, 1, i - 1) for i in range(2, 32)])
    plan, rows = df._jdf.queryExecution().executedPlan(), []
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()

    def walk(p):
        m, name = p.metrics(), p.nodeName()
        if "Join" in name and m.contains("numOutputRows"):
            rows.append((name, m.apply("numOutputRows").value()))
        stage = p.getClass().getSimpleName()
        below = [p.plan()] if stage.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        for c in below:
            walk(c)

    walk(plan)
    assert rows and max(n for name, n in rows if "LeftSemi" not in name) <= 2 * leaves + 10  # the links themselves, semi-joined once
    assert sorted(n for _, n in rows)[-2] < 1000 or sorted(n for _, n in rows)[-1] < 1000


def plain_paths(edges, least, most):
    out, grown = [], [([a, b], [r], [i]) for i, (a, b, r) in enumerate(edges) if r in graph.WALK_TYPES]
    for hops in range(1, most + 1):
        if hops >= least:
            out += [(*n, *r) for n, r, _ in grown if n[0] != n[-1]]
        grown = [([*n, b], [*r, rel], [*u, i]) for n, r, u in grown for i, (a, b, rel) in enumerate(edges) if rel in graph.WALK_TYPES and a == n[-1] and i not in u]
    return sorted(out)


@pytest.mark.parametrize("least, most", [(1, 1), (2, 2), (3, 4), (4, 4), (1, 5)])
def test_paths_equal_step_by_step_growth(spark, least, most):
    r = random.Random(most)
    edges = [(r.choice("abcdefgh"), r.choice("abcdefgh"), r.choice(["REFINES", "VERIFIES", "MENTIONS"])) for _ in range(22)]
    edges += edges[:2]
    df = graph.paths(spark.createDataFrame(edges, "src string, dst string, rel string"), least, most)
    assert sorted((*x["nodes"], *x["rels"]) for x in df.collect()) == plain_paths(edges, least, most)
    joins = df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    assert joins == {(1, 1): 0, (2, 2): 1, (4, 4): 3}.get((least, most), joins)  # the half of two edges is made for each side
