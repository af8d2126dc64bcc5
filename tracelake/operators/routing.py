"""Rule routing, oracle routing, and comparison of routers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import router_features
from ..schemas import BASE_PIPELINES, PIPELINES


def route_v1(queries: DataFrame, query: str = "query") -> DataFrame:
    """queries with the features, the rule that fires first, and its pipeline."""
    f = router_features(F.col(query))
    x = queries.select("*", *(c.alias(n) for n, c in f.items()))
    ids, mods = F.size("explicit_ids"), F.size("modules")
    rules = [
        ("R1", (ids >= 1) & F.col("has_trace"), "agentic-graph"),
        ("R2", ids >= 1, "vanilla"),
        ("R3", (mods >= 2) & F.col("has_chain"), "graphrag"),
        ("R4", F.col("has_trace"), "graphrag"),
        ("R5", F.col("has_numeric") & (mods == 1), "vanilla"),
    ]
    rule, pipe = F, F
    for name, when, to in rules:
        rule, pipe = rule.when(when, name), pipe.when(when, to)
    why = {"R1": "identifier and traceability words", "R2": "identifier alone", "R3": "several modules and chain words", "R4": "traceability words", "R5": "a number asked of one module", "default": "no specific signal"}
    x = x.withColumn("n_ids", ids).withColumn("n_modules", mods).withColumn("rule", rule.otherwise("default")).withColumn("pipeline", pipe.otherwise("agentic"))
    reason = F
    for k, v in why.items():
        reason = reason.when(F.col("rule") == k, v)
    return x.withColumn("reason", reason)


def wide_scores(scored: DataFrame, keys: list[str], names=PIPELINES, score: str = "score") -> DataFrame:
    """One row a question, one column a pipeline: its mean score over repeats."""
    return scored.groupBy(*keys).pivot("pipeline", list(names)).agg(F.avg(score))


def oracle_route(wide: DataFrame, names=BASE_PIPELINES) -> DataFrame:
    """wide with the best pipeline of each question (ties: the first in the list) and its score; rows with a gap are dropped."""
    x = wide.dropna(subset=list(names))
    best = F.greatest(*(F.col(f"`{n}`") for n in names))
    pick = F
    for n in names:
        pick = pick.when(F.col(f"`{n}`") == F.col("oracle_score"), n)
    return x.withColumn("oracle_score", best).withColumn("oracle_pipeline", pick)


def gap_closure(base: Column, mine: Column, oracle: Column) -> Column:
    """(mine - base) / (oracle - base); where there is no gap, infinity if mine is better, else 0."""
    gap = oracle - base
    return F.when(gap > 0, (mine - base) / gap).when(mine > base, F.lit(float("inf"))).otherwise(0.0)


def adaptive_compare(routes: DataFrame, scores: DataFrame, oracle: DataFrame, keys: list[str]) -> DataFrame:
    """Per key (and overall, key null): n, mean score by the route taken, by the oracle, and the share of the gap to a fixed
    pipeline that is closed. routes: query_id, keys, pipeline; scores: query_id, pipeline, score; oracle: query_id, oracle_score,
    base_score."""
    taken = routes.join(scores, ["query_id", "pipeline"]).select("query_id", *keys, "score").dropDuplicates(["query_id"])
    x = taken.join(oracle.select("query_id", "oracle_score", "base_score"), "query_id")
    r = x.rollup(*keys).agg(F.count("*").alias("n"), F.avg("score").alias("routed"), F.avg("base_score").alias("base"), F.avg("oracle_score").alias("oracle"))
    return r.withColumn("gap_closed", gap_closure(F.col("base"), F.col("routed"), F.col("oracle")))


def adaptive_run(routed: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """query_id, pipeline ('adaptive'), routed_to, rule, reason, ids: each routed question (query_id, pipeline, rule, reason) with the
    context (query_id, id, pos) that the pipeline it was sent to found, in order; none for a pipeline without results."""
    found = None
    for name, rows in results.items():
        part = rows.select("query_id", F.lit(name).alias("pipeline"), "pos", "id")
        found = part if found is None else found.union(part)
    mine = found.join(routed.select("query_id", "pipeline"), ["query_id", "pipeline"], "left_semi")  # only what was asked for is gathered
    each = mine.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("c"))
    x = routed.join(each, "query_id", "left")
    return x.select("query_id", F.lit("adaptive").alias("pipeline"), F.col("pipeline").alias("routed_to"), "rule", "reason", F.coalesce(F.col("c.id"), F.array().cast("array<long>")).alias("ids"))
