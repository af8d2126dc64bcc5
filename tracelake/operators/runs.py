"""Experiment matrices, their logs, scores, samples and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..schemas import RUN_KEY
from ..scratch import bucket_of, quantile_bounds, ranges_for, written

CONFIG = "pipeline string, embedder string, reranker string"


def configs(spark: SparkSession, embedders: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """The configurations to run: vanilla with no, a local and a remote reranker, and the other pipelines without one. skip names
    pipelines, or 'norerank', 'local_rerank', 'remote_rerank'."""
    rows = []
    for e in embedders:
        rows += [("vanilla", e, r) for r, name in ((None, "norerank"), ("local", "local_rerank"), ("remote", "remote_rerank")) if name not in skip]
        rows += [(p, e, None) for p in ("agentic", "graphrag", "agentic-graph", "adaptive") if p not in skip]
    return spark.createDataFrame(rows, CONFIG)


def matrix(queries: DataFrame, config: DataFrame, repeats: int) -> DataFrame:
    """Every query with every configuration and repeat: an array of configurations is exploded beside each query."""
    cells = F.array(*(F.struct(F.lit(r["pipeline"]).alias("pipeline"), F.lit(r["embedder"]).alias("embedder"), F.lit(r["reranker"]).cast("string").alias("reranker")) for r in config.collect()))  # the stated configurations
    x = queries.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("_c", F.explode(cells))
    return x.select("*", "_c.pipeline", "_c.embedder", "_c.reranker").drop("_c")


def pending(planned: DataFrame, done: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Planned runs whose key isn't in the log; error rows count as done. Null key parts are equal."""
    key = key or RUN_KEY
    d = done.select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
    on = None
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = c if on is None else on & c
    return planned.join(d, on, "left_anti")


def is_ok(latency: Column, answer: Column | None = None) -> Column:
    ok = F.coalesce(latency >= 0, F.lit(False))
    return ok if answer is None else ok & ~F.coalesce(F.startswith(answer, F.lit("ERROR:")), F.lit(False))


def summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """n, ok, and mean latency, tokens and citations of the runs that succeeded (0 if none did), per configuration."""
    ok = is_ok(F.col("latency_ms"))
    mean = lambda v: F.coalesce(F.sum(F.when(ok, v)), F.lit(0)) / F.greatest(F.count_if(ok), F.lit(1))
    return runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), mean(F.col("latency_ms")).alias("avg_ms"), mean(F.col("total_tokens")).alias("avg_tokens"), mean(F.size("cited_ids")).alias("avg_cited"))


def score(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Runs with their question's gold and all citation scores; runs of unknown questions are left out (see unmatched)."""
    gold = manifest.select("query", F.coalesce("expected_ids", F.array().cast("array<string>")).alias("gold"), "hop_count", F.col("type").alias("stratum"), "is_cross_module")
    x = runs.join(gold, "query")
    for k, v in metrics.scores(F.col("cited_ids"), F.col("gold"), F.col("source_ids")).items():
        x = x.withColumn(k, v)
    return x.withColumn("n_cited", metrics.distinct_size(F.col("cited_ids"))).withColumn("n_gold", metrics.distinct_size(F.col("gold")))


def unmatched(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    return runs.join(manifest.select("query"), "query", "left_anti")


def seeded_order(*cols: str, seed: int) -> Column:
    """A shuffle that any engine repeats: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def first_by_group(rows: DataFrame, group: list[str], order: list[Column | str], n: int | Column) -> DataFrame:
    """The first n rows of each group. Ranks are limited on the map side, so a large group costs n rows a task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def stratified_sample(rows: DataFrame, group: str, size: int, ids: list[str], seed: int) -> DataFrame:
    """max(1, size // groups) rows of each group by seeded order, then at most size rows in seeded order."""
    groups = rows.agg(F.count_distinct(F.coalesce(F.col(group).cast("string"), F.lit("")))).first()[0]
    x = rows.withColumn("_o", seeded_order(*ids, seed=seed))
    return first_by_group(x, [group], ["_o", *ids], max(1, size // max(1, groups))).orderBy("_o", *ids).limit(size).drop("_o")


def quota(rows: DataFrame, group: list[str], item: str, order: str, n: int) -> DataFrame:
    """The first n distinct items of each group, in the order in which they first occur."""
    first = rows.groupBy(*group, item).agg(F.min(order).alias(order))
    return first_by_group(first, group, [order, item], n)


def row_positions(rows: DataFrame, order: str, parts: int | None = None) -> DataFrame:
    """rows with pos: the place of each in the whole order (from 0), by counts of ranges, not one sorted task. order is unique."""
    bounds = quantile_bounds(rows, order, parts or ranges_for(rows.count()))
    x = rows.withColumn("_b", bucket_of(F.col(order), bounds))
    counts = x.groupBy("_b").agg(F.count("*").alias("_n"))
    base = counts.select(F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_b").orderBy(order)
    x = x.withColumn("_r", F.row_number().over(w)).join(base, F.col("_b") == F.col("_c"))
    return x.withColumn("pos", F.col("_base") + F.col("_r") - 1).drop("_b", "_c", "_r", "_base")


def winners(cells: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """The name with the largest value of each group; ties go to the first name."""
    return cells.groupBy(*group).agg(F.min_by(name, F.struct(-F.col(value), F.col(name))).alias("winner"), F.max(value).alias("best"))


def merge_token_maps(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """One map a key: the sums of its rows' token maps."""
    x = rows.select(key, F.explode(tokens).alias("_k", "_v")).groupBy(key, "_k").agg(F.sum("_v").alias("_v"))
    return x.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("tokens"))


def merge_one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join of two tables that hold each key once; raises if either doesn't."""
    for side, df in (("left", left), ("right", right)):
        if not df.groupBy(*key).count().filter("count > 1").isEmpty():
            raise ValueError(f"the {side} table holds a key more than once: {key}")
    return left.join(right, key)


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, least, most, mean and (population) deviation of a value per group; nulls don't count."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def variant(col: Column) -> tuple[Column, Column]:
    """The pipeline and the variant of a composite name 'pipeline|variant'; without a bar the variant is null."""
    return F.split_part(col, F.lit("|"), F.lit(1)), F.when(F.contains(col, F.lit("|")), F.split_part(col, F.lit("|"), F.lit(2)))


def paced(calls: DataFrame, service: str, at: str, gap: float, order: list[str]) -> DataFrame:
    """calls with start: when each may begin so that a service's calls, in order of at, begin gap seconds apart or more. A call
    starts at the latest of at_j + (its number - j) * gap over the calls j up to it: a running maximum, no loop. Numbers and maxima
    are taken in ranges of at and carried from range to range, so a service's log is spread (calls due at one moment share one)."""
    x = written(calls, "calls")
    x = x.withColumn("_b", bucket_of(F.col(at), quantile_bounds(x, at, ranges_for(x.count()))))
    w = Window.partitionBy(service, "_b").orderBy(at, *order)
    x = x.withColumn("_r", F.row_number().over(w))
    pieces = x.groupBy(service, "_b").agg(F.count("*").alias("_n"), F.max(F.col(at) - F.col("_r") * gap).alias("_m"))
    before = Window.partitionBy(service).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    pieces = pieces.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    pieces = pieces.withColumn("_prev", F.max(F.col("_m") - F.col("_base") * gap).over(before))
    pieces = pieces.select(F.col(service).alias("_s"), F.col("_b").alias("_c"), "_base", "_prev")
    x = x.join(pieces, F.col(service).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c"))).withColumn("_k", F.col("_base") + F.col("_r"))
    latest = F.greatest("_prev", F.max(F.col(at) - F.col("_k") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("start", latest + F.col("_k") * gap).drop("_b", "_r", "_s", "_c", "_base", "_prev", "_k")
