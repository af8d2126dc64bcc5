"""Judgments of answers by several judges, in long form; flips, drifts and costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .runs import is_ok, pending

KEY = ["query", "pipeline", "repeat"]


def judged(runs: DataFrame, judges: dict[str, Callable[[Column, Column, Column], Column]], judged_on: str, done: DataFrame | None = None) -> DataFrame:
    """query, pipeline, repeat, judge, judged_on, faithful: every judge on every run that succeeded and isn't judged by it yet.
    A judge maps (question, context ids, answer) to a boolean column; null is no verdict."""
    ok = runs.filter(is_ok(F.col("latency_ms"), F.col("answer")))
    verdicts = F.array(*(F.struct(F.lit(n).alias("judge"), j(F.col("query"), F.col("source_ids"), F.col("answer")).alias("faithful")) for n, j in judges.items()))
    x = ok.select(*KEY, F.explode(verdicts).alias("v")).select(*KEY, "v.judge", F.lit(judged_on).cast("date").alias("judged_on"), "v.faithful")
    return x if done is None else pending(x, done, [*KEY, "judge", "judged_on"])


def answered(answers: DataFrame, judged_on: str, raw: str = "raw", tokens: str | None = None) -> DataFrame:
    """What judges said (KEY, judge, raw text), each text read once: faithful, reason, tokens, or the error of one that can't be read."""
    x = answers.withColumn("_r", text.judge_record(F.col(raw), F.col(tokens) if tokens else None))
    return x.select(*KEY, "judge", F.lit(judged_on).cast("date").alias("judged_on"), "_r.faithful", "_r.reason", "_r.tokens", "_r.error")


def recorded(answers: DataFrame, judged_on: str, raw: str = "raw", tokens: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What judges said (KEY, judge, raw text) as judgments (with reason and tokens), and as errors (with the error): an answer that
    can't be read is no judgment, and stays to be asked again."""
    x = answered(answers, judged_on, raw, tokens)
    return x.filter("error is null").drop("error"), x.filter("error is not null").drop("faithful", "reason", "tokens")


def wide(judgments: DataFrame, judges: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row a run, one verdict column a judge. Verdicts of different dates stay in different rows."""
    return judgments.groupBy(*(keys or KEY), "judged_on").pivot("judge", judges).agg(F.first("faithful", ignorenulls=True))


def flips(first: DataFrame, second: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """n, flips and flip rate between two judgments of the same runs, over pairs with both verdicts; each way counted too."""
    a = first.filter("faithful is not null").select(*keys, *[b for b in by if b not in keys], F.col("faithful").alias("a"))
    x = a.join(second.filter("faithful is not null").select(*keys, F.col("faithful").alias("b")), keys)
    out = x.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("a") & ~F.col("b")).alias("to_false"), F.count_if(~F.col("a") & F.col("b")).alias("to_true"))
    return out.withColumn("flip_rate", (F.col("to_false") + F.col("to_true")) / F.col("n"))


def assert_complete(rows: DataFrame, answers: DataFrame, keys: list[str]) -> None:
    """Raise if a row has no answer."""
    missing = rows.join(answers.select(*keys), keys, "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"rows without an answer, such as {missing.select(*keys).first()}")


def cost(calls: DataFrame, prices: dict[str, tuple[float, float]], judge: str = "judge") -> DataFrame:
    """calls, tokens and their price per judge: prices are dollars for a million tokens in and out; an unpriced judge has no cost."""
    x = calls.groupBy(judge).agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    price = F
    for name, (i, o) in prices.items():
        price = price.when(F.col(judge) == name, (F.col("tokens_in") * i + F.col("tokens_out") * o) / 1e6)
    return x.withColumn("dollars", price.otherwise(None))


def cell_means(verdicts: DataFrame, by: list[str], judges: list[str]) -> DataFrame:
    """by, and for each judge (a boolean column) how many verdicts it gave in the cell and the share that is true."""
    return verdicts.groupBy(*by).agg(*(e for j in judges for e in (F.count(j).alias(f"n_{j}"), F.avg(F.col(j).cast("int")).alias(f"mean_{j}"))))
