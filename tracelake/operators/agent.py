"""The agent loop as bounded rounds over a table of states: one row a question, all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ID_ANY, ids_in
from ..scratch import written
from . import retrieval

MAX_ROUNDS, TOP = 3, 10


def start(queries: DataFrame) -> DataFrame:
    """query_id, query, with the ids it names, its intent, and an empty state."""
    ids = ids_in(F.col("query"), ID_ANY)
    return queries.select(
        "query_id", "query", ids.alias("extracted_ids"), F.when(F.size(ids) > 0, "id_lookup").otherwise("semantic").alias("intent"),
        F.array().cast("array<long>").alias("chunks"), F.lit(0).alias("iter_count"), F.lit(None).cast("string").alias("verdict"),
    )


def rounds(states: DataFrame, ranked: DataFrame, enough: Column, most: int = MAX_ROUNDS, step: int = TOP) -> DataFrame:
    """Retrieve, judge, repeat: in round r a state that isn't sufficient takes ranked hits (query_id, id, rank) r * step + 1 up to
    (r + 1) * step; then enough (over the state) says sufficient or continue, and iter_count counts the continues. States whose
    verdict is sufficient go through unchanged; lineage is cut after each round."""
    at = states
    for r in range(most):
        open_ = F.coalesce("verdict", F.lit("continue")) != "sufficient"
        hits = ranked.filter((F.col("rank") > r * step) & (F.col("rank") <= (r + 1) * step)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("h"))
        x = at.join(hits.select("query_id", F.col("h.id").alias("_new")), "query_id", "left")
        new = F.when(open_, F.array_distinct(F.concat("chunks", F.coalesce("_new", F.array().cast("array<long>"))))).otherwise(F.col("chunks"))
        x = x.withColumn("_open", open_).withColumn("chunks", new).drop("_new")
        judged = F.when(F.size("chunks") == 0, "continue").when(enough, "sufficient").otherwise("continue")
        x = x.withColumn("verdict", F.when(F.col("_open"), judged).otherwise(F.col("verdict")))
        x = x.withColumn("iter_count", F.col("iter_count") + (F.col("_open") & (F.col("verdict") == "continue")).cast("int")).drop("_open")
        at = written(x, "states") if r + 1 < most else x
    return at


def after_last_call(messages: DataFrame, thread: str = "conv_id", pos: str = "turn", role: str = "role") -> DataFrame:
    """The messages of each thread after its last assistant message: what a tool round has added."""
    last = messages.filter(F.col(role) == "assistant").groupBy(thread).agg(F.max(pos).alias("_last"))
    return messages.join(last, thread).filter(F.col(pos) > F.col("_last")).drop("_last")


def looked_up(states: DataFrame, chunk: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """States whose intent is id_lookup with the named ids that exist as their chunks, in the order named; with edges also their
    one-hop neighbours, after them by id. Their verdict is sufficient, whether or not ids were found; other states stay.
    chunk: name (as written in a question), id."""
    asked = states.filter("intent = 'id_lookup'").select("query_id", F.posexplode("extracted_ids").alias("pos", "name"))
    mine = asked.join(chunk.select("name", "id"), "name").select("query_id", "id", "pos")
    rows = mine.select("query_id", "id", F.lit(0).alias("hops"), "pos")
    if edges is not None:
        near = retrieval.graph_id_lookup(mine, edges, chunk.select("id")).filter("hops = 1")
        rows = rows.union(near.select("query_id", "id", "hops", F.lit(0)))
    each = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("hops", "pos", "id"))).alias("f"))  # a question names a few ids
    x = states.join(each.select("query_id", F.array_distinct(F.col("f.id")).alias("_f")), "query_id", "left")
    told = F.col("intent") == "id_lookup"
    x = x.withColumn("chunks", F.when(told, F.coalesce("_f", "chunks")).otherwise(F.col("chunks")))
    return x.withColumn("verdict", F.when(told, "sufficient").otherwise(F.col("verdict"))).drop("_f")
