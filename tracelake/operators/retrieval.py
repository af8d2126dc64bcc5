"""Contexts: seeds and neighbours merged, hydrated and formatted, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.text import CONTEXT_GAP, context_block
from . import graph

SEEDS, WALK_CAP, CONTEXT_CAP = 8, 30, 15


def merged(seeds: DataFrame, extra: DataFrame, cap: int = CONTEXT_CAP) -> DataFrame:
    """query_id, id, hops, pos: seeds by rank, then extra by rank, each id once, at most cap a question."""
    both = seeds.select("query_id", "id", F.lit(0).alias("hops"), F.lit(0).alias("part"), "rank").union(extra.select("query_id", "id", "hops", F.lit(1), "rank"))
    once = both.groupBy("query_id", "id").agg(F.min(F.struct("part", "rank", "hops")).alias("m"))
    order = Window.partitionBy("query_id").orderBy("m.part", "m.rank", "id")
    return once.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= cap).select("query_id", "id", "m.hops", "pos")


def hydrate(context: DataFrame, chunk: DataFrame) -> DataFrame:
    """Context rows with module, heading and text; ids without a chunk are dropped."""
    return context.join(chunk.select("id", "module", "heading", "full_text"), "id")


def hydrate_or_say(context: DataFrame, chunk: DataFrame, missing: str = "(text unavailable)") -> DataFrame:
    return context.join(chunk.select("id", "full_text"), "id", "left").withColumn("full_text", F.coalesce("full_text", F.lit(missing)))


def formatted(rows: DataFrame) -> DataFrame:
    """query_id, ids, prompt: a question's context rows in order as one prompt block. A context is a few rows (its cap)."""
    line = context_block(F.col("id"), F.col("module"), F.col("heading"), F.col("full_text"))
    each = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", line.alias("line")))).alias("r"))
    return each.select("query_id", F.col("r.id").alias("ids"), F.array_join(F.col("r.line"), CONTEXT_GAP).alias("prompt"))


def judge_context(rows: DataFrame) -> DataFrame:
    """query_id, contexts: '[id] text' blocks for a judge."""
    each = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), "full_text").alias("line")))).alias("r"))
    return each.select("query_id", F.array_join(F.col("r.line"), "\n\n").alias("contexts"))


def graphrag(seeds: DataFrame, edges: DataFrame, chunk: DataFrame, walk_cap: int = WALK_CAP, cap: int = CONTEXT_CAP, ppr: bool = False) -> DataFrame:
    """Hydrated contexts of seeds (query_id, id, rank <= 8) and what a walk, or PageRank, finds near them."""
    walk = graph.walk_ppr if ppr else graph.walk_2hop
    extra = walk(seeds, edges, cap=walk_cap)
    known = extra.join(chunk.select("id"), "id", "left_semi")
    return hydrate(merged(seeds, known, cap), chunk)


def graph_id_lookup(asked: DataFrame, edges: DataFrame, chunk: DataFrame) -> DataFrame:
    """query_id, id, hops, rel, dir: the asked ids (query_id, id, pos) that exist, and their one-hop neighbours with the first
    edge seen (by the asked id's place, out before in, then id and type); asked ids are no neighbours."""
    ids = chunk.select("id")
    seeds = asked.join(ids, "id", "left_semi").select("query_id", "id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("rel"), F.lit(None).cast("string").alias("dir"))
    near = graph.hop1_directed(asked, edges).join(asked.select("query_id", F.col("id").alias("seed"), "pos"), ["query_id", "seed"])
    first = near.groupBy("query_id", "id").agg(F.min(F.struct("pos", F.expr("if(dir = 'out', 0, 1)").alias("d"), "rel", "dir")).alias("m"))
    new = first.join(asked, ["query_id", "id"], "left_anti").join(ids, "id", "left_semi")
    return seeds.unionByName(new.select("query_id", "id", F.lit(1).alias("hops"), "m.rel", "m.dir"))


def graph_lookup(asked: DataFrame, edges: DataFrame, chunk: DataFrame) -> DataFrame:
    """query_id, summary: the tool text that lists an id's neighbours with arrows. Its sentences are fixed values."""
    near = graph.hop1_directed(asked, edges)
    first = near.groupBy("query_id", "seed", "id").agg(F.min(F.struct(F.expr("if(dir = 'out', 0, 1)").alias("d"), "rel", "dir")).alias("m"))
    rows = first.join(chunk.select("id", "heading"), "id")
    arrow = F.when(F.col("m.dir") == "out", "-->").otherwise("<--")
    line = F.concat(F.lit("  "), F.col("seed").cast("string"), F.lit(" "), arrow, F.lit("[:"), "m.rel", F.lit("]"), arrow, F.lit(" ["), F.col("id").cast("string"), F.lit("] ("), F.substring("heading", 1, 50), F.lit(")"))
    each = rows.groupBy("query_id", "seed").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("m.d", "id", line.alias("line")))).alias("r"))
    head = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" requirement(s) linked to "), F.col("seed").cast("string"), F.lit(":"))
    told = each.select("query_id", "seed", F.concat_ws("\n", head, F.array_join("r.line", "\n")).alias("summary"))
    none = F.concat(F.lit("No traceability links found involving "), F.col("seed").cast("string"), F.lit("."))
    return asked.select("query_id", F.col("id").alias("seed")).distinct().join(told, ["query_id", "seed"], "left").withColumn("summary", F.coalesce("summary", none))


def limited(hits: DataFrame, asked: str = "asked", most: int = 10) -> DataFrame:
    """The hits a caller gets that asked for so many: as many, but no more than `most` and no fewer than one."""
    return hits.filter(F.col("rank") <= F.greatest(F.lit(1), F.least(F.col(asked), F.lit(most))))


def compare_contexts(first: DataFrame, second: DataFrame, gold: DataFrame, strata: DataFrame) -> DataFrame:
    """stratum (null: all), n, and mean precision and recall of two contexts of the same questions against their gold ids, and the
    mean Jaccard similarity of the two. Contexts and gold: query_id, id; strata: query_id, stratum. A question without gold or
    context scores 0."""
    ids = lambda df, name: df.groupBy("query_id").agg(F.collect_set("id").alias(name))  # noqa: E731 - a context is a few rows
    x = strata.select("query_id", "stratum")
    for df, name in ((first, "a"), (second, "b"), (gold, "g")):
        x = x.join(ids(df, name), "query_id", "left")
    none = F.array().cast(dict(x.dtypes)["a"])
    a, b, g = (F.coalesce(c, none) for c in ("a", "b", "g"))
    scores = {"precision_a": metrics.precision(a, g), "precision_b": metrics.precision(b, g), "recall_a": metrics.recall(a, g), "recall_b": metrics.recall(b, g), "jaccard": metrics.jaccard(a, b)}
    x = x.select("stratum", *(v.alias(k) for k, v in scores.items()))
    return x.rollup("stratum").agg(F.count("*").alias("n"), *(F.avg(k).alias(k) for k in scores))
