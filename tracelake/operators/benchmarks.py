"""Benchmark corpora out of multi-hop question sets: sampled questions, their paragraphs as chunks, supporting chains as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runs import first_by_group, seeded_order

#: Question classes by stratum, and a stratum's hops.
HOP_CLASS = {"2hop": "1-hop", "3hop": "2-hop", "4hop": "3+-hop"}
REASONING = {"comparison": "1-hop", "compositional": "2-hop", "inference": "2-hop", "bridge_comparison": "3+-hop"}
HOPS = {"1-hop": 1, "2-hop": 2, "3+-hop": 3}


def mapped(col: Column, names: dict[str, object]) -> Column:
    """A lookup in a small fixed map; null where it has no entry."""
    out = F
    for k, v in names.items():
        out = out.when(col == k, F.lit(v))
    return out.otherwise(None)


def hop_class(question_id: Column) -> Column:
    """The hop class that an id begins with ('3hop1__12_34' is '3hop'); null if it is none."""
    head = F.split_part(question_id, F.lit("__"), F.lit(1))
    return F.when(F.substring(head, 1, 4).isin(*HOP_CLASS), F.substring(head, 1, 4))


def sampled_questions(questions: DataFrame, stratum: str, sizes: dict[str, int], key: str, seed: int) -> DataFrame:
    """sizes[s] questions of each stratum s in seeded order, numbered over all of them (q_idx)."""
    x = questions.filter(F.col(stratum).isin(*sizes)).withColumn("_o", F.concat(seeded_order(key, seed=seed), F.col(key).cast("string")))
    x = first_by_group(x, [stratum], ["_o"], mapped(F.col(stratum), sizes))
    return x.withColumn("q_idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_o")).cast("long") - 1).drop("_o")  # the sample is as large as its sizes say


def paragraphs(questions: DataFrame, prefix: str, key: str) -> DataFrame:
    """One chunk a paragraph of each question (q_idx, paragraphs: array of title, text, is_supporting), titled and numbered."""
    p = questions.select("q_idx", F.col(key).alias("question_id"), F.posexplode("paragraphs").alias("p_idx", "p"))
    name = F.format_string(f"{prefix}-%03d-P%02d", F.col("q_idx"), F.col("p_idx"))
    return p.select(name.alias("id"), F.concat("p.title", F.lit(": "), "p.text").alias("text"), "p.title", "p.is_supporting", "question_id", "q_idx", "p_idx")


def support_edges(chunk: DataFrame) -> DataFrame:
    """source, target, rel_type: consecutive supporting paragraphs of a question (a question has a few paragraphs)."""
    each = chunk.filter("is_supporting").groupBy("q_idx").agg(F.array_sort(F.collect_list(F.struct("p_idx", "id"))).alias("s"))
    pairs = F.arrays_zip(F.slice(F.col("s.id"), F.lit(1), F.size("s") - 1).alias("a"), F.slice(F.col("s.id"), F.lit(2), F.size("s")).alias("b"))
    return each.filter(F.size("s") > 1).select(F.explode(pairs).alias("e")).select(F.col("e.a").alias("source"), F.col("e.b").alias("target"), F.lit("REFERENCES").alias("rel_type"))


def manifest(questions: DataFrame, chunk: DataFrame, stratum: str, module: str) -> DataFrame:
    """Evaluation records: each question's supporting ids in order are its gold."""
    gold = chunk.filter("is_supporting").groupBy("q_idx").agg(F.array_sort(F.collect_list(F.struct("p_idx", "id"))).alias("g")).select("q_idx", F.col("g.id").alias("expected_ids"))
    x = questions.join(gold, "q_idx", "left").withColumn("expected_ids", F.coalesce("expected_ids", F.array().cast("array<string>")))
    end = lambda i: F.coalesce(F.get(F.col("expected_ids"), i), F.lit(""))
    return x.select(
        "q_idx", "query", F.col(stratum).alias("type"), mapped(F.col(stratum), HOPS).cast("int").alias("hop_count"), F.array(F.lit("REFERENCES")).alias("rel_path"), "expected_ids",
        end(F.lit(0)).alias("source_id"), end(F.size("expected_ids") - 1).alias("target_id"), F.lit(module).alias("source_module"), F.lit(module).alias("target_module"), F.lit(False).alias("is_cross_module"),
    )


def chain_text(nodes: Column, rels: Column) -> Column:
    """A path as numbered lines for a prompt."""
    steps = F.transform(F.sequence(F.lit(1), F.size(rels)), lambda i: F.concat(F.lit("   --["), F.element_at(rels, i), F.lit("]--> Hop "), i.cast("string"), F.lit("  ["), F.element_at(nodes, i + 1).cast("string"), F.lit("]")))
    return F.concat_ws("\n", F.concat(F.lit("  Hop 0  ["), F.element_at(nodes, 1).cast("string"), F.lit("]")), F.array_join(steps, "\n"))


#: How a question about a path is put to a writer, by the number of its hops.
PHRASES = {
    1: "Write one question that the link from %s to %s answers.\n%s",
    2: "Write one question that takes both links between %s and %s to answer.\n%s",
    3: "Write one question that only the whole chain from %s to %s answers; name neither end's text.\n%s",
}


def question_prompt(nodes: Column, rels: Column) -> Column:
    """The request for a question about a path (longer ones as three hops): its ends, and the chain as text."""
    ends = F.element_at(nodes, 1).cast("string"), F.element_at(nodes, -1).cast("string")
    out = F
    for hops, phrase in PHRASES.items():
        out = out.when(F.least(F.size(rels), F.lit(max(PHRASES))) == hops, F.format_string(phrase, *ends, chain_text(nodes, rels)))
    return out.otherwise(None)
