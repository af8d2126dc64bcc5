"""A training corpus from the documents table, in stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import jaccard_join, language_id, mixing, packing, pii
from tracelake.llm.common import by_place, table, without, written

#: The kernel machine's output for a text of its own language is about 1. Of 51,282 documents of the check table, all in a learned
#: language, the least has 0.29; texts in other scripts and random letters have under 0.15.
LEAST_SCORE = 0.15
#: Not SQL-expressible: the stages learn a classifier, join shingle sets and tokenize. Tests hold them against plain versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or without a letter, and those that fit no learned language: their best score is under
    LEAST_SCORE. Learned from the labelled rows of docs; without any, only letters count."""
    model = language_id.train(docs.filter(~F.coalesce(language_id.held_out(), F.lit(True))))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language_id.marked(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score").toDF(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; of rows that share it and their text, one."""
    groups = written(jaccard_join.jaccard_components(docs).filter("n_shingles > 0"), "groups")
    kept = without(docs, groups.filter("doc_id <> component_id").select("doc_id"), "doc_id")
    twice = written(groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if not twice.isEmpty():
        x = by_place(kept)
        doc, text = (f"u{docs.columns.index(c)}" for c in ("doc_id", "text"))
        again = x.join(twice, x[doc] == twice["doc_id"], "left_semi").dropDuplicates([doc, text])
        kept = x.join(twice, x[doc] == twice["doc_id"], "left_anti").union(again).toDF(*docs.columns)
    return kept


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is replaced by the name of its kind; n_chars follows the new text. No document goes."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix: until the first source runs out, every prefix holds the target weights."""
    return mixing.scheduled(docs).orderBy("position").drop(*mixing.ADDED).toDF(*docs.columns)


#: Documents of the mix that are packed together: 16 blocks of it, so each window holds the weights to within a block a source.
WINDOW = 16 * mixing.BLOCK_DOCS


def mix_window(docs: DataFrame) -> Column:
    """The window of a row by its place in docs: of a table that was written and read again, the number of its file and its place there
    (files are read in no order); else its place in the plan's partitions."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return F.floor(F.monotonically_increasing_id() / WINDOW)
    at = docs.metadataColumn("_metadata")
    file = F.coalesce(F.regexp_extract(at["file_name"], r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    return F.shiftleft(file, 32) + F.floor(at["row_index"] / WINDOW)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, one row a piece: window by window in the order of the mix, so that any run of sequences holds the target
    weights as long as the mix does, and along the curve inside a window."""
    return packing.pack_along_curve(docs, window=mix_window(docs))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_duplicates),
    ("personal_data", remove_personal_data),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
