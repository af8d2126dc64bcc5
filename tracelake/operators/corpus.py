"""Chunks, their metadata, and typed links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import following
from ..schemas import LINK_TYPES

MIN_TEXT, HEADING = 30, 120


def body(full_text: Column, text: Column) -> Column:
    """The text of a chunk: full_text, else text, trimmed."""
    return F.trim(F.coalesce(F.when(full_text != "", full_text), text, F.lit("")))


def chunks(rows: DataFrame, min_text: int = MIN_TEXT) -> DataFrame:
    """Canonical chunks (id, module, heading, level, object_type, full_text, outgoing_links, incoming_links) of long enough rows.
    Columns that rows lacks take their defaults."""
    have = set(rows.columns)
    col = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in have else F.lit(default).cast(kind)
    none = F.array().cast("array<struct<target_id: string, link_type: string>>")
    links = lambda c: F.coalesce(F.col(c), none) if c in have else none
    text = body(F.col("full_text") if "full_text" in have else F.lit(None).cast("string"), F.col("text") if "text" in have else F.lit(None).cast("string"))
    out = rows.select(
        "id", col("module", "string", "").alias("module"), col("heading", "string", "").alias("heading"), col("level", "int", 0).alias("level"),
        col("object_type", "string", "").alias("object_type"), text.alias("full_text"), links("outgoing_links").alias("outgoing_links"), links("incoming_links").alias("incoming_links"),
    )
    return out.filter(F.length("full_text") >= min_text)


def metadata(chunk: DataFrame) -> DataFrame:
    """The scalar metadata that goes beside a vector."""
    return chunk.select("id", "module", F.substring("heading", 1, HEADING).alias("heading"), "level", "object_type", F.size("outgoing_links").alias("n_outgoing"), F.size("incoming_links").alias("n_incoming"))


def nodes(rows: DataFrame) -> DataFrame:
    """Graph nodes, one an id, with attributes as JSON text."""
    attrs = F.to_json("attributes") if "attributes" in rows.columns else F.lit("{}")
    keep = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("id", "module", "level", "heading", "object_type", "is_heading", "module_path")]
    text = body(F.col("full_text") if "full_text" in rows.columns else F.lit(None), F.col("text") if "text" in rows.columns else F.lit(None))
    return rows.select(*keep, text.alias("full_text"), F.coalesce(attrs, F.lit("{}")).alias("attrs_json")).dropDuplicates(["id"])


def links(chunk: DataFrame) -> DataFrame:
    """src, dst, rel of every outgoing link with a target and a type; types as they stand, trimmed, in upper case."""
    x = chunk.select(F.col("id").alias("src"), F.explode("outgoing_links").alias("l"))
    return x.select("src", F.trim("l.target_id").alias("dst"), F.upper(F.trim("l.link_type")).alias("rel")).filter("dst <> '' and rel <> ''")


def known_links(typed: DataFrame, types=LINK_TYPES) -> DataFrame:
    """Links of known types, each once."""
    return typed.filter(F.col("rel").isin(*types)).distinct()


def unknown_types(typed: DataFrame, types=LINK_TYPES) -> DataFrame:
    return typed.filter(~F.col("rel").isin(*types)).groupBy("rel").agg(F.count("*").alias("n"))


def resolved(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = node.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def orphan_targets(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Targets that are no node, each once."""
    return edges.select(F.col("dst").alias("id")).distinct().join(node.select("id"), "id", "left_anti")


def consecutive_edges(rows: DataFrame, group: str, order: str) -> DataFrame:
    """src, dst: each row's id (its order value) and the next one's in its group."""
    return following(rows, group, order, order).filter("next is not null").select(F.col(group), F.col(order).alias("src"), F.col("next").alias("dst"))


def with_distractors(gold: DataFrame, extra: DataFrame) -> DataFrame:
    """Gold edges and those extra ones that join no pair that is joined already, in either direction."""
    pairs = gold.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    new = extra.join(pairs, (F.least("src", "dst") == F.col("a")) & (F.greatest("src", "dst") == F.col("b")), "left_anti")
    return gold.select("src", "dst", F.lit(False).alias("is_distractor")).union(new.select("src", "dst", F.lit(True)))
