"""Set metrics of citations and contexts. Empty sets score 0, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def distinct_size(a: Column) -> Column:
    return F.size(F.array_distinct(F.coalesce(a, F.array().cast("array<string>"))))


def precision(found: Column, gold: Column) -> Column:
    return _ratio(overlap(found, gold), distinct_size(found))


def recall(found: Column, gold: Column) -> Column:
    return _ratio(overlap(found, gold), distinct_size(gold))


def f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def scores(cited: Column, gold: Column, sources: Column) -> dict[str, Column]:
    p, r = precision(cited, gold), recall(cited, gold)
    return {"citation_precision": p, "citation_recall": r, "citation_f1": f1(p, r), "retrieval_recall": recall(sources, gold), "context_precision": precision(sources, gold)}
