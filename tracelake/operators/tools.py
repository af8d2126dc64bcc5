"""The agent's tools as table functions, for SQL: SELECT * FROM graph_lookup(TABLE(links)), FROM search_documents(TABLE(hits)), and
FROM asked, LATERAL named_ids(query).

graph_lookup and search_documents take a table and say themselves how it is to be dealt and sorted (analyze), so a caller passes the
bare table; rows of a call come to one task in order, and one text goes out. A call's rows are a node's links or a search's hits. Their
sentences are fixed values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions.text import ID_ANY
from . import graph

_ID = re.compile(ID_ANY, re.ASCII)


def _analyzed(table: AnalyzeArgument, name: str, keys: list[str], order: list[str], needed: list[str]) -> AnalyzeResult:
    """The keys' types and a summary; an error that names the columns that the table lacks."""
    if not table.isTable:
        raise ValueError(f"{name} takes a table: {name}(TABLE(...))")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    if missing := [c for c in [*keys, *order, *needed] if c not in kinds]:
        raise ValueError(f"{name} needs the columns {', '.join(missing)}")
    fields = [*(StructField(k, kinds[k]) for k in keys), StructField("summary", StringType())]
    return AnalyzeResult(schema=StructType(fields), partitionBy=[PartitioningColumn(k) for k in keys], orderBy=[OrderingColumn(c) for c in order])


class GraphLookup:
    """query_id, seed, summary of rows (query_id, seed, id, heading, d, dir, rel): a seed's links, out before in; one row of null id
    for a seed without any."""

    def __init__(self) -> None:
        self._key, self._lines = None, []

    @staticmethod
    def analyze(links: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(links, "graph_lookup", ["query_id", "seed"], ["d", "id"], ["heading", "dir", "rel"])

    def eval(self, links: Row) -> None:
        self._key = links["query_id"], links["seed"]
        if links["id"] is not None:
            arrow = "-->" if links["dir"] == "out" else "<--"
            self._lines.append(f"  {links['seed']} {arrow}[:{links['rel']}]{arrow} [{links['id']}] ({(links['heading'] or '')[:50]})")

    def terminate(self) -> Iterator[tuple]:
        if self._key:
            seed = self._key[1]
            head = f"Found {len(self._lines)} requirement(s) linked to {seed}:"
            yield (*self._key, "\n".join([head, *self._lines]) if self._lines else f"No traceability links found involving {seed}.")


class SearchDocuments:
    """query_id, summary of rows (query_id, rank, id, module, heading): a search's hits; one row of null id for a search without any."""

    def __init__(self) -> None:
        self._key, self._lines = None, []

    @staticmethod
    def analyze(hits: AnalyzeArgument) -> AnalyzeResult:
        return _analyzed(hits, "search_documents", ["query_id"], ["rank"], ["id", "module", "heading"])

    def eval(self, hits: Row) -> None:
        self._key = hits["query_id"]
        if hits["id"] is not None:
            self._lines.append(f"- [{hits['id']}] ({hits['module']} :: {(hits['heading'] or '')[:60]})")

    def terminate(self) -> Iterator[tuple]:
        if self._key is not None:
            yield self._key, "\n".join([f"Found {len(self._lines)} requirements:", *self._lines]) if self._lines else "No matching requirements found."


class NamedIds:
    """pos, id: the identifiers that a text names, each once, in order."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from enumerate(dict.fromkeys(m[1] for m in _ID.finditer(text or "")))


def register(spark: SparkSession) -> None:
    """Make the tools known to this session's SQL."""
    spark.udtf.register("graph_lookup", F.udtf(GraphLookup))
    spark.udtf.register("search_documents", F.udtf(SearchDocuments))
    spark.udtf.register("named_ids", F.udtf(NamedIds, returnType="pos int, id string"))


def links_of(asked: DataFrame, edges: DataFrame, chunk: DataFrame) -> DataFrame:
    """What graph_lookup takes for asked (query_id, id): each neighbour once, by its first edge; a row of nulls without neighbours."""
    near = graph.hop1_directed(asked, edges)
    first = near.groupBy("query_id", "seed", "id").agg(F.min(F.struct(F.expr("if(dir = 'out', 0, 1)").alias("d"), "rel", "dir")).alias("m"))
    rows = first.join(chunk.select("id", "heading"), "id").select("query_id", "seed", "id", "heading", "m.d", "m.dir", "m.rel")
    return asked.select("query_id", F.col("id").alias("seed")).distinct().join(rows, ["query_id", "seed"], "left")
