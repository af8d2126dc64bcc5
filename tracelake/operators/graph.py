"""Walks, lookups, paths and personalized PageRank over edges (src, dst, rel), for many queries at once.

Every step is an equi-join from the frontier, never from the whole graph; edges are filtered by type first.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from ..schemas import WALK_TYPES


def whitelisted(edges: DataFrame, types=WALK_TYPES) -> DataFrame:
    return edges.filter(F.col("rel").isin(*types)) if types is not None else edges


def neighbours(edges: DataFrame, types=WALK_TYPES) -> DataFrame:
    """a, b for every edge in both directions, each pair once."""
    e = whitelisted(edges, types)
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select("dst", "src")).filter("a <> b").distinct()


def _first(near: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The k smallest neighbours of each of ids (column id). The limit runs in the tasks that read the links, before they are dealt by
    node, so a hub's links are neither gathered nor expanded."""
    x = near.join(ids.select("id").distinct(), near["a"] == F.col("id"), "left_semi")
    return x.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter(F.col("k") <= k).select("a", "b")


def walk_2hop(seeds: DataFrame, edges: DataFrame, types=WALK_TYPES, cap: int = 30) -> DataFrame:
    """query_id, id, hops, rank: nodes within two undirected steps of a query's seeds (query_id, id), seeds left out, nearest
    first, then by id, at most cap a query.

    Only what a cap can show is read. Of a seed's neighbours the cap + S smallest will do (S: the seeds of the query with most), for
    S at most are left out; a query whose first step fills the cap takes no second one; and one whose first step doesn't has less than
    cap nodes there, of whose neighbours 2 cap + S each will do."""
    near = neighbours(edges, types)
    start = seeds.select("query_id", "id").distinct()
    most = start.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    order = Window.partitionBy("query_id").orderBy("id")

    def step(at: DataFrame, k: int) -> DataFrame:
        part = _first(near, at, k)
        new = at.join(part, at["id"] == part["a"]).select("query_id", F.col("b").alias("id")).distinct()
        return new.join(start, ["query_id", "id"], "left_anti")

    one = step(start, cap + most).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
    one = written(one, "one")
    open_ = one.groupBy("query_id").agg(F.count("*").alias("had")).filter(F.col("had") < cap)
    two = step(one.join(open_, "query_id", "left_semi").select("query_id", "id"), 2 * cap + most).join(one, ["query_id", "id"], "left_anti")
    two = two.join(open_, "query_id").withColumn("rank", F.col("had") + F.row_number().over(order)).filter(F.col("rank") <= cap)
    both = one.select("query_id", "id", F.lit(1).alias("hops"), "rank").union(two.select("query_id", "id", F.lit(2), F.col("rank").cast("int")))
    return both


def hop1_directed(ids: DataFrame, edges: DataFrame, types=WALK_TYPES) -> DataFrame:
    """query_id, seed, id, dir, rel: each seed's neighbours by direction and type; one that is linked both ways comes twice."""
    e = whitelisted(edges, types)
    s = ids.select("query_id", F.col("id").alias("seed")).distinct()
    out = s.join(e, s["seed"] == e["src"]).select("query_id", "seed", F.col("dst").alias("id"), F.lit("out").alias("dir"), "rel")
    inc = s.join(e, s["seed"] == e["dst"]).select("query_id", "seed", F.col("src").alias("id"), F.lit("in").alias("dir"), "rel")
    return out.union(inc).distinct()


def edges_with_ends(edges: DataFrame, node: DataFrame, types=WALK_TYPES) -> DataFrame:
    """Edges with both ends' modules."""
    a = node.select(F.col("id").alias("src"), F.col("module").alias("src_module"))
    b = node.select(F.col("id").alias("dst"), F.col("module").alias("dst_module"))
    return whitelisted(edges, types).filter("src <> dst").join(a, "src").join(b, "dst").select("src", "dst", "rel", "src_module", "dst_module")


def paths(edges: DataFrame, least: int, most: int, types=WALK_TYPES) -> DataFrame:
    """nodes, rels, hops of directed paths of least..most edges. No edge is used twice; nodes may be; the ends differ. Edges
    that occur several times are different edges, so each gives its own path.

    A longer path is two halves that meet at a node and share no edge, so paths of four edges need those of two, and none of three."""
    order = Window.partitionBy("src", "dst", "rel").orderBy(F.lit(0))
    e = whitelisted(edges, types).select("src", "dst", "rel").withColumn("copy", F.row_number().over(order))
    one = e.select("src", "dst", F.array("src", "dst").alias("nodes"), F.array("rel").alias("rels"), F.array(F.struct("src", "dst", "rel", "copy")).alias("used"))
    made = {1: one}

    def of(hops: int) -> DataFrame:
        if hops not in made:
            x, y = of(hops - hops // 2), of(hops // 2).toDF("mid", "end", "nodes2", "rels2", "used2")
            met = x.join(y, (x["dst"] == y["mid"]) & ~F.arrays_overlap(x["used"], y["used2"]))
            tail = F.slice("nodes2", 2, hops // 2)
            made[hops] = met.select("src", F.col("end").alias("dst"), F.concat("nodes", tail).alias("nodes"), F.concat("rels", "rels2").alias("rels"), F.concat("used", "used2").alias("used"))
        return made[hops]

    parts = [of(h).filter("src <> dst").select("nodes", "rels", F.lit(h).alias("hops")) for h in range(least, most + 1)]
    return reduce(DataFrame.union, parts)


def gold_records(path: DataFrame, node: DataFrame) -> DataFrame:
    """Evaluation records of paths: ids at both ends, the gold ids along the path, and whether the ends' modules differ."""
    p = path.withColumn("source_id", F.element_at("nodes", 1)).withColumn("target_id", F.element_at("nodes", -1))
    m = node.select("id", "module")
    p = p.join(m.toDF("source_id", "source_module"), "source_id").join(m.toDF("target_id", "target_module"), "target_id")
    return p.select("source_id", "target_id", F.col("hops").alias("hop_count"), F.col("rels").alias("rel_path"), F.col("nodes").alias("expected_ids"), "source_module", "target_module", (F.col("source_module") != F.col("target_module")).alias("is_cross_module"))


#: The largest graph (moves: a node's steps to its neighbours) that tasks hold: 12 bytes a move while it comes in, and some 60 a node.
MOST_MOVES = 12_000_000


def _moves(edges: DataFrame, types) -> DataFrame:
    """a, b, w: a step from a to each neighbour with equal shares; a node without an allowed neighbour stays where it is."""
    near = neighbours(edges, types)
    degree = near.groupBy("a").agg(F.count("*").alias("d"))
    touched = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    share = near.join(degree, "a").select("a", "b", (F.lit(1.0) / F.col("d")).alias("w"))
    alone = touched.join(degree, touched["id"] == degree["a"], "left_anti").select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("w"))
    return share.union(alone)


def walk_ppr(seeds: DataFrame, edges: DataFrame, types=WALK_TYPES, cap: int = 30, alpha: float = 0.15, rounds: int = 20) -> DataFrame:
    """query_id, id, hops (1), score, rank by personalized PageRank mass from a query's seeds, seeds left out. Seeds that no edge
    of any type touches are dropped; a node without an allowed neighbour keeps its mass.

    Two ways to the same rows. A graph of up to MOST_MOVES moves, by count, goes to each of a number of groups of queries, as many as the
    cluster has cores, and each query's rounds are sums over it: no shuffle a round, so what travels is the graph times the cores, however
    many queries and rounds there are. A larger one stays a table that is exchanged once for all rounds: they are one plan, in which
    the state meets the moves by node, and masses are summed up before they travel, so a node with many links is no hot key."""
    # stated here, the filter is the same in every round: else the last round's differs, and the table is exchanged again for it
    moves = written(_moves(edges, types), "moves").filter("a is not null and b is not null")
    start = seeds.select("query_id", "id").distinct().join(moves.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    each = start.groupBy("query_id").agg(F.count("*").alias("n"))
    start = written(start.join(each, "query_id").select("query_id", "id", (F.lit(1.0) / F.col("n")).alias("mass")), "start")
    score = (_ppr_arrays if moves.count() <= MOST_MOVES else _ppr_joins)(start, moves, cap, alpha, rounds)
    rest = score.join(start, ["query_id", "id"], "left_anti").withColumn("score", F.round("mass", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap).select("query_id", "id", F.lit(1).alias("hops"), "score", "rank")


def _ppr_joins(start: DataFrame, moves: DataFrame, cap: int, alpha: float, rounds: int) -> DataFrame:
    score = start
    back = start.select("query_id", "id", (F.col("mass") * alpha).alias("mass"))
    for _ in range(rounds):
        moved = score.join(moves, score["id"] == moves["a"]).select("query_id", F.col("b").alias("id"), (F.col("mass") * F.col("w") * (1 - alpha)).alias("mass"))
        score = moved.union(back).groupBy("query_id", "id").agg(F.sum("mass").alias("mass"))
    return score


#: Nodes of a round that are added up at once; up to a SPARSE-th of the moves, a round follows them from the nodes that have mass.
STEP, SPARSE = 1 << 16, 16


class _Graph:
    """Moves (a, b), each way and once, as lists of neighbours by place among the names; the parts are used up."""

    def __init__(self, parts: list):
        self.names = np.unique(np.concatenate([np.unique(a) for a, _ in parts]))
        parts.reverse()
        a, b = [], []
        while parts:
            for held, new in zip((a, b), parts.pop()):
                held.append(np.searchsorted(self.names, new).astype(np.int32))
        a, b = np.concatenate(a), np.concatenate(b)
        self.degree = np.bincount(a, minlength=len(self.names))
        self.near = b[np.argsort(a, kind="stable")]
        self.first = np.concatenate(([0], np.cumsum(self.degree)))

    def masses(self, seeds: list, alpha: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of a query's seeds, and every node's mass."""
        place = np.searchsorted(self.names, np.array([x["id"] for x in seeds], self.names.dtype))
        given = alpha * np.array([x["mass"] for x in seeds])
        at, mass = place, given / alpha
        for done in range(rounds):
            count = self.degree[at]
            if count.sum() > len(self.near) // SPARSE:
                full = np.zeros(len(self.names))
                full[at] = mass
                for _ in range(done, rounds):
                    full = self._round(full, alpha)
                    full[place] += given
                return place, full
            to = self.near[np.repeat(self.first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            at, back = np.unique(np.concatenate((to, place)), return_inverse=True)
            mass = np.bincount(back, np.concatenate((np.repeat(mass / count * (1 - alpha), count), given)))
        full = np.zeros(len(self.names))
        full[at] = mass
        return place, full

    def _round(self, mass: np.ndarray, alpha: float) -> np.ndarray:
        share, new = mass / self.degree, np.empty(len(mass))
        for lo in range(0, len(mass), STEP):
            ends = self.first[lo : lo + STEP + 1]
            new[lo : lo + STEP] = np.add.reduceat(share[self.near[ends[0] : ends[-1]]], ends[: len(new[lo : lo + STEP])] - ends[0])
        return new * (1 - alpha)


def _ppr_arrays(start: DataFrame, moves: DataFrame, cap: int, alpha: float, rounds: int) -> DataFrame:
    """The rows of _ppr_joins that can be among the cap best: those of a mass up to a rounding step below the cap-th."""
    spark = start.sparkSession
    kind, what = (start.schema[c].dataType.simpleString() for c in ("id", "query_id"))
    asked = start.groupBy("query_id").agg(F.collect_list(F.struct("id", "mass")).alias("s"))  # a query's seeds, each a node of the graph
    groups = max(1, min(spark.sparkContext.defaultParallelism, -(-start.select("query_id").distinct().count() // 4)))

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in batch.columns], ["a", "b"])

    parts = moves.select("a", "b").mapInArrow(packed, f"a array<{kind}>, b array<{kind}>")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g")
    none = F.lit(None).cast(f"array<{kind}>")
    graph = parts.select(every, F.lit(None).cast(what).alias("query_id"), F.lit(None).cast(asked.schema["s"].dataType).alias("s"), "a", "b")
    met = graph.union(asked.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"), "query_id", "s", none, none))

    def run(batches):
        parts, queries = [], []  # the graph comes in no order, so a group's queries wait for all of it
        for batch in batches:
            is_part = batch.column("a").is_valid()
            rows = batch.filter(is_part)
            if rows.num_rows:
                parts.append(tuple(rows.column(c).flatten().to_numpy(zero_copy_only=False).copy() for c in ("a", "b")))
            queries.append(batch.filter(pa.compute.invert(is_part)).select(["query_id", "s"]))
        queries = [q for q in queries if q.num_rows]
        if not queries or not parts:
            return
        graph = _Graph(parts)
        for batch in queries:
            out = [[], [], []]
            for query, seeds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, rest = graph.masses(seeds, alpha, rounds)
                rest[place] = 0
                found = np.flatnonzero(rest)
                if len(found) > cap:
                    found = found[rest[found] >= -np.partition(-rest[found], cap - 1)[cap - 1] - 1e-8]
                out[0] += [query] * len(found)
                out[1] += graph.names[found].tolist()
                out[2] += rest[found].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], id_type), pa.array(out[2], pa.float64())], ["query_id", "id", "mass"])

    id_type = moves.select("a").limit(0).toArrow().schema.field("a").type
    return met.repartitionById(groups, F.col("g")).select("query_id", "s", "a", "b").mapInArrow(run, f"query_id {what}, id {kind}, mass double")
