"""Approximate nearest neighbours by inner product over robust-pruned graphs.

Method. Vectors are dealt to shards of bounded size. In a shard vectors whose norms differ by a factor of two at most form a
band, and inner product becomes distance by one more coordinate, sqrt(M^2 - |x|^2), M being the band's largest norm; so no
vector, however long, flattens the others. A band's graph is built in growing batches: a greedy beam search over the graph so
far proposes each new vector's neighbours, relaxed pruning keeps an edge only if no kept neighbour is nearer to the candidate by
the factor ALPHA (diverse edges), reverse edges are added and over-full nodes pruned again. Queries run a beam search in every
shard, from the longest band on; a band is passed over once |q| times its largest norm can't reach the k-th best. Bands of
SCANNED vectors or fewer are scanned, and so is a band whose products with a query may leave the range of doubles. The best of
all shards are kept, with scores taken in double precision on the original vectors.

Scale. Equal vectors are one node that carries its smallest k + 1 ids (a query loses at most one of them, itself), so a vector
that a third of all rows hold is one node; ranks are limited on the map side. A shard (SHARD_BYTES of vectors at most), not the
table, bounds a task's memory, and the beam grows with the square root of the shard, so recall holds as shards grow; the
queries are a stated set against all rows.

Vectors that are null, empty, zero or hold null or non-finite components take no part, as candidate or query; only vectors of
equal length are compared; equal scores rank by vec_id, a score that isn't a number last; rows repeated with one vec_id count
once (the smallest of their vectors); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

DEGREE, BEAM, WIDE, ALPHA, BATCH = 28, 64, 4, 1.2, 256
QUERY_BEAM = 160
SHARD_ROWS, SHARD_BYTES = (4096, 131072), 64 << 20
#: Bands of at most so many vectors are scanned.
SCANNED = 512


class Graph:
    """A pruned graph over rows of equal norm: nearer means a larger inner product."""

    def __init__(self, rows: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 1):
        self.x = np.ascontiguousarray(rows, np.float32)
        self.degree, self.beam, self.alpha2 = degree, beam, alpha * alpha
        n = len(rows)
        self.top = float((self.x[:1] ** 2).sum()) if n else 0.0
        self.edges = np.full((n, 2 * degree), -1, np.int32)
        self.used = np.zeros(n, np.int32)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.entries = order[:16]
        at = min(n, 4 * degree)
        if at:
            self._link(order[:at], np.broadcast_to(order[:at], (at, at)))
        while at < n:
            batch = order[at : min(n, at + min(at, BATCH))]
            self._link(batch, self.search(self.x[batch], self.beam)[0])
            at += len(batch)

    def _pruned(self, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """For each node, up to degree of its candidates (-1: none), by relaxed pruning from the nearest on."""
        a = self.x[nodes]
        c = self.x[np.maximum(cand, 0)]
        near = np.einsum("bd,bcd->bc", a, c)
        live = (cand >= 0) & (cand != nodes[:, None])
        s = np.sort(cand, 1)
        if (s[:, 1:] == s[:, :-1]).any():  # a candidate twice: keep the first
            o = np.argsort(cand, 1, kind="stable")
            twice = np.zeros_like(live)
            np.put_along_axis(twice, o[:, 1:], np.take_along_axis(cand, o[:, 1:], 1) == np.take_along_axis(cand, o[:, :-1], 1), 1)
            live &= ~twice
        among = c @ c.transpose(0, 2, 1)
        gap = self.top - near
        b = np.arange(len(nodes))
        out = np.full((len(nodes), self.degree), -1, np.int32)
        for k in range(self.degree):
            best = np.where(live, near, -np.inf).argmax(1)
            ok = live[b, best]
            if not ok.any():
                break
            out[ok, k] = cand[b, best][ok]
            live &= self.alpha2 * (self.top - among[b, best]) > gap
            live[b, best] = False
        return out

    def _link(self, nodes: np.ndarray, cand: np.ndarray) -> None:
        kept = np.concatenate([self._pruned(nodes[i : i + BATCH], np.asarray(cand[i : i + BATCH], np.int32)) for i in range(0, len(nodes), BATCH)])
        self.edges[nodes, : self.degree] = kept
        self.used[nodes] = (kept >= 0).sum(1)
        src, dst = np.repeat(nodes, self.degree), kept.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        starts = np.flatnonzero(np.concatenate(([True], dst[1:] != dst[:-1]))) if len(dst) else []
        full, lists = [], []
        for lo, hi in zip(starts, [*starts[1:], len(dst)]):
            q, new = int(dst[lo]), src[lo:hi]
            have = self.edges[q, : self.used[q]]
            new = new[~np.isin(new, have)]
            u = len(have) + len(new)
            if u <= 2 * self.degree:
                self.edges[q, len(have) : u] = new
                self.used[q] = u
            else:
                full.append(q)
                lists.append(np.concatenate((have, new)))
        for lo in range(0, len(full), BATCH):
            part = lists[lo : lo + BATCH]
            wide = np.full((len(part), max(map(len, part))), -1, np.int32)
            for i, v in enumerate(part):
                wide[i, : len(v)] = v
            at = np.array(full[lo : lo + BATCH], np.int32)
            kept = self._pruned(at, wide)
            self.edges[at] = -1
            self.edges[at, : self.degree] = kept
            self.used[at] = (kept >= 0).sum(1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries at once: (nodes, inner products), nearest first, -1 where there is none."""
        q = np.ascontiguousarray(queries, np.float32)
        n, b = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column stands for no node
        seen[:, -1] = True
        ids = np.full((n, beam), -1, np.int32)
        score = np.full((n, beam), -np.inf, np.float32)
        done = np.ones((n, beam), bool)
        fresh = np.broadcast_to(self.entries, (n, len(self.entries)))
        while True:
            s = np.sort(fresh, 1)
            s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
            s = np.where(seen[b, s], -1, s)
            seen[b, s] = True
            value = np.where(s >= 0, np.einsum("bd,bcd->bc", q, self.x[np.maximum(s, 0)]), -np.inf)
            all_ids, all_score = np.concatenate((ids, s), 1), np.concatenate((score, value), 1)
            all_done = np.concatenate((done, s < 0), 1)
            o = np.argsort(-all_score, 1, kind="stable")[:, :beam]
            ids, score, done = (np.take_along_axis(v, o, 1) for v in (all_ids, all_score, all_done))
            if done.all():
                return ids, score
            first = np.argsort(done, 1, kind="stable")[:, :WIDE]  # the nearest that aren't expanded
            take = ~np.take_along_axis(done, first, 1)
            np.put_along_axis(done, first, True, 1)
            near = np.where(take, np.take_along_axis(ids, first, 1), -1)
            fresh = np.where((near >= 0)[:, :, None], self.edges[np.maximum(near, 0)], -1).reshape(n, -1)


def usable(df: DataFrame) -> DataFrame:
    """vec_id, e (array of double): the vectors that take part, one row a vec_id."""
    e = F.col("embedding").cast("array<double>")
    x = df.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).filter("vec_id is not null and e is not null and size(e) > 0")
    x = x.filter("forall(e, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(e, v -> v <> 0)")
    return x.groupBy("vec_id").agg(F.min("e").alias("e"))


class Shard:
    """Some vectors of one length with their ids, searched by inner product: bands of norms, each a graph or scanned."""

    def __init__(self, rows: np.ndarray, ids: list[list[int]], beam: int | None = None):
        """ids: of each row the ascending ids that hold it."""
        self.e, self.ids = rows, ids
        self.first = np.array([i[0] for i in ids])
        _, log = _scaled(rows)
        order = np.argsort(-log, kind="stable")
        self.bands: list[tuple[float, np.ndarray, Graph | None]] = []
        lo = 0
        while lo < len(order):
            top = log[order[lo]]
            hi = int(np.searchsorted(-log[order], 1 - top, "right"))
            at, graph = order[lo:hi], None
            if hi - lo > SCANNED:
                z = np.ldexp(rows[at], -int(np.ceil(top)))
                square = (z**2).sum(1)
                graph = Graph(np.concatenate((z, np.sqrt(square.max() - square)[:, None]), 1) / np.sqrt(square.max()))
                graph.wide = beam or beam_for(hi - lo)
            self.bands.append((top, at, graph))
            lo = hi

    def nearest(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query: the k best rows found, best first, and their inner products. A product that isn't a number (overflow to
        both sides) ranks last."""
        unit, log = _scaled(queries)
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            for top, at, graph in self.bands:
                limit = np.exp2(log + top) * (1 + 1e-9)  # no product in this band or the next ones is larger
                todo = np.array([len(r) < k or not s[k - 1] > m for (r, s), m in zip(best, limit)], bool)
                odd = todo & ((log + top > 1000) | (log + top < -900))  # products may leave the range of doubles
                plain = todo & ~odd
                found = [self._scan(np.flatnonzero(odd), queries, at, k, 1)]
                found.append(self._walk(np.flatnonzero(plain), unit, at, graph) if graph else self._scan(np.flatnonzero(plain), queries, at, k))
                for i, new in chain(*found):
                    rows = np.concatenate((best[i][0], new))
                    s = (self.e[rows] * queries[i]).sum(1)
                    o = np.lexsort((self.first[rows], -s))[:k]
                    best[i] = rows[o], s[o]
        return best

    def _scan(self, who: np.ndarray, queries: np.ndarray, at: np.ndarray, k: int, step: int = 64):
        for lo in range(0, len(who), step):
            q, e = queries[who[lo : lo + step]], self.e[at]
            far = np.nan_to_num(-(q @ e.T if step > 1 else (q * e).sum(1)[None]), nan=np.inf, posinf=np.inf, neginf=-np.inf)
            for i, row in zip(who[lo : lo + step], far):
                near = np.arange(len(at)) if len(at) <= k else np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
                yield i, at[near[np.lexsort((self.first[at[near]], row[near]))][: k + 1]]

    def _walk(self, who: np.ndarray, unit: np.ndarray, at: np.ndarray, graph: Graph):
        for lo in range(0, len(who), BATCH):
            part = unit[who[lo : lo + BATCH]]
            found, _ = graph.search(np.concatenate((part, np.zeros((len(part), 1))), 1), graph.wide)
            yield from zip(who[lo : lo + BATCH], (at[row[row >= 0]] for row in found))


def beam_for(rows: int) -> int:
    """The beam of a search grows with the square root of the graph."""
    return max(BEAM, int(QUERY_BEAM * (rows / SHARD_ROWS[0]) ** 0.5))


def _scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows at norm 1 and the binary logarithms of their norms, by exact powers of two: no square over- or underflows."""
    _, e = np.frexp(np.abs(rows).max(1))
    y = np.ldexp(rows, -e[:, None])
    size = np.sqrt((y**2).sum(1))
    return y / size[:, None], e + np.log2(size)


def _shard_answers(nodes: DataFrame, queries: DataFrame, shards: int, k: int, beam: int | None) -> DataFrame:
    """For each shard and query: the k best nodes found, how far they are (minus the exact score) and their ids. One task holds one
    shard's nodes, then the queries stream past them."""
    own = nodes.select(F.pmod(F.xxhash64("e"), F.lit(shards)).cast("int").alias("shard"), "dims", F.lit(-1).cast("long").alias("query"), "e", "ids")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dims", "query", "e", F.lit(None).cast("array<long>").alias("ids"))
    met = own.union(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("ids").isNull(), "dims")

    def run(batches):
        held: dict[int, list] = {}  # by dimension: vectors and ids until the first query comes, then the shard
        for batch in batches:
            dims, query, old = np.array(batch.column(1)), np.array(batch.column(2)), batch.column(4).is_null().to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                for new in (True, False):
                    at = np.flatnonzero((dims == d) & (old != new))
                    if not len(at):
                        continue
                    e = np.array(batch.column(3).take(pa.array(at)).flatten(), np.float64).reshape(-1, d)
                    if new:
                        mine = held.setdefault(d, [[], []])
                        mine[0].append(e)
                        mine[1] += batch.column(4).take(pa.array(at)).to_pylist()
                    elif d in held:
                        if isinstance(held[d], list):
                            vectors, ids = held.pop(d)
                            held[d] = Shard(np.concatenate(vectors), ids, beam)
                            del vectors, ids
                        for lo in range(0, len(e), BATCH):
                            yield answer(held[d], query[at][lo : lo + BATCH], e[lo : lo + BATCH])

    def answer(shard: Shard, names: np.ndarray, q: np.ndarray):
        out = ([], [], [])
        for name, (rows, s) in zip(names.tolist(), shard.nearest(q, k)):
            for c, v in zip(out, ([name] * len(rows), (-s).tolist(), [shard.ids[r] for r in rows])):
                c += v
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.int64()))], ["query", "far", "ids"])

    return met.mapInArrow(tidy(run), "query long, far double, ids array<long>")


def nearest(df: DataFrame, every: int = 20, k: int = 20, beam: int | None = None, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by every. Shards hold a 48th of the
    vectors, within the bounds SHARD_ROWS, if no size is given, and SHARD_BYTES at most."""
    vectors = usable(df)
    few = Window.partitionBy("e").orderBy("vec_id")
    heads = vectors.withColumn("r", F.row_number().over(few)).filter(F.col("r") <= k + 1)
    nodes = written(heads.groupBy("e").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dims", F.size("e")), "nodes")
    asked = vectors.filter(F.col("vec_id") % every == 0)
    names = written(asked.groupBy("e").agg(F.min("vec_id").alias("query")).withColumn("dims", F.size("e")), "queries")
    n, values = nodes.agg(F.count("*"), F.coalesce(F.sum("dims"), F.lit(0))).first()
    count = max(1, -(-n // (shard_rows or min(max(n // 48, SHARD_ROWS[0]), SHARD_ROWS[1]))), -(-8 * values // SHARD_BYTES))
    answers = _shard_answers(nodes, names, count, k + 1, beam)
    best = Window.partitionBy("query").orderBy("far", F.col("ids")[0])
    answers = answers.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    each = answers.groupBy("query").agg(F.collect_list(F.struct("far", "ids")).alias("found"))
    pairs = F.array_sort(F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct(x["far"].alias("far"), i.alias("id"))))))
    each = each.select("query", F.slice(pairs, 1, k + 1).alias("found"))
    who = asked.join(names.select("e", "query"), "e").select("vec_id", "query")
    rows = who.join(each, "query").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda x: x["id"] != F.col("vec_id")), 1, k).alias("found"))
    out = rows.select("query_id", F.posexplode("found").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))
