"""A persistent vector index: vectors lie in one folder a cell of a k-means partition, so a search reads the cells near its queries.

Centroids (of unit vectors, for cosine) are learned from a bounded sample of SAMPLE rows, the first by hash of id; every row is then
assigned and written, a large cell in several files. The table of cells holds each one's centroid, rows, and radius (the largest angle
to a vector of it). A search sends a query to its nearest `probes` cells, prunes all other folders, pushes a tag filter into the scan
and ranks what is left by exact distance. With exact=True a second pass also reads every cell that could hold a nearer vector: one
whose centroid is no farther than the k-th distance plus the cell's radius; its rows are those of a full search.

Vectors that are null, empty, zero or hold null or non-finite components are not stored; all others must have one length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import BLOCK_BYTES, BLOCK_ROWS, best, blocks_met, doubles, tag_of, usable
from ..scratch import forget, written
from .files import content_hash

SAMPLE, ROUNDS, MOST_CELLS, PROBES = 20_000, 10, 4096, 8
#: Tags of a batch of queries up to this many are pushed into the scan.
MOST_TAGS = 1000
_SLACK = 1e-6  # distances are rounded to 6 places
#: Numbers that a step of a task makes at once: cosines of some rows and all cells, vectors of the rows it gives out.
STEP = 1 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, initial=1e-300)[:, None]
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


def _slices(batch: pa.RecordBatch, cells: int):
    """batch in pieces of as many rows as make up to STEP cosines with all cells."""
    each = max(1, STEP // max(1, cells))
    for lo in range(0, batch.num_rows, each):
        yield batch.slice(lo, each)


def kmeans(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Centroids at unit length of unit vectors x, by cosine; a cell that loses all its vectors takes the one worst placed."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        at, fit = near.argmax(1), near.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(fit)[: len(empty)]]
        c = _unit(sums)
    return c


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # MOST_CELLS at most
        self.centroids = np.array([r["centroid"] for r in rows])
        self.rows, self.radius = np.array([r["n"] for r in rows], np.int64), np.array([r["radius"] for r in rows])
        self.length = self.centroids.shape[1] if len(rows) else 0

    @classmethod
    def build(cls, corpus: DataFrame, path: str, cells: int | None = None, force: bool = False) -> tuple[VectorIndex, bool]:
        """The index of corpus (id, vector; tag if there is one) at path, and whether it was written: not if one of the same content
        is there, unless force is given. cells: the root of the number of rows, if not given."""
        spark, path = corpus.sparkSession, path.rstrip("/")
        tag = F.coalesce(F.col("tag").cast("string"), F.lit("")) if "tag" in corpus.columns else F.lit("")
        x = corpus.filter(usable()).select(F.col("id").cast("long").alias("id"), tag.alias("tag"), doubles())
        n, said = content_hash(x)
        if not force and _stamp(spark, path) == (n, said, cells):
            return cls(spark, path), False
        low, high = x.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if low != high:
            raise ValueError(f"vectors of different lengths, {low} to {high}")
        count = max(1, min(MOST_CELLS, cells or round(n**0.5)))
        share = min(1.0, 2 * SAMPLE / max(n, 1))  # a first cut by hash; then the first of them
        h = F.xxhash64("id", F.lit(29))
        near = x.filter(h.cast("double") / 2.0**64 + 0.5 <= share) if share < 1 else x
        sample = near.orderBy(h, "id").limit(SAMPLE).select("vector").toArrow()["vector"]
        centroids = kmeans(_unit(np.array(sample.combine_chunks().flatten(), np.float64).reshape(len(sample), -1)), count) if n else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast(centroids)

        def assign(batches):
            for batch in batches:
                for part in _slices(batch, len(shared.value)):
                    v = _unit(np.array(part.column(2).flatten(), np.float64).reshape(part.num_rows, -1))
                    cosine = v @ shared.value.T
                    at = cosine.argmax(1)
                    angle = np.arccos(np.clip(cosine[np.arange(len(at)), at], -1, 1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at.astype(np.int32)), pa.array(angle)], ["id", "tag", "vector", "cell", "angle"])

        placed = written(x.mapInArrow(assign, "id long, tag string, vector array<double>, cell int, angle double"), "placed")
        found = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()}  # MOST_CELLS at most
        table = [(i, c.tolist(), int(found[i]["n"]) if i in found else 0, float(found[i]["r"]) if i in found else 0.0) for i, c in enumerate(centroids)]
        files = F.split(F.lit(",".join(str(-(-t[2] // BLOCK_ROWS) or 1) for t in table) or "1"), ",").cast("array<int>")
        salt = F.pmod(F.xxhash64("id"), F.get(files, F.col("cell")))
        dealt = placed.drop("angle").repartition(max(1, min(1 << 14, n // BLOCK_ROWS + len(table))), "cell", salt)
        dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        spark.createDataFrame(table, "cell int, centroid array<double>, n long, radius double").write.mode("overwrite").parquet(f"{path}/cells")
        spark.createDataFrame([(n, said, cells)], "n long, said string, cells int").coalesce(1).write.mode("overwrite").parquet(f"{path}/stamp")
        forget(placed)
        return cls(spark, path), True

    def probes(self, queries: DataFrame, probes: int = PROBES, within: bool = False) -> DataFrame:
        """query_id, vector, tag, cell: the cells a query (query_id, vector, tag) is sent to, its nearest by centroid. within: the cells
        beyond those that could hold a vector as near as the query's column `angle` (null: all)."""
        shared, fields = self.spark.sparkContext.broadcast((self.centroids, self.radius)), "query_id long, vector array<double>, tag string, cell int"

        def run(batches):
            centroids, radius = shared.value
            for batch in batches:
                for part in _slices(batch, len(centroids)):
                    v = _unit(np.array(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1))
                    angle = np.arccos(np.clip(v @ centroids.T, -1, 1))
                    order = np.argsort(angle, axis=1, kind="stable")[:, :probes]
                    if within:
                        reach = np.array(part.column(3).fill_null(4.0))
                        open_ = angle - radius <= reach[:, None]
                        np.put_along_axis(open_, order, False, axis=1)
                        row, cell = np.nonzero(open_)
                    else:
                        row = np.repeat(np.arange(len(v)), order.shape[1])
                        cell = order.ravel()
                    # a query goes to many cells, each time with its vector
                    each = max(1, STEP // v.shape[1])
                    for lo in range(0, len(row), each):
                        yield pa.RecordBatch.from_arrays([part.column(i).take(pa.array(row[lo : lo + each])) for i in range(3)] + [pa.array(cell[lo : lo + each].astype(np.int32))], ["query_id", "vector", "tag", "cell"])

        columns = ["query_id", "vector", "tag", *(["angle"] if within else [])]
        return queries.select(*columns).mapInArrow(run, fields)

    def _met(self, probed: DataFrame, k: int, match: bool) -> DataFrame:
        probed = written(probed, "probed")
        cells = sorted(r[0] for r in probed.select("cell").distinct().collect())  # MOST_CELLS at most
        if not cells:
            return self.spark.createDataFrame([], "query_id long, id long, distance double")
        c = self.spark.read.parquet(f"{self.path}/vectors").filter(F.col("cell").isin(cells))  # folders are pruned
        if match:
            tags = [r[0] for r in probed.select("tag").distinct().limit(MOST_TAGS + 1).collect()]
            c = c.filter(F.col("tag").isin(tags)) if len(tags) <= MOST_TAGS else c
        # blocks of bounded rows and bytes: a large cell is several
        per = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * self.length)))
        sub = [-(-int(self.rows[i]) // per) or 1 for i in cells]
        first, many = dict(zip(cells, np.cumsum([0, *sub]).tolist())), dict(zip(cells, sub))
        listed = lambda of: F.split(F.lit(",".join(str(of.get(i, 0)) for i in range(len(self.rows)))), ",").cast("array<int>")
        start, size = F.get(listed(first), F.col("cell")), F.get(listed(many), F.col("cell"))
        c = c.select(F.col("id").alias("name"), "vector", "tag", (start + F.pmod(F.xxhash64("id"), size)).cast("int").alias("block"))
        q = probed.select(F.col("query_id").alias("name"), "vector", "tag", F.explode(F.sequence(start, start + size - 1)).alias("block"))
        return blocks_met(q, c, sum(sub), k, match)

    def search(self, queries: DataFrame, k: int = 10, probes: int = PROBES, match: bool = False, exact: bool = False) -> DataFrame:
        """query_id, id, distance (1 - cosine, 6 places), rank, as vectors.top_k. queries: query_id, vector, with match also tag: only
        rows of the query's tag are searched."""
        fits = usable() & (F.size("vector") == self.length)
        q = written(queries.filter(fits).select(F.col("query_id").cast("long").alias("query_id"), doubles(), tag_of(match)), "queries")
        found = best(self._met(self.probes(q, probes), k, match), k)
        if not exact:
            return found
        found = written(found, "found")
        last = found.filter(F.col("rank") == k).select("query_id", F.acos(F.greatest(F.lit(-1.0), 1 - F.col("distance") - _SLACK)).alias("angle"))
        more = self._met(self.probes(q.join(last, "query_id", "left").withColumn("angle", F.col("angle") + 1e-9), probes, within=True), k, match)
        return best(found.drop("rank").union(more), k)

    def scanned(self, queries: DataFrame, probes: int = PROBES) -> float:
        """The share of the stored vectors that a query is compared with, on average."""
        q = queries.filter(usable()).select(F.col("query_id").cast("long").alias("query_id"), doubles(), F.lit("").alias("tag"))
        counts = self.probes(q, probes).groupBy("cell").count().collect()
        asked = q.count()
        return sum(r["count"] * int(self.rows[r["cell"]]) for r in counts) / max(1, asked * int(self.rows.sum()))


def _stamp(spark: SparkSession, path: str) -> tuple | None:
    try:
        r = spark.read.parquet(f"{path}/stamp").first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return r["n"], r["said"], r["cells"]
