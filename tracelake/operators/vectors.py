"""Exact filtered top-k by cosine, as block products.

Queries are a stated set and the corpus is dealt to blocks of bounded rows and bytes. A task holds one block of the corpus; the
queries stream past it in batches, each meets the block in a matrix product, and k rows a query and block go on to a window.
Nothing is broadcast or grouped in memory but the block.

Vectors that are null, empty, zero or hold null or non-finite components take no part, as query or corpus row; only vectors of
equal length are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, BLOCK_BYTES = 32768, 64 << 20
#: Cosines of a block and some queries that a task holds at once: 16 MB.
MOST_COSINES = 1 << 21


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine of two arrays in double precision; null if a norm is 0 and no epsilon is given."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + epsilon
    return F.when(norms > 0, dot(a, b) / norms)


def usable(vector: str = "vector") -> Column:
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1)[:, None]  # so that no square over- or underflows
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, match: bool = False, skip_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, id, distance (1 - cosine, 6 places), rank. queries: query_id, vector; corpus: id, vector; with match, both have
    `tag` and only rows of the query's tag are searched (null and '' being one tag). Ties go to the smaller id."""
    c = corpus.filter(usable()).select(F.col("id").cast("long").alias("name"), doubles(), tag_of(match))
    n, values = c.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n // block_rows), -(-8 * values // BLOCK_BYTES))
    c = c.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"))
    q = queries.filter(usable()).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("query_id").cast("long").alias("name"), doubles(), tag_of(match))
    return best(blocks_met(q, c, blocks, k, match, skip_self), k)


def doubles(vector: str = "vector") -> Column:
    return F.col(vector).cast("array<double>").alias("vector")


def tag_of(match: bool) -> Column:
    return (F.coalesce(F.col("tag").cast("string"), F.lit("")) if match else F.lit("")).alias("tag")


def best(found: DataFrame, k: int) -> DataFrame:
    """found (query_id, id, distance) with rank, the k nearest of each query; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks_met(q: DataFrame, c: DataFrame, blocks: int, k: int, match: bool = False, skip_self: bool = False) -> DataFrame:
    """query_id, id, distance: the k nearest rows of c in each block that a query is sent to. Both: block (below blocks), name,
    vector (doubles, usable), tag. A task holds one block; the queries stream past it."""
    x = c.select("block", F.lit(0).alias("asks"), "name", "vector", "tag", F.size("vector").alias("dims"))
    y = q.select("block", F.lit(1).alias("asks"), "name", "vector", "tag", F.size("vector").alias("dims"))
    met = x.union(y).repartitionById(blocks, F.col("block")).sortWithinPartitions("asks", "dims")

    def run(batches):
        held: dict[int, list] = {}  # by length: unit vectors, ids, tags; lists while the block comes in, then arrays
        for batch in batches:
            asks, name, dims = (np.array(batch.column(i)) for i in (1, 2, 5))
            for d in np.unique(dims).tolist():
                for asked in (0, 1):
                    at = np.flatnonzero((dims == d) & (asks == asked))
                    if not len(at) or asked and d not in held:
                        continue
                    rows = batch.take(pa.array(at))
                    x = _unit(np.array(rows.column(3).flatten(), np.float64).reshape(-1, d))
                    if not asked:
                        for part, new in zip(held.setdefault(d, [[], [], []]), (x, name[at], np.array(rows.column(4).to_pylist(), object))):
                            part.append(new)
                        continue
                    if isinstance(held[d][0], list):
                        held[d] = [np.concatenate(p) for p in held[d]]
                    tags = rows.column(4).to_pylist()
                    each = max(1, min(256, MOST_COSINES // len(held[d][0])))
                    for lo in range(0, len(x), each):
                        yield nearest(held[d], x[lo : lo + each], name[at][lo : lo + each].tolist(), tags[lo : lo + each])

    def nearest(block, x, names, tags):
        vectors, ids, have = block
        out: list[list] = [[], [], []]
        for row, name, tag in zip(np.round(1 - x @ vectors.T, 6) + 0.0, names, tags):
            if match:
                row = np.where(have == tag, row, np.inf)
            if skip_self:
                row = np.where(ids == name, np.inf, row)
            cut = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
            at = np.flatnonzero((row <= cut) & np.isfinite(row))
            at = at[np.lexsort((ids[at], row[at]))][:k]
            for c_, new in zip(out, ([name] * len(at), ids[at].tolist(), row[at].tolist())):
                c_ += new
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "id", "distance"])

    return met.mapInArrow(run, "query_id long, id long, distance double")


def rerank(pairs: DataFrame, score: Column, n: int = 5) -> DataFrame:
    """The n best pairs (query_id, id, ...) of each query by score, with rank; ties go to the smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("score", score).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


#: What a paced reranker takes: candidates, characters of each text; and what it gives back.
RERANK_INPUT, RERANK_CHARS, RERANK_OUTPUT = 10, 200, 5


def rerank_limited(pairs: DataFrame, score, text: str = "full_text", n: int = RERANK_OUTPUT, most: int = RERANK_INPUT, chars: int = RERANK_CHARS) -> DataFrame:
    """The n best of each query's first `most` pairs (query_id, id, rank, text) by score, a function of the first `chars` characters of
    the text; what lies beyond is not scored. rank is the new place, found the old one; ties keep their order."""
    near = pairs.filter(F.col("rank") <= most).withColumnRenamed("rank", "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "found", "id")
    scored = near.withColumn("score", score(F.substring(text, 1, chars)))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def normalised(v: Column) -> Column:
    """A vector at unit length; one of (nearly) no length is divided by 1e-12."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, a: s + a * a))
    return F.transform(v, lambda a: a / F.greatest(norm, F.lit(1e-12)))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """A text's vector out of its tokens' (an array of arrays): the mean of those whose mask is 1, at unit length; null if there are
    none."""
    kept = F.filter(F.zip_with(tokens, mask, lambda t, m: F.when(m == 1, t)), lambda t: t.isNotNull())
    add = lambda s, t: F.zip_with(s, t.cast("array<double>"), lambda p, q: p + q)
    first = F.get(kept, F.lit(0)).cast("array<double>")
    total = F.aggregate(F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0))), first, add)
    return F.when(F.size(kept) > 0, normalised(F.transform(total, lambda a: a / F.size(kept))))


def first_token(tokens: Column) -> Column:
    """A text's vector as that of its first token, at unit length; null without tokens."""
    return F.when(F.size(tokens) > 0, normalised(F.get(tokens, F.lit(0)).cast("array<double>")))


def mean_pooled(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, pooled: the mean of a group's usable vectors at unit length. A task adds up its rows of each group and hands on one sum, so
    no group is gathered. A group whose vectors differ in length is an error."""
    x = rows.filter(usable(vector)).select(*keys, F.col(vector).cast("array<double>").alias("_v"), F.to_json(F.struct(F.lit(0).alias("_"), *keys)).alias("_k"))
    kinds = {f.name: f.dataType.simpleString() for f in x.schema.fields}

    def run(batches):
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            codes = batch.column("_k").dictionary_encode()
            where, sizes, v = np.array(codes.indices), np.array(batch.column("_v").value_lengths()), np.array(batch.column("_v").flatten(), np.float64)
            ends = np.cumsum(sizes)
            for i, name in enumerate(codes.dictionary.to_pylist()):
                for d in np.unique(sizes[where == i]).tolist():
                    mine = np.flatnonzero((where == i) & (sizes == d))
                    held = sums.setdefault((name, d), [batch.slice(int(mine[0]), 1), 0, np.zeros(d)])
                    held[1] += len(mine)
                    held[2] += v[(ends[mine] - d)[:, None] + np.arange(d)].sum(0)
            if sum(d for _, d in sums) > 4_000_000:
                yield from out(sums)
                sums = {}
        yield from out(sums)

    def out(sums):
        for first, n, total in sums.values():
            yield pa.RecordBatch.from_arrays([*(first.column(k) for k in keys), pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], [*keys, "_n", "_s"])

    parts = x.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_n long, _s array<double>"]))
    one = parts.select(*keys, "_n", F.size("_s").alias("_d"), F.posexplode("_s").alias("_i", "_v"))
    means = one.groupBy(*keys, "_i").agg((F.sum("_v") / F.sum("_n")).alias("_m"), F.min("_d").alias("_d"), F.max("_d").alias("_e"))
    each = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_p"), F.min("_d").alias("_d"), F.max("_e").alias("_e"))
    v = F.when(F.col("_d") == F.col("_e"), F.col("_p._m")).otherwise(F.raise_error("vectors of a group have different lengths"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, a: s + a * a))
    return each.select(*keys, F.transform(v, lambda a: F.when(norm > 0, a / norm).otherwise(a)).alias("pooled"))
