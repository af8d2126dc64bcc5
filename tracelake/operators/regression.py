"""Logistic regression and principal components from sums over all rows.

A task adds up matrices as wide as the model (the Gram matrix of its rows, weighted for a Newton step); the sums are merged, and what is
solved is as large as the model, not the table. No sample is drawn and no row reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import forget, written

ROUNDS, TOLERANCE = 40, 1e-10
#: A coefficient beyond this has no finite maximum behind it (the classes are separated).
DIVERGED = 15.0
#: A task hands its sums on when it holds so many numbers.
_HELD = 4_000_000


def _step_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The score vector, the information matrix (flat), the number of rows."""
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
    return np.concatenate((x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel(), [float(len(y))]))


def logistic(rows: DataFrame, keys: list[str], covariates: list[str], outcome: str, rounds: int = ROUNDS) -> DataFrame:
    """keys, n, terms: a logistic model of a yes/no outcome for each key, as an array of (term, coefficient, error, z); the first term is
    `intercept`. By Newton's method: a round joins rows with their key's coefficients and sums up a step in the tasks; a key may have
    any number of rows. Rows with a null among covariates or outcome are left out. The estimates are null where none are finite: a
    covariate that depends on others, or classes that are separated."""
    names, d = ["intercept", *covariates], len(covariates) + 1
    x = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in covariates))
    whole = F.lit(True)
    for c in (*covariates, outcome):
        whole = whole & F.col(c).isNotNull()
    data = rows.filter(whole).select(F.struct(F.lit(0).alias("_"), *keys).alias("k"), x.alias("x"), F.col(outcome).cast("double").alias("y"))
    data = written(data.select(F.to_json("k").alias("key"), "k", "x", "y"), "cases")
    at = written(data.groupBy("key").agg(F.first("k").alias("k")).withColumn("beta", F.array_repeat(F.lit(0.0), d)).withColumn("moved", F.lit(1.0)), "models")
    who = F.broadcast if at.count() <= 10_000 else (lambda df: df)  # that many models of d numbers

    def sums(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            key, xs, y, beta = (batch.column(i) for i in range(4))
            xs, betas = (np.array(c.flatten(), np.float64).reshape(batch.num_rows, d) for c in (xs, beta))
            codes = key.dictionary_encode()
            where = np.array(codes.indices)
            for i, name in enumerate(codes.dictionary.to_pylist()):
                mine = np.flatnonzero(where == i)
                held[name] = held.get(name, 0) + _step_sums(xs[mine], np.array(y)[mine], betas[mine[0]])
            if len(held) * (d * d + d + 1) > _HELD:
                yield out(held)
                held = {}
        yield out(held)

    def out(held):
        n = d * d + d + 1
        flat = np.concatenate(list(held.values())) if held else np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array([k for k in held for _ in range(n)], pa.string()), pa.array(np.tile(np.arange(n, dtype=np.int32), len(held))), pa.array(flat)], ["key", "i", "v"])

    def solve(batches):
        for batch in batches:
            betas, moves, errors, counts = [], [], [], []
            for beta, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                score, information = np.array(v[:d]), np.array(v[d:-1]).reshape(d, d)
                fine = np.linalg.cond(information) < 1e12 if np.isfinite(information).all() else False
                inverse = np.linalg.inv(information) if fine else np.full((d, d), np.nan)
                step = inverse @ score
                size = np.abs(step).max()
                new = np.array(beta) + (step if size <= 5 else step * 5 / size)
                lost = not fine or np.abs(new).max() > DIVERGED
                betas.append([float("nan")] * d if lost else new.tolist())
                moves.append(0.0 if lost else float(size))
                errors.append(np.sqrt(np.diag(inverse)).tolist() if not lost else [float("nan")] * d)
                counts.append(int(v[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(betas, pa.list_(pa.float64())), pa.array(moves, pa.float64()), pa.array(errors, pa.list_(pa.float64())), pa.array(counts, pa.int64())], ["key", "beta", "moved", "error", "n"])

    for _ in range(rounds):
        open_ = at.filter(F.col("moved") > TOLERANCE).select("key", "beta")
        part = data.select("key", "x", "y").join(who(open_), "key").select("key", "x", "y", "beta").mapInArrow(sums, "key string, i int, v double")
        total = part.groupBy("key", "i").agg(F.sum("v").alias("v")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))  # d * d + d + 1 a key
        new = open_.join(total, "key").select("key", "beta", F.col("s.v").alias("v")).mapInArrow(solve, "key string, beta array<double>, moved double, error array<double>, n long")
        done = at.filter(F.col("moved") <= TOLERANCE)
        last, at = at, written(at.select("key", "k").join(new, "key").unionByName(done, allowMissingColumns=True), "models")
        forget(last)
        if at.filter(F.col("moved") > TOLERANCE).isEmpty():
            break
    number = lambda c, i: F.when(~F.isnan(F.get(c, i)) & (F.col("moved") <= TOLERANCE), F.get(c, i))
    terms = [F.struct(F.lit(t).alias("term"), number("beta", i).alias("coefficient"), number("error", i).alias("error"), F.try_divide(number("beta", i), number("error", i)).alias("z")) for i, t in enumerate(names)]
    return at.select(*(F.col(f"k.{k}").alias(k) for k in keys), *(["n"] if "n" in at.columns else []), F.array(*terms).alias("terms"))


def moments(rows: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """How many usable vectors there are, their mean and covariance, from one sum a task, merged in a tree. Vectors have one length."""
    from .vectors import usable

    def run(batches):
        n, first, gram = 0, 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.unique(np.array(batch.column(0).value_lengths()))
            if len(sizes) > 1:
                raise ValueError(f"vectors of different lengths, {sizes[0]} to {sizes[-1]}")
            x = np.array(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, -1)
            n, first, gram = n + len(x), first + x.sum(0), gram + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([n], first, gram.ravel())).tobytes()], pa.binary())], ["s"])

    parts = rows.filter(usable(vector)).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "s binary").rdd.map(lambda r: np.frombuffer(r[0]))
    zero = np.zeros(1)
    total = parts.treeAggregate(zero, _added, _added)
    if len(total) == 1:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int((np.sqrt(4 * len(total) - 3) - 1) / 2)
    n, mean = int(total[0]), total[1 : d + 1] / total[0]
    return n, mean, total[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) != len(b) and min(len(a), len(b)) > 1:
        raise ValueError("vectors of different lengths")
    return b if len(a) == 1 else a if len(b) == 1 else a + b


def principal_components(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean, the k axes of largest variance (rows; the entry of largest size is positive), and their variances."""
    n, mean, covariance = moments(rows, vector)
    if not n:
        return mean, np.zeros((0, 0)), np.zeros(0)
    values, axes = np.linalg.eigh(covariance)
    axes, values = axes.T[::-1][:k], values[::-1][:k]
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return mean, axes * sign[:, None], np.maximum(values, 0)


def projected(rows: DataFrame, vector: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """rows with projection: the vector's coordinates along the axes; null where the vector isn't usable."""
    from .vectors import usable

    shared = rows.sparkSession.sparkContext.broadcast((mean, axes))
    names = rows.columns
    x = rows.withColumn("_v", F.when(usable(vector), F.col(vector).cast("array<double>")))

    def run(batches):
        mean, axes = shared.value
        for batch in batches:
            v = batch.column(len(names))
            some = np.flatnonzero(np.array(v.is_valid()))
            out: list = [None] * batch.num_rows
            if len(some):
                y = (np.array(v.drop_null().flatten(), np.float64).reshape(len(some), -1) - mean) @ axes.T
                for i, row in zip(some.tolist(), y.tolist()):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, pa.list_(pa.float64()))], [*names, "projection"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "projection array<double>"])
    return x.mapInArrow(run, schema)
