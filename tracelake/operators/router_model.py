"""The learned router: text features and principal components to pipelines, with calibrated scores, out-of-fold routes and repeated
cross-validation.

A model is learned from PER_CLASS questions of each class at most, the first in seeded order: they come to the driver once and go
to the tasks with the models. Fitting is numpy in the tasks (a fold a row); every question is then scored by the model of its own
fold, which hasn't seen it, in one pass over the table. Rows are dealt to folds in seeded order within their class, by counts of
hash buckets, so no task sees a class.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import features_v2
from ..scratch import written
from .runs import seeded_order

FEATURES = ("entity_count", "has_id_regex", "query_token_len_log", "kw_verifies", "kw_derives", "kw_refines", "kw_satisfies", "kw_references", "kw_which", "kw_howmany", "kw_list")
#: The pipeline that a stratum is routed to.
ROUTES = {"1-hop": "vanilla", "2-hop": "graphrag", "3+-hop": "agentic-graph"}
#: Questions of a class that are learned from, at most.
PER_CLASS = 2000


def features(queries: DataFrame, query: str = "query", vector: str = "vector") -> DataFrame:
    x = queries
    for k, v in features_v2(F.col(query)).items():
        x = x.withColumn(k, v.cast("double"))
    return x.withColumn("_x", F.array(*FEATURES)).withColumn("_e", F.col(vector).cast("array<double>"))


def places(rows: DataFrame, label: str, seed: int, key: str) -> DataFrame:
    """rows with place: the rank (from 0) of each in its label, in seeded order, then by key."""
    x = rows.withColumn("_o", seeded_order(key, seed=seed)).withColumn("_b", F.substring("_o", 1, 3))
    counts = x.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows a label at most
    base = counts.select(F.col(label).alias("_l"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy(label, "_b").orderBy("_o", key)
    x = x.withColumn("_r", F.row_number().over(w)).join(base, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    return x.withColumn("place", F.col("_base") + F.col("_r") - 1).drop("_o", "_b", "_l", "_c", "_r", "_base")


def folds(rows: DataFrame, label: str, k: int, seed: int, key: str) -> DataFrame:
    """rows with fold 0..k-1, dealt within each label in seeded order."""
    return places(rows, label, seed, key).withColumn("fold", (F.col("place") % k).cast("int")).drop("place")


# --- fitting, on bounded arrays -------------------------------------------------------------------------------------------


def _newton(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, steps: int = 50) -> np.ndarray:
    """Multinomial logistic weights (columns of x by classes of the indicator or share matrix y), by Newton's method with step
    halving; penalty: the ridge of each column."""
    d, c = x.shape[1], y.shape[1]
    w = np.zeros((d, c))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w
        z -= z.max(1, keepdims=True)
        logs = z - np.log(np.exp(z).sum(1, keepdims=True))
        return float(-(y * logs).sum() + (penalty[:, None] * w * w).sum() / 2), np.exp(logs)

    at, p = loss(w)
    for _ in range(steps):
        g = x.T @ (p - y) + penalty[:, None] * w
        h = np.zeros((c, d, c, d))
        for i in range(c):
            for j in range(c):
                h[i, :, j, :] = (x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x
            h[i, :, i, :] += np.diag(penalty)
        step = np.linalg.solve(h.reshape(c * d, c * d) + 1e-8 * np.eye(c * d), g.T.ravel()).reshape(c, d).T
        size = 1.0
        while size > 1e-6 and loss(w - size * step)[0] > at:
            size /= 2
        now, p = loss(w - size * step)
        w, at, before = w - size * step, now, at
        if before - now < 1e-9 * max(1.0, abs(before)):
            break
    return w


def _fit(text: np.ndarray, vectors: np.ndarray, label: np.ndarray, classes: int, components: int, c: float) -> tuple:
    """Principal components of the vectors, and a logistic model (ridge 1 / c, no penalty on the intercept) over them and text."""
    mean = vectors.mean(0)
    axes = np.linalg.svd(vectors - mean, full_matrices=False)[2][:components].T
    x = np.concatenate((text, (vectors - mean) @ axes, np.ones((len(text), 1))), 1)
    return mean, axes, _newton(x, np.eye(classes)[label], np.array([1 / c] * (x.shape[1] - 1) + [0.0]))


def _raw(model: tuple, text: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    mean, axes, w = model
    return np.concatenate((text, (vectors - mean) @ axes, np.ones((len(text), 1))), 1) @ w


def _sigmoid(s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A one-dimensional logistic fit of y on s, with targets drawn in by the counts, so that separable scores stay finite."""
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y, (up + 1) / (up + 2), 1 / (down + 2))
    w = _newton(np.stack((s, np.ones(len(s))), 1), np.stack((1 - t, t), 1), np.array([1e-9, 1e-9]))
    return w[:, 1] - w[:, 0]


def train(text: np.ndarray, vectors: np.ndarray, label: np.ndarray, classes: int, splits: int = 3, components: int = 3, c: float = 1.0) -> list:
    """Calibrated models, one a split: fitted on the other splits, its scores calibrated on this one. Rows are dealt to splits by
    their order within a class."""
    rank = np.zeros(len(label), int)
    for k in range(classes):
        rank[label == k] = np.arange((label == k).sum())
    out = []
    for s in range(splits):
        own = rank % splits == s
        if own.all() or not own.any():
            continue
        model = _fit(text[~own], vectors[~own], label[~own], classes, components, c)
        raw = _raw(model, text[own], vectors[own])
        out.append((model, [_sigmoid(raw[:, k], label[own] == k) for k in range(classes)]))
    return out


def scores(models: list, text: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Class probabilities: each split's calibrated scores at sum 1, averaged."""
    total = 0.0
    for model, calibrated in models:
        raw = _raw(model, text, vectors)
        p = np.stack([1 / (1 + np.exp(-np.clip(a * raw[:, k] + b, -500, 500))) for k, (a, b) in enumerate(calibrated)], 1)
        total = total + p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    return total / len(models)


# --- over tables ------------------------------------------------------------------------------------------------------


def _sample(rows: DataFrame, target: str, key: str, seed: int, per_class: int) -> tuple[list[str], list, np.ndarray, np.ndarray, np.ndarray]:
    """classes, keys, text features, vectors and labels of the rows that are learned from, in seeded order."""
    got = rows.filter((F.col("place") < per_class) & F.col(target).isNotNull() & F.col("_e").isNotNull()).select(key, target, "place", "_x", "_e").collect()  # bounded by per_class
    got.sort(key=lambda r: (r[target], r["place"]))
    classes = sorted({r[target] for r in got})
    label = np.array([classes.index(r[target]) for r in got])
    return classes, [r["place"] for r in got], np.array([r["_x"] for r in got]), np.array([r["_e"] for r in got]), label


def out_of_fold(rows: DataFrame, target: str, key: str, k: int = 10, seed: int = 42, per_class: int = PER_CLASS) -> DataFrame:
    """key, target, predicted, confidence: each row by models that haven't seen it (fold = place in its class mod k), with the mean of
    three calibrated scores. Rows without a vector have no prediction."""
    spark = rows.sparkSession
    x = written(places(rows, target, seed, key).select(key, target, "place", "_x", "_e"), "router")
    classes, place, text, vectors, label = _sample(x, target, key, seed, per_class)
    if not classes:
        return x.select(key, target, F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("confidence"))
    fold = np.array(place) % k
    data = spark.sparkContext.broadcast((text, vectors, label, fold))

    def fit(parts):
        for part in parts:
            t, v, y, f = data.value
            for i in part["id"]:
                seen = f != i
                yield pd.DataFrame({"fold": [i], "model": [pickle.dumps(train(t[seen], v[seen], y[seen], len(classes)))]})

    models = {r["fold"]: r["model"] for r in spark.range(0, k, 1, k).mapInPandas(fit, "fold long, model binary").collect()}  # k small models
    shared = spark.sparkContext.broadcast(models)
    names = x.columns[:2]

    def score(batches):
        held = {f: pickle.loads(m) for f, m in shared.value.items()}
        for batch in batches:
            f, t, v = (batch.column(i).to_pylist() for i in (2, 3, 4))
            said: list = [None] * len(f)
            sure: list = [None] * len(f)
            for one in {a % k for a, e in zip(f, v) if e is not None}:
                at = [i for i, (a, e) in enumerate(zip(f, v)) if e is not None and a % k == one]
                if held[one]:
                    p = scores(held[one], np.array([t[i] for i in at]), np.array([v[i] for i in at]))
                    for i, row in zip(at, p):
                        said[i], sure[i] = classes[int(row.argmax())], float(row.max())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(sure, pa.float64())], [*names, "predicted", "confidence"])

    kinds = dict(x.dtypes)
    return x.mapInArrow(score, f"`{key}` {kinds[key]}, `{target}` {kinds[target]}, predicted string, confidence double")


def cross_validation(rows: DataFrame, target: str, key: str, k: int = 10, repeats: int = 5, seed: int = 42, per_class: int = PER_CLASS) -> DataFrame:
    """repeat, fold, n, macro_f1: repeated stratified cross-validation over the rows that are learned from, a fold a task. The mean
    and deviation of macro_f1 are the router's score."""
    spark = rows.sparkSession
    x = places(rows, target, seed, key)
    classes, _, text, vectors, label = _sample(x, target, key, seed, per_class)
    data = spark.sparkContext.broadcast((text, vectors, label))
    n_classes = len(classes)

    def run(parts):
        for part in parts:
            t, v, y = data.value
            for i in part["id"]:
                repeat, fold = divmod(int(i), k)
                order = np.random.default_rng(seed + repeat).permutation(len(y))
                rank = np.zeros(len(y), int)
                for c in range(n_classes):
                    mine = order[y[order] == c]
                    rank[mine] = np.arange(len(mine))
                own = rank % k == fold
                models = train(t[~own], v[~own], y[~own], n_classes)
                said = scores(models, t[own], v[own]).argmax(1) if models and own.any() else np.zeros(own.sum(), int)
                f1 = []
                for c in range(n_classes):
                    hit = int(((said == c) & (y[own] == c)).sum())
                    f1.append(2 * hit / max(1, int((said == c).sum() + (y[own] == c).sum())))
                yield pd.DataFrame({"repeat": [repeat], "fold": [fold], "n": [int(own.sum())], "macro_f1": [float(np.mean(f1))]})

    many = k * repeats if n_classes else 0
    return spark.range(0, many, 1, max(1, many)).mapInPandas(run, "repeat int, fold int, n long, macro_f1 double")


def report(predicted: DataFrame, target: str) -> DataFrame:
    """Precision, recall, F1 and support of each class; their mean F1 is the macro score."""
    hit = predicted.groupBy(F.col(target).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(target) == F.col("predicted")).alias("tp"))
    said = predicted.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("said"))
    x = hit.join(said, "label", "full").na.fill(0)
    p = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return x.select("label", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
