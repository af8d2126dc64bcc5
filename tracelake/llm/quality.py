"""A quality classifier over pooled random-indexing vectors.

Method. A token is a run of letters, of digits or of other signs, case kept; its hash names one of WORDS entries. An entry's index
vector has a few entries of plus or minus one. Random indexing sums up, over all documents, the index vectors of the tokens around
each token (WINDOW to either side); less the corpus mean and at unit length, that sum is the word vector. A document is pooled to the
mean of its tokens' vectors, the mean of the products of successive vectors (how alike neighbours are: repetition), and the logarithm
of their number. A two-layer network in numpy is trained on pooled labelled documents; a temperature, fitted on a fifth of them that
the network has not seen, makes its outputs probabilities.

Scale. Word vectors take one pass over every whole text: a task adds up one matrix of WORDS x DIMS counts over at least PART bytes of
input, and the matrices are merged in a tree; so what is gathered follows the input, and what the driver holds doesn't. The network
learns from a bounded sample: PER_CLASS labelled documents of each class, the first by hash, weighted back to the classes' shares.
Scoring is map only and reads every whole text. A text over PIECE bytes is read in pieces, cut at white space if there is any; the
tokens' pairs over a cut don't count.

Labels are used for training rows only, and nothing but the text is used for a score. A null text is an empty one; a text without
tokens is pooled to zeros and scored like any other. A doc_id with several rows and one label is learned from once (its smallest
text); one whose labels contradict each other, or are neither 0 nor 1, is not learned from. Repeated rows give repeated results; extra
columns are ignored, whatever their names; a null doc_id is scored, and not held out. If only one class is labelled, every score is
its label; without labels, 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _AT, _BYTE, chunks, forget, mix, parts_for, text_bytes, tidy, written

WORDS, DIMS, ENTRIES, WINDOW = 1 << 14, 32, 2, 2
PER_CLASS, HIDDEN, ROUNDS, BATCH = 4000, 32, 60, 128
PART, LEAST_PARTS, PIECE = 64 << 20, 24, 1 << 20
THRESHOLD = 0.3

_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_KIND = np.array([_SPACE if c in (9, 10, 11, 12, 13, 32) else _DIGIT if 48 <= c <= 57 else _LETTER if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else _SIGN for c in range(256)], np.uint8)


def _index() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of every index vector."""
    r = np.random.default_rng(5)
    return r.integers(0, DIMS, (WORDS, ENTRIES)), r.choice([-1.0, 1.0], (WORDS, ENTRIES))


def entries(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts as numbers below WORDS, in order, and the number of tokens of each text."""
    joined = b" ".join([b"", *texts, b""])
    a = np.frombuffer(joined, np.uint8)
    kind = _KIND[a]
    turns = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = turns[kind[turns] != _SPACE]
    counts = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0) if texts else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.int64), counts
    a, kind, starts = a[starts[0] :], kind[starts[0] :], starts - starts[0]
    at = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    body = _BYTE[a] * _AT[at & 0xFFFF]
    body[kind == _SPACE] = 0
    return (mix(np.add.reduceat(body, starts)) % np.uint64(WORDS)).astype(np.int64), counts


def pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """texts, those over PIECE bytes cut up, and the number of the text that each piece is of."""
    out, owner = [], []
    for i, t in enumerate(texts):
        lo = 0
        while len(t) - lo > PIECE:
            cut = max(t.rfind(c, lo, lo + PIECE) for c in (b" ", b"\n", b"\t")) + 1
            cut = cut if cut > lo else lo + PIECE
            out.append(t[lo:cut])
            owner.append(i)
            lo = cut
        out.append(t[lo:] if lo else t)
        owner.append(i)
    return out, np.array(owner, np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(WORDS, DIMS) unit vectors by random indexing over all texts (column text); zeros for entries that don't occur."""

    def run(batches):
        places, signs = _index()
        around, seen = np.zeros(WORDS * DIMS, np.int64), np.zeros(WORDS, np.int64)
        for batch in batches:
            texts, _ = pieces(text_bytes(batch.column(0)))
            for lo, hi in chunks(texts):
                b, counts = entries(texts[lo:hi])
                owner = np.repeat(np.arange(hi - lo), counts)
                seen += np.bincount(b, minlength=WORDS)
                for d in range(1, WINDOW + 1):
                    ok = np.flatnonzero(owner[d:] == owner[:-d])
                    i, j = b[ok], b[ok + d]
                    for e in range(ENTRIES):
                        at = np.concatenate((i * DIMS + places[j, e], j * DIMS + places[i, e]))
                        around += np.bincount(at, np.concatenate((signs[j, e], signs[i, e])), minlength=len(around)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((around, seen)).tobytes()], pa.binary())], ["sums"])

    docs = docs.select(F.col("text").cast("string").alias("text"))
    sums = docs.coalesce(parts_for(docs, PART, LEAST_PARTS)).mapInArrow(tidy(run), "sums binary").rdd
    if not sums.getNumPartitions():
        return np.zeros((WORDS, DIMS), np.float32)
    depth = max(2, math.ceil(math.log(sums.getNumPartitions(), 16)))  # some 16 matrices meet at a time, at the driver too
    total = sums.map(lambda r: np.frombuffer(r[0], np.int64)).treeReduce(np.add, depth)
    around, seen = total[: WORDS * DIMS].reshape(WORDS, DIMS).astype(np.float64), total[WORDS * DIMS :]
    x = around / np.maximum(seen, 1)[:, None] - around.sum(0) / max(seen.sum(), 1)
    x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-9)[:, None]
    x[seen == 0] = 0
    return x.astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """(texts, 2 DIMS + 1): mean vector, mean product of successive vectors, logarithm of the number of tokens."""
    parts, owner = pieces(texts)
    sums, tokens = np.zeros((len(texts), 2 * DIMS)), np.zeros(len(texts))
    for lo, hi in chunks(parts):
        b, counts = entries(parts[lo:hi])
        mine, some = owner[lo:hi], counts > 0
        np.add.at(tokens, mine, counts)
        if not len(b):
            continue
        x = vectors[b]
        at = (np.cumsum(counts) - counts)[some]
        beside = np.zeros_like(x)
        beside[:-1] = x[:-1] * x[1:]
        beside[np.cumsum(counts)[some] - 1] = 0  # a text's last token has no successor
        np.add.at(sums, mine[some], np.hstack((np.add.reduceat(x, at), np.add.reduceat(beside, at))))
    return np.hstack((sums / np.maximum(tokens, 1)[:, None], np.log1p(tokens)[:, None])).astype(np.float32)


class Network:
    """Two layers over standardised inputs; score is the probability of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 0):
        self.mean = np.average(x, 0, weight)
        self.scale = np.sqrt(np.average((x - self.mean) ** 2, 0, weight)) + 1e-6
        r, d = np.random.default_rng(seed), x.shape[1]
        self.layers = [r.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 1)), np.zeros(1)]
        self.temperature = 1.0
        unseen = np.arange(len(y)) % 5 == 4
        self._train(self._standard(x)[~unseen], y[~unseen], weight[~unseen], r)
        self._calibrate(x[unseen], y[unseen], weight[unseen])

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _train(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, r: np.random.Generator) -> None:
        one, two = ([np.zeros_like(p) for p in self.layers] for _ in range(2))
        step = 0
        for k in range(ROUNDS):
            order = r.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                i = order[lo : lo + BATCH]
                a, b, c, d = self.layers
                before = x[i] @ a + b
                held = np.maximum(before, 0)
                error = ((1 / (1 + np.exp(-(held @ c + d)[:, 0])) - y[i]) * weight[i] / len(i))[:, None]
                back = error @ c.T * (before > 0)
                step += 1
                for n, g in enumerate((x[i].T @ back + 1e-4 * a, back.sum(0), held.T @ error + 1e-4 * c, error.sum(0))):
                    one[n] = 0.9 * one[n] + 0.1 * g
                    two[n] = 0.999 * two[n] + 0.001 * g * g
                    rate = 2e-3 * (1 - k / ROUNDS)
                    self.layers[n] = self.layers[n] - rate * (one[n] / (1 - 0.9**step)) / (np.sqrt(two[n] / (1 - 0.999**step)) + 1e-8)

    def _calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature, of a grid, under which the unseen labels are likeliest."""
        if len(y):
            z = self.logits(x)
            loss = lambda t: (weight * np.logaddexp(0, np.where(y == 1, -z, z) / t)).sum()
            self.temperature = float(min(np.exp(np.linspace(np.log(0.5), np.log(8), 57)), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return (np.maximum(self._standard(x) @ a + b, 0) @ c + d)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


class Constant:
    """For labels of one class, or none."""

    def __init__(self, score: float):
        self.score = score

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.score)


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, per_class: int = PER_CLASS) -> Network | Constant:
    """Learn from docs (doc_id, text) and labels (doc_id, label 0 or 1); a bounded sample of them, see above."""
    one = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_m"))
    one = one.filter("label = _m and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id", F.lit(23)).alias("h"))
    known = one.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}  # two at most
    if len(counts) < 2:
        return Constant(float(next(iter(counts), 0.5)))
    # a first cut by hash leaves a few times what is needed, so no window sees a whole class
    share = F.when(F.col("label") == 1, min(1.0, 3 * per_class / counts[1])).otherwise(min(1.0, 3 * per_class / counts[0]))
    near = known.filter(F.col("h").cast("double") / 2.0**64 + 0.5 <= share)
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h", "doc_id"))).filter(F.col("k") <= per_class)
    first = written(first.select("doc_id", "label", "h"), "sample")
    texts = docs.join(F.broadcast(first), "doc_id").groupBy("doc_id", "label", "h").agg(F.min("text").alias("text"))  # 2 x per_class ids
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            x = pooled(text_bytes(batch.column(3)), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["label", "h", "doc_id", "x"])

    rows = sorted(texts.mapInArrow(tidy(run), "label int, h long, doc_id long, x binary").collect(), key=lambda r: (r["h"], r["doc_id"]))
    forget(first)
    y = np.array([r["label"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Constant(float(y[0]) if len(y) else 0.5)
    weight = np.where(y == 1, counts[1] / max(y.sum(), 1), counts[0] / max((1 - y).sum(), 1)) / sum(counts.values()) * len(y)
    return Network(np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64), y, weight)


def scored(docs: DataFrame, vectors: np.ndarray, model: Network | Constant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))  # both bounded

    def run(batches):
        vectors, model = shared.value
        for batch in batches:
            score = model.scores(pooled(text_bytes(batch.column(1)), vectors).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def predict_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", **how) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labels of documents that aren't held out, scored for all."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).filter(~held_out())
    vectors = word_vectors(docs)
    out = scored(docs, vectors, train(docs, labels, vectors, **how))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
