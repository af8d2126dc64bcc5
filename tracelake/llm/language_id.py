"""Language identification by string kernels.

Method. A text is its set of byte n-grams (n = 1, 2, 3, letters lower-cased, other ASCII characters as spaces). The kernel of
two texts blends, over n, the number of n-grams that both hold, normalised by their set sizes. Nystroem landmarks are training
texts (n-grams that no landmark holds count for a text's size only); one-versus-rest ridge regression is solved in the landmarks' span. As the
kernel is an inner product of presence vectors, the landmark products fold into one matrix (n-grams by languages). A text is
scored in segments of SEGMENT bytes, many segments in one matrix product, and the segments' outputs are averaged by length: a
text in two languages goes to the longer one.

Scale. Learned from is a bounded, hash-chosen sample: PER_LANGUAGE rows of each of the LANGUAGES languages with most labelled rows.
The tasks sum up the normal equations over it, so the driver gets landmarks (LANDMARKS texts, or PER_LANDMARKS a language if that
is more, MOST_LANDMARKS at most) and matrices as wide as their number, not the sample. Scoring is map only; every whole text is
read.

Predictions use the text alone. A null text, or one with no letter (Unicode category L), is `und` with score 0; so is everything if nothing could be
learned. Repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result. Ties go to the
language first in alphabetical order.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, forget, tidy, written

PER_LANGUAGE = 600
LANGUAGES = 1000
LANDMARKS, PER_LANDMARKS, MOST_LANDMARKS = 400, 4, 2000
RIDGE = 1e-3
ORDERS = (1, 2, 3)
SEGMENT, ROWS = 600, 256

_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers such as fractions that aren't digits


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_PLAIN), np.uint8)


def _codes(text: np.ndarray) -> list[np.ndarray]:
    """The n-grams of a text's bytes as numbers, by n, with repeats."""
    a = text.astype(np.int32)
    two = a[:-1] | a[1:] << 8
    return [a, two, two[:-1] | a[2:] << 16]


def held_out(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 3 == 1


class Model:
    """languages; for each n the n-grams known, as a table from n-gram to column (0: unknown); weights (columns, languages)."""

    def __init__(self, languages: list[str], known: list[np.ndarray], weights: list[np.ndarray]):
        self.languages, self.known, self.weights = languages, known, weights
        self._tables: list[np.ndarray] | None = None

    def __getstate__(self):
        return {**self.__dict__, "_tables": None}

    def _lookup(self) -> list[np.ndarray]:
        if self._tables is None:
            self._tables = []
            for n, codes in zip(ORDERS, self.known):
                t = np.zeros(1 << (8 * n), np.int32)
                t[codes] = np.arange(1, len(codes) + 1)
                self._tables.append(t)
        return self._tables

    def scores(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): the kernel machine's output on each segment, averaged by length over the whole text."""
        tables, total = self._lookup(), np.zeros((len(texts), len(self.languages)), np.float64)
        most = max(16, min(ROWS, (1 << 24) // (1 + max(map(len, self.known)))))
        present = [np.zeros((most, len(k) + 1), np.float32) for k in self.known]
        unknown = [np.zeros(most, np.float32) for _ in self.known]  # n-grams of a segment that aren't known, with repeats
        owner, weight = np.zeros(most, np.int64), np.zeros(most)
        used = 0

        def flush() -> None:
            out = np.zeros((used, len(self.languages)), np.float32)
            for p, u, w in zip(present, unknown, self.weights):
                p[:, 0] = 0
                out += (p[:used, 1:] @ w) / np.sqrt(np.maximum(p[:used].sum(1) + u[:used], 1))[:, None]
                p[:used] = 0
                u[:used] = 0
            np.add.at(total, owner[:used], out * weight[:used, None])

        for i, text in enumerate(texts):
            a = _bytes(text)
            for lo in range(0, len(a), most * SEGMENT):
                codes = _codes(a[lo : lo + most * SEGMENT + 2])
                n = min(len(a) - lo, most * SEGMENT)
                rows = -(-n // SEGMENT)
                if used + rows > most:
                    flush()
                    used = 0
                at = np.arange(n) // SEGMENT + used
                for p, u, t, c in zip(present, unknown, tables, codes):
                    column = t[c[:n]]
                    p[at[: len(column)], column] = 1
                    u += np.bincount(at[: len(column)][column == 0], minlength=most)
                owner[used : used + rows] = i
                weight[used : used + rows] = np.minimum(SEGMENT, n - SEGMENT * np.arange(rows)) / len(a)
                used += rows
        flush()
        return total


def _sample(rows: DataFrame, per_language: int) -> DataFrame | None:
    """doc_id, lang, h, text: per_language doc_ids of each language at most, one row each however often a doc_id is repeated
    (the smallest of its texts). rows carries h, a hash of doc_id."""
    common = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["n"] for r in common.collect()}
    if not counts:
        return None
    # a first cut by hash leaves a few times what is needed, so no window sees a whole language
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 3 * per_language / max(n, 1)))))
    near = rows.filter((F.col("h").cast("double") / 2.0**64 + 0.5) <= F.element_at(share, F.col("lang")))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = near.select("lang", "h", "doc_id").distinct().withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language)
    picked = near.join(F.broadcast(ids.select("lang", "doc_id")), ["lang", "doc_id"], "left_semi")
    return picked.groupBy("doc_id", "lang", "h").agg(F.min("text").alias("text"))


def _presence(sets: list[list[np.ndarray]], known: list[np.ndarray]) -> list[np.ndarray]:
    """For each order the presence vectors of texts over the known n-grams, normalised by all n-grams of the text. sets: a text's
    n-grams by order."""
    out = []
    for n, codes in enumerate(known):
        x = np.zeros((len(sets), len(codes)), np.float32)
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(codes, s[n]), len(codes) - 1)
            x[i, at[codes[at] == s[n]]] = 1
        out.append(x / np.sqrt([max(len(s[n]), 1) for s in sets])[:, None].astype(np.float32))
    return out


def _sets(text: str) -> list[np.ndarray]:
    return [np.unique(c).astype(np.int32) for c in _codes(_bytes(text))]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Learn from (doc_id, text, lang): the rows with a language and a letter that come first by hash, per_language of each."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = docs.filter("lang is not null and text is not null").withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    sample = _sample(rows, per_language)
    if sample is None:
        return None
    spark = docs.sparkSession

    def lettered(batches):
        for batch in batches:
            yield batch.filter(pa.array([has_letter(t) for t in batch.column(2).to_pylist()], pa.bool_()))

    sample = written(sample.select("lang", "h", "text").mapInArrow(lettered, "lang string, h long, text string"), "sample")
    counts = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # LANGUAGES rows at most
    if not counts:
        return None
    languages = sorted(counts)
    m = max(landmarks, min(MOST_LANDMARKS, PER_LANDMARKS * len(languages)))
    each = Window.partitionBy("lang").orderBy("h", "text")  # per_language rows
    first = sample.withColumn("k", F.row_number().over(each)).orderBy("k", "h", "lang").limit(m)  # the first of each language, then the second, ...
    chosen = [_sets(r["text"]) for r in first.select("k", "h", "lang", "text").orderBy("k", "h", "lang").collect()]
    known = [np.unique(np.concatenate([c[n] for c in chosen])) for n in range(len(ORDERS))]
    marks = _presence(chosen, known)
    total = sum(counts.values())
    weight = {lang: total / (n * len(counts)) for lang, n in counts.items()}
    shared = spark.sparkContext.broadcast((marks, known, languages, weight))  # landmarks: bounded

    def equations(batches):
        marks, known, languages, weight = shared.value
        place = {x: i for i, x in enumerate(languages)}
        left, right = np.zeros((len(marks[0]),) * 2), np.zeros((len(marks[0]), len(languages)))
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 128):
                phi = _presence([_sets(t) for t in texts[lo : lo + 128]], known)
                kernel = sum(x @ y.T for x, y in zip(phi, marks)).astype(np.float64) / len(ORDERS)
                w = np.array([weight[x] for x in langs[lo : lo + 128]])[:, None]
                at = np.array([place[x] for x in langs[lo : lo + 128]])
                left += (kernel * w).T @ kernel
                right += (kernel * w).T @ (at[:, None] == np.arange(len(languages)))
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], ["l", "r"])

    parts = sample.select("lang", "text").repartition(min(16, -(-total // 500))).mapInArrow(tidy(equations), "l binary, r binary")
    left, right = np.zeros((len(chosen),) * 2), np.zeros((len(chosen), len(languages)))
    for r in parts.toLocalIterator():  # 16 at most, one at a time
        left += np.frombuffer(r["l"]).reshape(left.shape)
        right += np.frombuffer(r["r"]).reshape(right.shape)
    own = sum(x @ x.T for x in marks).astype(np.float64) / len(ORDERS)
    alpha = np.linalg.solve(left + ridge * total * (own + 1e-6 * np.eye(len(chosen))), right)
    forget(sample)
    return Model(languages, known, [(x.T.astype(np.float64) @ alpha / len(ORDERS)).astype(np.float32) for x in marks])


def marked(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with its columns renamed by place (u0, u1, ...), so that no name clashes, and lang_pred and score."""
    place = docs.columns.index("text")
    picked = by_place(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-gram tables: bounded by the sample, not the corpus

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(place).cast(pa.large_string()).to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if has_letter(t)] if m else []
            if at:
                s = m.scores([texts[i] for i in at])
                for i, row in zip(at, s):
                    best = int(row.argmax())
                    pred[i], score[i] = m.languages[best], float(min(1.0, max(0.0, row[best])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*picked_names, "lang_pred", "score"])

    picked_names = picked.columns
    fields = T.StructType([*picked.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return picked.mapInArrow(tidy(run), fields)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of docs, then lang_pred and score (which take the place of columns of the same names)."""
    keep = [i for i, c in enumerate(docs.columns) if c not in ("lang_pred", "score")]
    out = marked(docs, model).select(*(f"u{i}" for i in keep), "lang_pred", "score")
    return out.toDF(*(docs.columns[i] for i in keep), "lang_pred", "score")


def predict_languages(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that aren't held out, predicted for all."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    model = train(docs.filter(~F.coalesce(held_out(), F.lit(True))), **how)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
