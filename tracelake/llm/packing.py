"""Pack documents into sequences along a space-filling curve.

Method. A document's vector (its token ids, hashed) is projected to a few dimensions by a fixed random matrix; the Hilbert
index of that point is its key. Documents are range-sorted by the key and laid end to end along the curve, cut every
`capacity` tokens; so a sequence holds documents that are near each other, and only the last sequence of a range has room.

Scale. Tokens are made once and written to the shared folder as packed ids; key quantiles come from the keys alone, each counted
by its document's tokens, so ranges hold about equal tokens; one shuffle then moves the ids to their range. A key ends in bits of
a hash of doc_id and the row's place in its task, so a group of equal documents, or of rows without a doc_id, however large, is
spread over as many ranges as its share of tokens. A range streams: memory holds one Arrow batch.

A null text is empty (it is its end token alone); a null doc_id stays null; repeated rows are packed once each (their pieces can't
be told apart but by sequence and offset); ties of the key are ordered by doc_id; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, encoder, parts_for, quantile_bounds, tidy, tokenizer_path, written

DIMS, BITS = 4, 10
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve positions of integer points (rows, dims), each coordinate below 2**bits (Skilling's transform)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((4096, DIMS)).astype(np.float32)


def token_table(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, key, n, ids, window: a document's ids with the end id (unsigned little-endian 32 bits), its curve key, and its window."""

    def run(batches):
        ids_of, matrix, task, row = encoder(path), _projection(), TaskContext.get().partitionId(), 0
        for batch in batches:
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                ids = [np.array([*ids_of(t or ""), end_id], np.uint32) for t in texts[lo : lo + 256]]
                flat = np.concatenate(ids)
                at = np.cumsum([0, *map(len, ids[:-1])])
                hashed = (flat * np.uint32(2654435761)) >> np.uint32(20)
                points = np.add.reduceat(matrix[hashed], at, axis=0) / np.array([len(x) for x in ids], np.float32)[:, None]
                grid = np.clip((np.tanh(3 * points) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                tail = np.array([xxhash.xxh3_64_intdigest(f"{d}:{task}:{row + i}".encode()) & 0x3FFFFF for i, d in enumerate(docs_[lo : lo + 256])], np.int64)
                row += len(tail)
                key = (hilbert_index(grid, BITS) << 22) | tail
                yield pa.RecordBatch.from_arrays([pa.array(docs_[lo : lo + 256], pa.int64()), pa.array(key), pa.array([len(x) for x in ids], pa.int64()), pa.array([_small(x) for x in ids], pa.binary()), batch.column(2).slice(lo, 256)], ["doc_id", "key", "n", "ids", "window"])

    return docs.mapInArrow(tidy(run), "doc_id long, key long, n long, ids binary, window long")


def _small(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit (the length then says which)."""
    return ids.astype("<u2").tobytes() if int(ids.max()) < 65536 else ids.astype("<u4").tobytes()


def _large(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")


def pack_along_curve(docs: DataFrame, capacity: int = 1024, path: str | None = None, end_id: int = 0, with_ids: bool = False, window: Column | None = None) -> DataFrame:
    """One row a piece: its document, place in it, length, CRC-32 of its ids, the document's tokens, its sequence and offset
    there; with_ids adds the ids themselves (binary, unsigned little-endian 32 bits). With window, a whole number, sequences come window
    by window in its order, and only a window's documents are laid along the curve."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(0) if window is None else window).cast("long").alias("window"))
    tokens = written(token_table(docs, path or tokenizer_path(), end_id), "tokens")
    share = tokens.agg(F.avg("n")).first()[0] or 1.0
    weight = F.greatest(F.lit(1), F.round(F.col("n") * 2 / share)).cast("int")  # in halves of the mean document
    by = "key" if window is None else "window"
    bounds = quantile_bounds(tokens, by, parts_for(tokens, 16 << 20, least=1), weight)
    parts = len(bounds) + 1
    ranged = tokens.repartitionById(parts, bucket_of(F.col(by), bounds)).sortWithinPartitions("window", "key", "doc_id", "n").drop("window")

    def run(batches):
        sequence, at = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, _, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                ids, start = _large(blob, n), 0
                while start < n:
                    size = min(n - start, capacity - at)
                    piece = ids[start : start + size].tobytes()
                    for c, v in zip(out, (doc, start, size, zlib.crc32(piece), n, sequence, at, piece)):
                        c.append(v)
                    start, at = start + size, at + size
                    if at == capacity:
                        sequence, at = sequence + 1, 0
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
    return ranged.mapInArrow(tidy(run), PIECES + ", ids binary" * with_ids)
