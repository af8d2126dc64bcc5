"""Token ids packed by best-fit decreasing, as rows of id matrices.

Method. Documents are tokenized and end in an end id; a document longer than the capacity is cut into full pieces and a rest,
losslessly. Pieces of a window go, longest first, to the open sequence with the least room that still holds them; a segment
tree over the room values 0..capacity finds it in log(capacity) steps. Each sequence is one row of an id matrix (padded with
the pad id), with cumulative segment lengths and position ids that restart at each segment.

Scale. No shuffle: each task packs windows of a bounded number of tokens out of its own input, so memory is bounded and a
lost task is only run again; the room left over is that of the last sequences of a window. Sequence ids are made of the task,
the window and the row.

A null text is empty (its end id alone); a null doc_id stays null in its segment; repeated rows are packed once each; ties in length keep the input's order; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoder, id_limit, tidy, tokenizer_path

WINDOW_TOKENS = 4_000_000
ROWS = "sequence_id long, n_tokens int, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"


class RoomTree:
    """Which room values 0..capacity have an open sequence: a segment tree of counts."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def least_at_least(self, room: int) -> int:
        """The smallest room value >= room that has a sequence; -1 if none."""
        i, count = room + self.width, self.count
        if count[i]:
            return room
        while i > 1:  # up until a right neighbour has one, then down to its leftmost
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes of lengths (each at most capacity)."""
    tree, rooms, bins = RoomTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        n = lengths[i]
        room = tree.least_at_least(n)
        if room < 0:
            b, room = len(bins), capacity
            bins.append([])
        else:
            b = rooms[room].pop()
            tree.add(room, -1)
        bins[b].append(i)
        if room > n:
            rooms[room - n].append(b)
            tree.add(room - n, 1)
    return bins


def packed_rows(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 0, pad_id: int = 0) -> DataFrame:
    """One row a sequence. ids: capacity ids, unsigned little-endian 16 bits (32 if the vocabulary needs it), padded;
    position_ids: as many unsigned little-endian 32-bit positions from 0 in each segment; cu_seqlens: 0 and each segment's end;
    doc_ids and doc_starts: each segment's document, and its place in it."""
    path = path or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        ids_of, task, window = encoder(path), TaskContext.get().partitionId(), 0
        width = "<u2" if max(id_limit(path), end_id + 1, pad_id + 1) <= 1 << 16 else "<u4"  # one for the whole matrix
        pieces: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def flush():
            bins = best_fit_decreasing([len(p[2]) for p in pieces], capacity)
            counting = np.arange(capacity, dtype="<u4")
            for lo in range(0, len(bins), 2048):
                out: list[list] = [[] for _ in range(7)]
                for k, b in enumerate(bins[lo : lo + 2048], lo):
                    got = [pieces[i] for i in b]
                    ends = np.cumsum([0, *(len(p[2]) for p in got)])
                    total = int(ends[-1])
                    ids = np.full(capacity, pad_id, np.uint32)
                    ids[:total] = np.concatenate([p[2] for p in got])
                    pos = counting.copy()
                    pos[:total] -= np.repeat(ends[:-1], np.diff(ends)).astype("<u4")
                    pos[total:] = 0
                    row = ((task << 40) | (window << 24) | k, total, [p[0] for p in got], [p[1] for p in got], ends.tolist(), ids.astype(width).tobytes(), pos.tobytes())
                    for c, v in zip(out, row):
                        c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], [x.split()[0] for x in ROWS.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*ids_of(text or ""), end_id], np.uint32)
                for s in range(0, len(ids), capacity):
                    pieces.append((doc, s, ids[s : s + capacity]))
                held += len(ids)
                if held >= WINDOW_TOKENS:
                    yield from flush()
                    pieces.clear()
                    window, held = window + 1, 0
        yield from flush()

    return docs.mapInArrow(tidy(run), ROWS)


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: the id matrix is column ids (fixed width), beside its lengths and positions."""
    rows.write.mode("overwrite").parquet(path)
