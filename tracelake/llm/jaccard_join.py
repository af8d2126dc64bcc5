"""Exact n-gram Jaccard self-join by set relations, and its connected components.

Method. A document is the set of its 5-word shingles. Two sets with |A n B| >= t |A u B| share a token of both their
prefixes (the first |A| - ceil(t |A|) + 1 tokens in one global order, rare tokens first), so index lists over prefix
tokens hold every pair that can link. Set relations then save most of the work on those lists:

* index-level skipping: a list is sorted by set size and token position and cut into blocks that know their sizes and the most
  tokens any entry has left; whole blocks are skipped where the size or position bound forbids a link;
* answer-level skipping: in a long list each set is first compared with one pivot only. Sets that link with the pivot are
  in one component, so pairs inside it need no comparison. For sets x and y with known overlaps with a pivot p,
  |x n y| <= min(|x n p|, |y n p|) + min(|x - p|, |y - p|), so y's answer "no" against x is derived and not computed.
  Pairs left after some pivot rounds are compared one by one: no link is lost, whatever the data.

A shingle is named by 64 bits of a hash of its words. Two different shingles of one pair of documents share a name with a
probability of |A| |B| / 2^64 (under 1e-12 for two texts of 4,000 words); that is the only way in which a count can be wrong.

Scale. Tokens leave each task as packed blobs for their hash range (no row per token, seven bytes a token or fewer: the range
gives the rest); a range answers which of them other sets share. Ranges hold about RANGE_BYTES of the table each, however large
it is; a task that serves several takes them one after the other. A document of which fewer than ceil(t n) shingles are shared
can't link and ends there; only the others' sets are kept. A token that many sets of one unit hold is reported once for the unit
(hot passages), equal sets become one. Nothing but counts reaches the driver.

Null or empty texts have the empty set and link with nothing; repeated rows are copies and link (if not empty); rows that share a
doc_id are one document: it links wherever one of its rows does, and all of them get its component (n_shingles is the row's own);
a row with a null doc_id is no document: it links nothing and gets the component of the documents that have its set, if there are
any, else null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, forget, parts_for, plan_bytes, shingle_sets, text_bytes, tidy, written

UNIT_TOKENS = 1_000_000
HOT_IN_UNIT = 256
SMALL_LIST = 12
PIVOT_ROUNDS = 3
SKIP_BLOCK = 64
OPEN_PAIRS = 32
#: Bytes of the table to a hash range (a byte of a compressed table is about a quarter of a token), ranges at least, tasks at most.
RANGE_BYTES, LEAST_RANGES, MOST_TASKS = 8 << 20, 256, 1 << 17

_SETS = "doc_id long, d1 long, d2 long, n long"
_BLOB = "part int, unit long, kind int, docs binary, tokens binary"


def _digest(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _ranges(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """The hash range of each token: equal cuts of the token space (2**31 ranges at most)."""
    return ((tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _start(part: int, ranges: int) -> np.uint64:
    """The least token of a range."""
    return np.uint64(-(-part * (1 << 32) // ranges) << 32)


def _width(ranges: int) -> int:
    """Bytes that tell the tokens of one range apart."""
    return -(-(64 - (ranges.bit_length() - 1)) // 8)


def _pack(tokens: np.ndarray, part: int, ranges: int) -> bytes:
    """Each token of a range as its distance from the range's start."""
    return (tokens - _start(part, ranges)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _width(ranges)].tobytes()


def _unpack(blob: bytes, part: int, ranges: int) -> np.ndarray:
    out = np.zeros((len(blob) // _width(ranges), 8), np.uint8)
    out[:, : _width(ranges)] = np.frombuffer(blob, np.uint8).reshape(-1, _width(ranges))
    return out.view("<u8").ravel() + _start(part, ranges)


def _steps(docs: np.ndarray) -> bytes:
    """Ascending numbers as steps, after a byte that says how wide these are."""
    steps = np.diff(docs.astype(np.int64), prepend=0)
    width = 1 if steps.max() < 1 << 8 else 2 if steps.max() < 1 << 16 else 4
    return bytes([width]) + steps.astype(f"<u{width}").tobytes()


def _numbers(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, f"<u{blob[0]}", offset=1), dtype=np.int64)


def _need(n: np.ndarray, pct: int) -> np.ndarray:
    """The least overlap with any set that a set of n tokens needs: ceil(pct n / 100)."""
    return -(-np.asarray(n, np.int64) * pct // 100)


def _batch(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for (_, t), c in zip(schema, columns)], [n for n, _ in schema])


def _tokens_of(batch: pa.RecordBatch, k: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
    for lo, hi in chunks(texts):
        yield ids[lo:hi], shingle_sets(texts[lo:hi], k)


def set_sizes(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, the 128-bit digest (d1, d2) of its shingle set, and the set's size n."""

    def run(batches):
        kinds = [("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int64())]
        for batch in batches:
            for ids, sets in _tokens_of(batch, k):
                d = [_digest(s) for s in sets]
                yield _batch(kinds, [ids, [x[0] for x in d], [x[1] for x in d], [len(s) for s in sets]])

    return docs.mapInArrow(tidy(run), _SETS)


def _emit(docs: DataFrame, k: int, ranges: int) -> DataFrame:
    """Kind 0: tokens for their hash range, by document of a unit; 1: a unit's table of documents; 2: tokens hot in a unit, by
    document, only to be handed on; 3: the distinct tokens that are hot in a unit."""
    kinds = [("part", pa.int32()), ("unit", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("tokens", pa.binary())]

    def run(batches):
        pid, seq = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        sets: list[np.ndarray] = []

        def flush():
            unit = (pid << 24) | seq
            digests = [_digest(s) for s in sets]
            first: dict[tuple[int, int], int] = {}
            for i, d in enumerate(digests):  # copies within the unit: the smallest doc_id stands for them
                j = first.get(d)
                if j is None or ids[i] < ids[j]:
                    first[d] = i
            keep = [i for i in first.values() if len(sets[i])]
            if not keep:
                return
            about = np.array([(ids[i], *digests[i], len(sets[i])) for i in keep], np.int64)
            tokens = np.concatenate([sets[i] for i in keep])
            docs_ = np.repeat(np.arange(len(keep), dtype=np.uint32), about[:, 3])
            order = np.argsort(tokens, kind="stable")  # by hash range, then token, then document
            t, d = tokens[order], docs_[order]
            starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            hot = np.repeat(np.diff(np.append(starts, len(t))) > HOT_IN_UNIT, np.diff(np.append(starts, len(t))))
            rows = [[unit % ranges], [unit], [1], [about.tobytes()], [b""]]
            for kind, which in ((0, ~hot), (2, hot)):
                tt, dd = t[which], d[which]
                part = _ranges(tt, ranges)
                cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else [0]
                for lo, hi in zip(cut[:-1], cut[1:]):
                    p, x, y = int(part[lo]), tt[lo:hi], dd[lo:hi]
                    o = np.argsort(y, kind="stable")
                    x, y = x[o], y[o]
                    for c, v in zip(rows, (p, unit, kind, _steps(y), _pack(x, p, ranges))):
                        c.append(v)
                    if kind == 2:
                        for c, v in zip(rows, (p, unit, 3, b"", _pack(np.unique(x), p, ranges))):
                            c.append(v)
            yield _batch(kinds, rows)

        held = 0
        for batch in batches:
            for i, s in _tokens_of(batch, k):
                ids += i
                sets += s
                held += sum(map(len, s))
                if held >= UNIT_TOKENS:
                    yield from flush()
                    seq, held = seq + 1, 0
                    ids.clear(), sets.clear()
        yield from flush()

    return docs.mapInArrow(tidy(run), _BLOB)


def _shared(blobs: DataFrame, ranges: int) -> DataFrame:
    """For each hash range, hand on to each unit those of its tokens that occur again, with how often (capped to 16 bits). Rows come
    sorted by range; one range is held at a time."""
    kinds = [("part", pa.int32()), ("unit", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("tokens", pa.binary()), ("often", pa.binary())]
    width = _width(ranges)

    def answers(part: int, mine: list, hot: list):
        hot = np.unique(np.concatenate(hot)) if hot else np.zeros(0, np.uint64)
        every = np.sort(np.concatenate([_unpack(m[2], part, ranges) for m in mine]))
        starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        n = np.diff(np.append(starts, len(every)))
        again = n > 1
        if len(hot):
            again |= np.isin(every[starts], hot)
        values, n = every[starts][again], np.minimum(n[again], 65534)
        if len(hot):
            n[np.isin(values, hot)] = 65535
        del every, starts
        if not len(values):
            return
        for unit, docs, blob in mine:
            tokens = _unpack(blob, part, ranges)
            at = np.minimum(np.searchsorted(values, tokens), len(values) - 1)
            found = values[at] == tokens
            if found.any():
                yield _batch(kinds, [[part], [unit], [0], [_steps(_numbers(docs)[found])], [_pack(tokens[found], part, ranges)], [n[at[found]].astype(np.uint16).tobytes()]])

    def run(batches):
        at, mine, hot = -1, [], []
        for batch in batches:
            for part, unit, kind, docs, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    if mine:
                        yield from answers(at, mine, hot)
                    at, mine, hot = part, [], []
                if kind == 0:
                    mine.append((unit, docs, tokens))
                elif kind == 3:
                    hot.append(_unpack(tokens, part, ranges))
                else:
                    yield _batch(kinds, [[part], [unit], [kind], [docs], [tokens], [np.full(len(tokens) // width, 65535, np.uint16).tobytes()]])
        if mine:
            yield from answers(at, mine, hot)

    return blobs.mapInArrow(tidy(run), "part int, unit long, kind int, docs binary, tokens binary, often binary")


def _candidates(shared: DataFrame, pct: int, ranges: int) -> DataFrame:
    """Put each unit's documents together again: those with enough shared tokens, with these sorted and the open prefix."""
    kinds = [("sid", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int64()), ("alone", pa.int64()), ("prefix", pa.binary()), ("tokens", pa.binary())]

    def run(batches):
        about: dict[int, np.ndarray] = {}
        got: dict[int, list] = {}
        for batch in batches:
            for part, unit, kind, docs, tokens, often in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 1:
                    about[unit] = np.frombuffer(docs, np.int64).reshape(-1, 4)
                else:
                    got.setdefault(unit, []).append((_numbers(docs), _unpack(tokens, part, ranges), np.frombuffer(often, np.uint16)))
        for unit, parts in got.items():
            table = about[unit]
            owner, tokens, often = (np.concatenate([p[i] for p in parts]) for i in range(3))
            have = np.bincount(owner, minlength=len(table))
            fit = have >= np.maximum(1, _need(table[:, 3], pct))
            use = fit[owner]
            owner, tokens, often = owner[use], tokens[use], often[use]
            order = np.lexsort((tokens, often, owner))
            owner, tokens = owner[order], tokens[order]
            cut = np.searchsorted(owner, np.arange(len(table) + 1))
            rows: list[list] = [[] for _ in kinds]
            for i in np.flatnonzero(fit):
                doc, d1, d2, n = table[i].tolist()
                t = tokens[cut[i] : cut[i + 1]]
                alone = n - len(t)
                prefix = t[: max(0, n - int(_need(n, pct)) + 1 - alone)]
                for c, v in zip(rows, (doc, d1, d2, n, alone, prefix.tobytes(), np.sort(t).tobytes())):
                    c.append(v)
            yield _batch(kinds, rows)

    return shared.mapInArrow(tidy(run), "sid long, d1 long, d2 long, n long, alone long, prefix binary, tokens binary")


def _entries(sets: DataFrame) -> DataFrame:
    """One index entry for each open prefix token of a set: token, set, size and position in the global order."""
    kinds = [("token", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())]

    def run(batches):
        for batch in batches:
            for sid, n, alone, prefix in zip(*(c.to_pylist() for c in batch.columns)):
                t = np.frombuffer(prefix, np.int64)
                yield _batch(kinds, [t, np.full(len(t), sid), np.full(len(t), n), np.arange(len(t)) + alone])

    return sets.select("sid", "n", "alone", "prefix").mapInArrow(tidy(run), "token long, sid long, n long, pos long")


def _lists(batches, width: int):
    """Index lists from rows sorted by token, size and set: one array each."""
    rest = np.zeros((0, width), np.int64)
    for batch in batches:
        cols = np.stack([np.asarray(c.fill_null(-1) if c.null_count else c) for c in batch.columns], 1)
        rest = np.concatenate((rest, cols)) if len(rest) else cols
        if not len(rest):
            continue
        starts = np.flatnonzero(np.concatenate(([True], rest[1:, 0] != rest[:-1, 0])))
        for lo, hi in zip(starts[:-1], starts[1:]):
            if hi - lo > 1:
                yield rest[lo:hi]
        rest = rest[starts[-1] :]
    if len(rest) > 1:
        yield rest


def _possible(n: np.ndarray, pos: np.ndarray, m: int, q: int, pct: int) -> np.ndarray:
    """Can sets of sizes n with the token at pos link with a set of size m with it at q, if it is the first they share?"""
    need = -(-(n + m) * pct // (100 + pct))
    return (np.minimum(n - pos, m - q) >= need) & (np.minimum(n, m) * 100 >= pct * np.maximum(n, m))


def _pairs_out(pairs: set) -> pa.RecordBatch:
    x = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return _batch([("a", pa.int64()), ("b", pa.int64())], [x[:, 0], x[:, 1]])


class _List:
    """An index list by size and position, in blocks: which entries can link with one of them."""

    def __init__(self, sid: np.ndarray, n: np.ndarray, pos: np.ndarray, pct: int):
        self.sid, self.n, self.pos, self.pct = sid, n, pos, pct
        self.starts = np.arange(0, len(n), SKIP_BLOCK)
        self.least, self.most = n[self.starts], n[np.minimum(self.starts + SKIP_BLOCK, len(n)) - 1]
        self.room = np.maximum.reduceat(n - pos, self.starts)  # the most tokens an entry has from its position on

    def near(self, i: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The entries lo..hi that can link with entry i, i itself left out: blocks first, then the entries of the others."""
        m, left, hi = int(self.n[i]), int(self.n[i] - self.pos[i]), len(self.n) if hi is None else hi
        need = -(-(self.least + m) * self.pct // (100 + self.pct))
        live = (self.most * 100 >= self.pct * m) & (self.least * self.pct <= 100 * m) & (np.minimum(self.room, left) >= need)
        live &= (self.starts + SKIP_BLOCK > lo) & (self.starts < hi)
        at = (self.starts[live][:, None] + np.arange(SKIP_BLOCK)).ravel()
        at = at[(at >= lo) & (at < hi) & (at != i)]
        return at[_possible(self.n[at], self.pos[at], m, int(self.pos[i]), self.pct)]


def _first_pairs(entries: DataFrame, pct: int) -> DataFrame:
    """All possible pairs of a short list; of a long one, each set with a pivot of its block of sizes only."""

    def run(batches):
        pairs: set[tuple[int, int]] = set()
        for x in _lists(batches, 4):
            _, sid, n, pos = x.T
            if len(x) <= SMALL_LIST:
                for i in range(len(x) - 1):
                    ok = _possible(n[i + 1 :], pos[i + 1 :], int(n[i]), int(pos[i]), pct)
                    pairs.update((min(a, b), max(a, b)) for a, b in zip(sid[i + 1 :][ok].tolist(), [int(sid[i])] * int(ok.sum())))
            else:
                i, held = 0, _List(sid, n, pos, pct)
                while i < len(x):  # the block that a pivot's size allows; later blocks have their own
                    end = int(np.searchsorted(n, n[i] * 100 // pct, "right"))
                    mid = i + int(np.argmin(sid[i:end]))
                    p = int(sid[mid])
                    pairs.update((min(p, s), max(p, s)) for s in sid[held.near(mid, i, end)].tolist())
                    i = max(end, i + 1)
            if len(pairs) > 500_000:
                yield _pairs_out(pairs)
                pairs.clear()
        yield _pairs_out(pairs)

    return entries.mapInArrow(tidy(run), "a long, b long").distinct()


def _open_pairs(x: np.ndarray, pct: int, last: bool):
    """(entry, entries) of a long list that no known answer settles, each pair once. Unless it is the last round, a list with many
    of them yields those of one entry only, a new pivot. Memory follows the list's length."""
    _, sid, n, pos, comp, pivot, common = x.T
    group, size = np.unique(comp, return_counts=True)
    main = group[np.argmax(size)]
    held = _List(sid, n, pos, pct)
    kept, total, widest = [], 0, (-1, np.zeros(0, np.int64))
    for i in np.argsort(sid, kind="stable").tolist():  # an order that sizes don't decide
        if comp[i] == main:
            continue
        y = held.near(i)
        y = y[(comp[y] != comp[i]) & ((comp[y] == main) | (y > i)) & (pivot[y] != sid[i]) & (sid[y] != pivot[i])]  # the last two: answered
        if pivot[i] >= 0 and len(y):
            most = np.minimum(common[y], common[i]) + np.minimum(n[y] - common[y], n[i] - common[i])
            y = y[(pivot[y] != pivot[i]) | (most >= -(-(n[y] + n[i]) * pct // (100 + pct)))]
        if not len(y):
            continue
        if last:
            yield i, y
            continue
        total += len(y)
        widest = max(widest, (i, y), key=lambda e: len(e[1]))
        if total > OPEN_PAIRS * len(x):
            yield widest
            return
        kept.append((i, y))
    yield from kept


def _next_pairs(entries: DataFrame, pct: int, last: bool) -> DataFrame:
    """Possible pairs of a long list that no known answer settles. Entries also carry the set's component, a pivot it was
    compared with, and their overlap. Unless it is the last round, a list with many open pairs gets one new pivot."""

    def run(batches):
        pairs: set[tuple[int, int]] = set()
        for x in _lists(batches, 7):
            if len(x) <= SMALL_LIST or (x[:, 4] == x[0, 4]).all():
                continue
            sid = x[:, 1]
            for i, y in _open_pairs(x, pct, last):
                s = int(sid[i])
                pairs.update((min(s, t), max(s, t)) for t in sid[y].tolist())
                if len(pairs) > 500_000:
                    yield _pairs_out(pairs)
                    pairs.clear()
        yield _pairs_out(pairs)

    return entries.mapInArrow(tidy(run), "a long, b long").distinct()


def _overlaps(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """a, b, their overlap, and whether they link: counted on the whole sets."""
    have = sets.select("sid", "n", "tokens")
    left = pairs.join(have.toDF("a", "na", "ta"), "a")
    both = left.join(have.toDF("b", "nb", "tb"), "b").select("a", "b", "na", "nb", "ta", "tb")

    def run(batches):
        kinds = [("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("linked", pa.bool_())]
        for batch in batches:
            a, b, na, nb, ta, tb = (c.to_pylist() for c in batch.columns)
            common = []
            for x, y in zip(ta, tb):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                z = np.sort(np.concatenate((x, y)), kind="stable")
                common.append(int((z[1:] == z[:-1]).sum()))
            linked = [100 * c >= pct * (p + q - c) for c, p, q in zip(common, na, nb)]
            yield _batch(kinds, [a, b, common, linked])

    return both.mapInArrow(tidy(run), "a long, b long, common long, linked boolean")


def link_components(docs: DataFrame, pct: int = 80, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(sets, comps) for documents (doc_id, text): each document's set digest and size, and for the sets that link with a
    different one, their digest and component. pct: the Jaccard threshold in hundredths."""
    spark = docs.sparkSession
    wanted = max(8, -(-plan_bytes(docs) // RANGE_BYTES)) if plan_bytes(docs) < 1 << 55 else parts_for(docs)
    parts = min(MOST_TASKS, wanted)
    each = max(-(-wanted // parts), -(-LEAST_RANGES // parts))  # ranges to a task
    ranges = parts * each
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blobs = _emit(docs.filter("doc_id is not null"), k, ranges).repartitionById(parts, F.floor(F.col("part") / each).cast("int")).sortWithinPartitions("part")
    shared = _shared(blobs, ranges)
    units = max(8, parts // 2)
    cand = _candidates(shared.repartitionById(units, F.pmod(F.xxhash64("unit"), F.lit(units)).cast("int")), pct, ranges)
    rest = [F.first(c).alias(c) for c in ("n", "alone", "prefix", "tokens")]  # equal for equal sets
    sets = written(cand.groupBy("d1", "d2").agg(F.min("sid").alias("sid"), *rest), "sets")
    # sets of one doc_id share a name: an overlap with it is that of any of them, and says nothing about the others
    shared_names = written(sets.groupBy("sid").count().filter("count > 1").select("sid"), "names")
    unclear = not shared_names.isEmpty()
    few = max(8, min(parts, spark.sparkContext.defaultParallelism * 4))
    entries = written(_entries(sets), "entries")
    index = entries.repartition(few, "token").sortWithinPartitions("token", "n", "pos", "sid")
    answers = written(_overlaps(_first_pairs(index, pct), sets, pct), "answers")
    spent: list[DataFrame] = [entries, shared_names]  # deleted at the end: nothing of the result is read from them
    for turn in range(PIVOT_ROUNDS):
        comps = written(components(answers.filter("linked"), "a", "b"), "comps")
        spent += [comps, answers]
        both = answers.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), "common").union(answers.select("b", "a", "common"))
        if unclear:
            both = both.join(shared_names, "sid", "left_anti").join(shared_names.withColumnRenamed("sid", "pivot"), "pivot", "left_anti").select("sid", "pivot", "common")
        hub = both.groupBy("pivot").count().filter(F.col("count") > 1)
        near = both.join(hub, "pivot").groupBy("sid").agg(F.max_by(F.struct("pivot", "common"), F.struct("count", "pivot")).alias("p"))
        long_ = entries.groupBy("token").agg(F.count("*").alias("m")).filter(F.col("m") > SMALL_LIST).select("token")
        about = sets.select("sid").join(comps.withColumnRenamed("node", "sid"), "sid", "left").join(near, "sid", "left")
        about = about.select("sid", F.coalesce("comp", "sid").alias("comp"), F.coalesce("p.pivot", F.lit(-1)).alias("pivot"), F.coalesce("p.common", F.lit(0)).alias("common"))
        open_ = entries.join(long_, "token").join(about, "sid").select("token", "sid", "n", "pos", "comp", "pivot", "common")
        mixed = open_.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("token")
        open_ = open_.join(mixed, "token").repartition(few, "token").sortWithinPartitions("token", "n", "pos", "sid")
        last = turn == PIVOT_ROUNDS - 1
        asked = written(_next_pairs(open_, pct, last), "asked")
        more = written(asked.join(answers.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        spent += [asked, more]
        if more.isEmpty() and not last and not asked.isEmpty():
            last = True  # the lists asked for pivots already answered, which settles nothing: compare their other pairs
            more = written(_next_pairs(open_, pct, last).join(answers.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
            spent.append(more)
        if more.isEmpty():
            break
        answers = written(answers.union(_overlaps(more, sets, pct)), "answers")
        if last:
            comps = written(components(answers.filter("linked"), "a", "b"), "comps")
            spent += [comps, answers]
            break
    found = written(sets.join(comps.withColumnRenamed("node", "sid"), "sid").select("d1", "d2", "comp"), "found")
    forget(*spent, sets)
    return set_sizes(docs, k), found


def jaccard_components(docs: DataFrame, pct: int = 80, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links of Jaccard similarity pct / 100 or more."""
    sizes, found = link_components(docs, pct, k)
    sizes = written(sizes, "sizes")
    same = sizes.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"))
    same = same.join(found, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("comp", "least").alias("component"))
    same = written(same, "same")  # a table of its own: the join can then split the rows of a digest that very many share
    out = sizes.join(same, ["d1", "d2"], "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    # rows that share a doc_id but not their set join what their sets belong to
    twice = sizes.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y")).filter("x <> y")
    twice = written(twice.select("doc_id"), "repeated")
    if twice.isEmpty():
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    bridges = out.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
    whole = written(components(bridges), "whole")
    out = out.join(whole.select(F.col("node").alias("component"), "comp"), "component", "left").withColumn("component", F.coalesce("comp", "component"))
    # the document's own rows, the empty ones among them, lie in its component
    mine = whole.join(twice, whole["node"] == twice["doc_id"], "left_semi").select(F.col("node").alias("doc_id"), F.col("comp").alias("own"))
    out = out.join(mine, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("own", "component").alias("component_id"))
