"""What the operators share: components over links, word and shingle hashes, tokenizers; and the library's scratch tables."""

from __future__ import annotations

import ctypes
import gc
import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import bucket_of, forget, parts_for, plan_bytes, quantile_bounds, shared_dir, table, written

__all__ = ["bucket_of", "by_place", "chunks", "components", "encoder", "forget", "id_limit", "parts_for", "plan_bytes", "quantile_bounds", "shared_dir", "shingle_sets", "table", "text_bytes", "tidy", "tokenizer_path", "without", "word_hashes", "written"]


def tidy(run):
    """A batch function that hands freed memory back to the system when its task ends: workers live on between stages."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return wrapped


def by_place(df: DataFrame) -> DataFrame:
    """df with its columns named u0, u1, ... in order: whatever they were called, they clash with no name of an operator's own.
    toDF(*names) gives the names back."""
    return df.toDF(*(f"u{i}" for i in range(len(df.columns))))


#: A bit map of dropped keys has some 16 bits a key, 2**LEAST_BITS at least and 2**MOST_BITS at most: 32 MB, whatever the input.
LEAST_BITS, MOST_BITS = 16, 28


def without(rows: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't in drop (column key), exactly. A bit map of bounded size over the dropped keys lets most other rows go by
    without a shuffle (with up to some 50 million keys; beyond that more and more rows take the other way); rows whose bit is set
    meet the keys in a join. Any other columns are kept as they are, whatever their names."""
    names, at = rows.columns, f"u{rows.columns.index(key)}"
    drop = written(drop.select(F.col(key).cast("long").alias("_key")).distinct(), "dropped")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * drop.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << bits)) + 1  # noqa: E731 - Spark's bit maps begin at 1
    slots = drop.select(slot("_key").alias("_slot"))
    maps = slots.groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    place = F.bitmap_bit_position(slot(at))
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = by_place(rows).join(F.broadcast(maps), F.bitmap_bucket_number(slot(at)) == F.col("_bucket"), "left")
    marked = marked.withColumn("_hit", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
    clear, hit = (marked.filter(c).drop("_bucket", "_bits", "_hit") for c in (~F.col("_hit"), F.col("_hit")))
    return clear.union(hit.join(drop, hit[at].cast("long") == drop["_key"], "left_anti")).toDF(*names)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node reachable over links, for every node of a link.

    Each partition first keeps a spanning forest of its links; then large-star and small-star steps (joins and minima) go
    on until no edge changes, however many rounds that takes (about the square of the logarithm of the longest chain). Edges live
    in written tables; the driver sees two counts a round.
    """
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    edges = written(pairs.filter("u <> v").mapInArrow(_forest, "u long, v long"), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        # small star: every edge points from the larger node to a smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        last, edges = edges, written(small.filter("u <> v").distinct(), "edges")
        forget(last)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("comp")).toDF("node", "comp")
    return roots.union(edges.select("v", "v").distinct().toDF("node", "comp")).groupBy("node").agg(F.min("comp").alias("comp"))


def _forest(batches):
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(p, p)
            x = up[x]
        return x

    def flush():
        for x in list(up):
            root(x)
        us = [x for x in up if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array([root(x) for x in us], pa.int64())], ["u", "v"])
        up.clear()

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ru, rv = root(u), root(v)
            if ru != rv:
                up[max(ru, rv)] = min(ru, rv)
        if len(up) > 2_000_000:
            yield from flush()
    yield from flush()


# --- words and shingles as numbers -------------------------------------------------------------------------------------

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[_SPACE] = 0
_AT = mix(np.arange(1, 65537, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the number of words of each text."""
    joined = b" ".join([b"", *texts, b""]).translate(_LOWER)
    a = np.frombuffer(joined, np.uint8)
    space = _SPACE[a]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts]) + 1 if texts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, ends - 1), prepend=0) if texts else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    runs = np.diff(np.append(starts, len(a)))
    at = np.arange(len(a) - starts[0], dtype=np.int64) - np.repeat(starts - starts[0], runs)
    body = _BYTE[a[starts[0] :]] * _AT[at & 0xFFFF]
    out = mix(np.add.reduceat(body, starts - starts[0]))
    for i in np.flatnonzero(runs > len(_AT)).tolist():  # the weights end here: a plain hash of the word
        word = joined[starts[i] : starts[i] + runs[i]].rstrip(b"\t\n\v\f\r ")
        if len(word) > len(_AT):
            out[i] = xxhash.xxh3_64_intdigest(word)
    return out, counts


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles as 64-bit hashes; a text with fewer words is one shingle; none, if no word."""
    h, counts = word_hashes(texts)
    out, lo = [], 0
    m = np.uint64(0x9E3779B97F4A7C15)
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            s *= m
            s += h[j : len(h) - k + 1 + j]
        mix(s)
    for c in counts.tolist():
        if c >= k:
            x = np.sort(s[lo : lo + c - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif c:
            x = np.zeros(1, np.uint64)
            for w in h[lo : lo + c]:
                x = x * m + w
            out.append(mix(x * m + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        lo += c
    return out


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(items: list[bytes], size: int = 1 << 19):
    """Index ranges whose byte sizes stay near size, so that numpy's scratch arrays do."""
    lo, n = 0, 0
    for i, x in enumerate(items):
        n += len(x) + 1
        if n >= size:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(items):
        yield lo, len(items)


# --- tokenizers --------------------------------------------------------------------------------------------------------

_ENC: dict[str, object] = {}
_LIMIT: dict[str, int] = {}


def encoder(path: str):
    """ids(text) of the byte-level BPE at path (a tokenizers .json file), special strings being ordinary text.

    The vocabulary and merge ranks of that file feed tiktoken's merge loop, which gives the same ids several times faster;
    tests compare the two. A file that isn't byte-level BPE with the known pattern is run by tokenizers itself.
    """
    if path not in _ENC:
        _ENC[path] = _encoder(path)
    return _ENC[path]


def id_limit(path: str) -> int:
    """One more than the largest id of the tokenizer at path."""
    encoder(path)
    return _LIMIT[path]


#: The split pattern of this family of byte-level tokenizers.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(path: str):
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    known = spec["model"]["vocab"]
    ids = known.values() if isinstance(known, dict) else range(len(known))
    _LIMIT[path] = 1 + max([*ids, *(t["id"] for t in spec.get("added_tokens", []))], default=0)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if plain:
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        ranks = {bytes(char[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
        # ids must rise with merge order, for then an id is its merge's rank
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"][x + y] for x, y in merges]
        if all(p < q for p, q in zip(order, order[1:])):
            return tiktoken.Encoding("bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
