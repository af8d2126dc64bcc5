"""Quality, importance resampling and Merkle manifests: against plain versions and SQL, odd rows, held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import importance, manifest, quality
from tracelake.llm import queries as Q

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "One two  one", "é日本 x-1 É", "a" * 70 + " b " + "c" * 64 + " " + "d" * 65, "w " * 40, "w " * 40, ".,;", "the quick brown fox " * 9]


# --- op12 ----------------------------------------------------------------------------------------------------------------


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text):
    w = words(text)
    return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain_resample(docs, target, percent=25, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    every_s, every_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (every_s + 10000) / ((s[b] + 1) * (every_t + 10000))))
    rows = []
    for doc, text in docs:
        f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_buckets_equal_zlib():
    texts = [t or "" for t in TEXTS]
    b, owner, n = importance.feature_buckets([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert sorted(b[owner == i].tolist()) == sorted(features(t)) and n[i] == len(words(t))


@pytest.mark.parametrize("each", [100_000, 2])
def test_resample_equals_a_plain_version(spark, monkeypatch, each):
    monkeypatch.setattr(importance, "RANGE", each)
    docs = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(None, "n " * 30)] + [(5, f"common words number {i} " * 8) for i in range(4)] + [(100 + i, f"some {i % 7} more words here " * 6) for i in range(60)]
    docs += docs[-3:]
    target = ["some 3 more words", None, ""]
    df = spark.createDataFrame([(d, t, 1.5, "x") for d, t in docs], "doc_id long, text string, weight double, _b string").repartition(3)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(docs, target)


def test_resample_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, None)], none.schema)
    assert importance.resample(none, some).collect() == []
    assert [r["rank"] for r in importance.resample(some, none).collect()] == [None, None]


# --- op13 ----------------------------------------------------------------------------------------------------------------


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(nodes):
    """The node that is left, and for each of nodes its runs' siblings (left, right), level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            lo = p - p % 8
            paths[i].append(("".join(level[lo:p]), "".join(level[p + 1 : lo + 8])))
        level, at = [sha("".join(level[lo : lo + 8])) for lo in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0], paths


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by = {}
    for r in rows:
        seen = r[:4] + (r[4].translate({c: c + 32 for c in range(65, 91)}) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4],)
        by.setdefault(r[2], []).append((r[0], leaf(r), leaf(seen)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    grown = []
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        grown.append(grow([x[1] for x in by[lang]]))
    if not langs:
        return []
    root, upper = grow([g[0] for g in grown])
    out = []
    for lang, (sub, paths), above in zip(langs, grown, upper):
        for (doc, own, seen), path in zip(by[lang], paths):
            h = seen
            for a, b in path + above:
                h = sha(a + h + b)
            out.append((doc, own, sub, root, sha("".join(a + b for a, b in path + above)), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [[], [1], [2], [1, 1], [9], [8, 1], [65, 1, 9, 520], [1] * 9, [3] * 65])
def test_manifest_equals_a_plain_version(spark, sizes):
    names = [None, "en", "zé", "z", "EN", ""] + [f"l{i}" for i in range(70)]
    rows, doc = [], 0
    for name, n in zip(names, sizes):
        for i in range(n):
            doc += 1
            rows.append((doc * 7 % 1009, f"s{i % 3}" if i % 4 else None, name, i if i % 5 else None, f"Text É {i}" if i % 6 else None))
    if len(rows) > 60:
        rows += [rows[4], rows[4], (None, "s", "en", 1, "ABC"), (None, "s", "en", 2, "ABC")]
    df = spark.createDataFrame([(*r, 3, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g int, leaf string")
    got = manifest.verified(df, manifest.lowered_thirds())
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows)


def test_a_changed_row_is_found(spark):
    df = spark.createDataFrame([(i, "s", "en", 1, f"text {i}") for i in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest.verified(df, F.when(F.col("doc_id") == 41, F.lit("other")).otherwise(F.col("text")))
    assert [r["doc_id"] for r in got.filter("not verified").collect()] == [41]


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[name](spark, SF)
    want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


# --- op11 ----------------------------------------------------------------------------------------------------------------


def plain_tokens(text):
    return re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\t\n\v\f\r ]+", (text or "").encode())


def test_word_vectors_and_pools_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 60)
    monkeypatch.setattr(quality, "chunks", lambda items: ((i, min(i + 2, len(items))) for i in range(0, len(items), 2)))
    texts = ["Ab ab, 12 ab!! é日 x", None, "", " ", "one", "a a a a 3a"]
    number = lambda t: int(quality.entries([t])[0][0])
    places, signs = quality._index()
    around, seen = np.zeros((quality.WORDS, quality.DIMS)), Counter()
    for t in texts:
        b = [number(w) for w in plain_tokens(t)]
        seen.update(b)
        for i, x in enumerate(b):
            for j in range(max(0, i - 2), min(len(b), i + 3)):
                if i != j:
                    for p, s in zip(places[b[j]], signs[b[j]]):
                        around[x, p] += s
    mean, want = around.sum(0) / sum(seen.values()), np.zeros_like(around)
    for x, n in seen.items():
        v = around[x] / n - mean
        want[x] = v / max(np.sqrt(v @ v), 1e-9)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = quality.word_vectors(df)
    assert np.allclose(got, want, atol=1e-5)
    for t, row in zip(texts, quality.pooled([(t or "").encode() for t in texts], got)):
        v = [got[number(w)] for w in plain_tokens(t)]
        n = max(len(v), 1)
        mean = sum(v) / n if v else np.zeros(quality.DIMS)
        beside = sum((p * q for p, q in zip(v, v[1:])), np.zeros(quality.DIMS)) / n
        assert np.allclose(row, [*mean, *beside, np.log1p(len(v))], atol=1e-5)


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 10)
    texts = [b"abc def ghi jkl mno", b"", b"x" * 35, b"ab"]
    parts, owner = quality.pieces(texts)
    assert [b"".join(p for p, o in zip(parts, owner) if o == i) for i in range(4)] == texts and max(map(len, parts)) <= 10


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg).mean() + (pos[:, None] >= neg).mean()) / 2


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.QUERIES["op11_pooled_quality"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert auc(y, s) > 0.95 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert got.count() == 1000


def labelled(spark, n=200):
    docs = [(i, ("good words here, and more of them " if i % 2 else "### $$$ junk ### ") * (1 + i % 5)) for i in range(n)] + [(1000, None), (1001, ""), (None, "good words"), (3, "good words here")]
    return spark.createDataFrame([(d, t, t, 0.5, 7) for d, t in docs], "doc_id long, text string, x string, score double, label int"), [(i, i % 2, 0) for i in range(n)]


LABELS = "doc_id long, quality int, score int"


def test_quality_of_odd_rows(spark):
    docs, labels = labelled(spark)
    odd = labels + [(1, 0, 0), (2, 7, 0), (None, 1, 0), (5, None, 0), (4000, 1, 0)]
    rows = quality.predict_quality(docs, spark.createDataFrame(odd, LABELS)).collect()
    assert len(rows) == 204
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] is not None and r["doc_id"] < 200:
            assert r["predicted"] == r["doc_id"] % 2
    same = quality.predict_quality(docs.repartition(5), spark.createDataFrame(odd, LABELS)).collect()
    assert sorted(map(repr, same)) == sorted(map(repr, rows))


def test_quality_needs_both_classes_and_rows(spark):
    docs, labels = labelled(spark, 20)
    only = quality.predict_quality(docs, spark.createDataFrame([x for x in labels if x[1]], LABELS)).collect()
    assert {r["score"] for r in only} == {1.0}
    none = quality.predict_quality(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == 24
    assert quality.predict_quality(docs.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = labelled(spark)
    held = [(i, 1 - y, z) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, y, z) for i, y, z in labels]
    a, b = (sorted(map(repr, quality.predict_quality(docs, spark.createDataFrame(x, LABELS)).collect())) for x in (labels, held))
    assert a == b


def test_temperature_cools_an_overconfident_network():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(400, 60)), (r.random(400) < 0.5).astype(float)  # nothing to learn
    net = quality.Network(x, y, np.ones(400))
    assert net.temperature > 2 and np.abs(net.scores(r.normal(size=(500, 60))) - 0.5).mean() < 0.3
