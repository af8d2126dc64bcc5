import random
import re
import tracemalloc

import numpy as np
import pytest

from tracelake.llm import common
from tracelake.llm import jaccard_join as jj


def brute(rows, pct=80, k=5):
    sets, texts = {}, dict(rows)
    if len(texts) < len(rows):  # rows that share a doc_id: brute force over rows, then one node for each doc_id
        return brute_rows(rows, pct, k)
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i)) for i in ids}


def brute_rows(rows, pct, k):
    found = brute(list(enumerate(t for _, t in rows)), pct, k)
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for row, n, least in found:
        a, b = root(rows[row][0]), root(rows[least][0])
        up[max(a, b)] = min(a, b)
    return {(rows[row][0], n, root(rows[row][0])) for row, n, _ in found}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = r.choices(words, k=60)
    rows = []
    for _ in range(60):
        base = r.choices(words, k=r.choice([3, 8, 40, 150]))
        if r.random() < 0.3:
            base[5:5] = passage
        for _ in range(r.choice([1, 1, 2, 6])):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                x[r.randrange(len(x))] = r.choice(words)
            rows.append(" ".join(x))
    family = r.choices(words, k=120)  # a long index list, with members near and at the threshold
    for _ in range(80):
        x = list(family)
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            x[r.randrange(len(x))] = r.choice(words)
        rows.append(" ".join(x))
    rows += [None, "", "  \n", "one", "One", "a b c d", "A b  c\td", "É b c d e", "é b c d e"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in jj.jaccard_components(df).collect()}
    assert got == brute(rows)


def test_extra_columns_copies_and_empty(spark):
    rows = [(5, "a b c d e f", 1), (3, "a b c d e f", 2), (9, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumnRenamed("n", "component_id")
    assert {tuple(r) for r in jj.jaccard_components(df).collect()} == {(5, 2, 3), (3, 2, 3), (9, 0, 9)}
    assert jj.jaccard_components(df.limit(0)).count() == 0


def test_short_lists_disabled_gives_the_same(spark, monkeypatch):
    """Pivot rounds for every list, units of one flush and hot tokens everywhere: nothing is lost."""
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(jj, "SMALL_LIST", 2)
    monkeypatch.setattr(jj, "HOT_IN_UNIT", 3)
    monkeypatch.setattr(jj, "UNIT_TOKENS", 2000)
    assert {tuple(r) for r in jj.jaccard_components(df).collect()} == brute(rows)


def test_rows_that_share_a_doc_id_are_one_document(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    rows = [(5, a), (7, a), (7, b), (9, b), (11, c), (11, None), (13, ""), (13, c), (20, "x y z"), (20, "x y z"), (21, None), (21, "")]
    got = {tuple(r) for r in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == {(5, 3, 5), (7, 3, 5), (9, 3, 5), (11, 3, 11), (11, 0, 11), (13, 0, 11), (13, 3, 11), (20, 1, 20), (21, 0, 21)}
    r = random.Random(6)
    rows = [(r.randrange(150), t) for _, t in corpus(4)]
    got = {tuple(x) for x in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_null_doc_ids_are_no_documents(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "other words"), (None, None)]
    got = sorted((tuple(r) for r in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (None, 1, None), (None, 0, None)], key=repr)


@pytest.mark.parametrize("ranges", [256, 280, 1000, 65536, 131072, 1 << 20])
def test_tokens_survive_packing_by_range(ranges):
    t = np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64)
    t = np.sort(np.concatenate((t, np.array([0, 1, (1 << 64) - 1, 1 << 63], np.uint64), *([jj._start(p, ranges)] for p in (1, ranges // 2, ranges - 1)))))
    part = jj._ranges(t, ranges)
    assert (np.diff(part) >= 0).all() and part[0] == 0 and part[-1] == ranges - 1
    assert jj._width(ranges) == (7 if ranges < 65536 else 6)
    for p in np.unique(part).tolist():
        mine = t[part == p]
        assert np.array_equal(jj._unpack(jj._pack(mine, p, ranges), p, ranges), mine)


def test_more_ranges_than_tasks(spark, monkeypatch):
    monkeypatch.setattr(jj, "MOST_TASKS", 3)
    monkeypatch.setattr(jj, "RANGE_BYTES", 40)
    rows = corpus(5)
    assert {tuple(r) for r in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_long_words_hash_apart():
    x = b"a" * 65536
    words = [b"b" + x + b"c", b"c" + x + b"b", b"b" + x + b"C", x, x + b"a"]
    h, counts = common.word_hashes([b" ".join(words), b"\n" + words[0] + b"\t "])
    assert counts.tolist() == [5, 1] and h[0] == h[5] == h[2] and len(set(h.tolist())) == 4


def test_blocks_skip_only_what_can_not_link():
    r = np.random.default_rng(2)
    n = np.sort(r.integers(5, 400, 1000))
    pos = (r.random(1000) * n).astype(np.int64)
    order = np.lexsort((pos, n))
    n, pos = n[order], pos[order]
    held = jj._List(np.arange(1000), n, pos, 80)
    for i in range(0, 1000, 7):
        want = np.flatnonzero(jj._possible(n, pos, int(n[i]), int(pos[i]), 80))
        assert held.near(i).tolist() == [j for j in want.tolist() if j != i]
        assert held.near(i, 100, 333).tolist() == [j for j in want.tolist() if j != i and 100 <= j < 333]


def test_a_long_list_of_open_sets_fits_in_memory():
    m = 50_000
    sid = np.arange(m)
    x = np.stack([np.zeros(m, np.int64), sid, np.full(m, 100), np.zeros(m, np.int64), sid, np.full(m, -1), np.zeros(m, np.int64)], 1)
    for last in (False, True):
        tracemalloc.start()
        found = jj._open_pairs(x, 80, last)
        some = [next(found) for _ in range(1 if not last else 300)]
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert all(len(y) > 40_000 for _, y in some[1:] or some) and peak < 300_000_000
