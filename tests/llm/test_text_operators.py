"""Packing, token output, fingerprints, personal data and language: against plain versions, round trips, held-out accuracy."""

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import fingerprints as fp
from tracelake.llm import language_id, packing, pii, token_output
from tracelake.llm.common import encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "one", "One  One", "x" * 5000, "a b c " * 900, "é è 1234 +5", "\n\t ", "ONE one", "one", "Ünïcode ﬁ   x"]


def frame(spark, texts=TEXTS, start=0):
    rows = [(i * 3 + start, t, "text2") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)


@cache
def tokenizer():
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def ids(text):
    t = tokenizer()
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_tokenizers():
    e = encoder(tokenizer_path())
    for t in [*TEXTS, "<|endoftext|> a", "  \x00 日本語 😀", " \n \n  x"]:
        assert [*e(t or ""), 0] == ids(t)


@pytest.mark.parametrize("cap", [16, 1024])
def test_packing_is_lossless_and_gapless(spark, cap):
    df = frame(spark)
    rows = packing.pack_along_curve(df, cap, with_ids=True).collect()
    texts = {i * 3: t for i, t in enumerate(TEXTS)}
    seqs = {}
    for doc, text in texts.items():
        got = sorted((r["start"], r) for r in rows if r["doc_id"] == doc)
        want = np.array(ids(text), "<u4")
        assert b"".join(r["ids"] for _, r in got) == want.tobytes() and got[0][0] == 0
        for s, r in got:
            assert zlib.crc32(want[s : s + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want)
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    open_ = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= cap
        open_ += at < cap
    assert open_ <= 1
    assert packing.pack_along_curve(df.limit(0)).count() == 0


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = packing.hilbert_index(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        path = grid[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_token_rows_round_trip(spark):
    cap = 64
    df = frame(spark)
    back = {}
    for r in token_output.packed_rows(df, cap).collect():
        row, pos, cu = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["position_ids"], "<u4"), r["cu_seqlens"]
        assert len(row) == len(pos) == cap and cu[0] == 0 and cu[-1] == r["n_tokens"] <= cap
        for d, s, a, b in zip(r["doc_ids"], r["doc_starts"], cu, cu[1:]):
            back.setdefault(d, {})[s] = row[a:b].tolist()
            assert pos[a:b].tolist() == list(range(b - a))
        assert not row[cu[-1] :].any() and not pos[cu[-1] :].any()
    for i, t in enumerate(TEXTS):
        assert [x for _, p in sorted(back[3 * i].items()) for x in p] == ids(t)
    assert token_output.packed_rows(df.limit(0)).count() == 0


def test_written_rows_have_one_width(spark, tmp_path):
    df = frame(spark)
    token_output.write_packed(token_output.packed_rows(df, 64), str(tmp_path / "ids"))
    back = spark.read.parquet(str(tmp_path / "ids")).collect()
    assert {len(r["ids"]) for r in back} == {128} and {len(r["position_ids"]) for r in back} == {256}
    assert sum(r["n_tokens"] for r in back) == sum(len(ids(t)) for t in TEXTS)
    wide = token_output.packed_rows(df, 64, pad_id=70_000).collect()  # two bytes don't hold the pad id: four for every row
    assert {len(r["ids"]) for r in wide} == {256}
    assert all((np.frombuffer(r["ids"], "<u4")[r["n_tokens"] :] == 70_000).all() for r in wide)
    odd = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string").coalesce(1)
    (row,) = token_output.packed_rows(odd, 64).collect()
    assert sorted(row["doc_ids"], key=str) == [1, 1, None] and row["cu_seqlens"][-1] == sum(len(ids(t)) for t in ("a b", "c", "c"))


def test_packing_of_repeated_rows_and_missing_ids(spark):
    rows = [(None, "one two")] * 50 + [(4, "one two")] * 50 + [(9, None)]
    got = packing.pack_along_curve(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 64).collect()
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 50 * len(ids("one two")) == sum(r["length"] for r in got if r["doc_id"] == 4)
    keys = packing.token_table(spark.createDataFrame(rows[:50], "doc_id long, text string"), tokenizer_path()).select("key").distinct().count()
    assert keys > 45  # copies are spread along the curve


def test_neighbours_in_content_land_together(spark):
    r = random.Random(2)
    topics = [[f"{a}{b}" for b in r.choices("abcdefghijklmnopqrst", k=12)] for a in ("ka", "lo", "mi", "nu")]
    docs = [(i, " ".join(r.choices(topics[i % 4], k=120)), i % 4) for i in range(400)]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string, topic int")
    topic = {i: t for i, _, t in docs}
    held = {}
    for p in packing.pack_along_curve(df).collect():
        held.setdefault(p["sequence_id"], []).extend([topic[p["doc_id"]]] * p["length"])
    same = [max(map(s.count, set(s))) / len(s) for s in held.values()]
    assert sum(same) / len(same) > 0.8  # a quarter if they were mixed


def test_ranges_hold_about_equal_tokens(spark):
    df = spark.createDataFrame([(i, "word " * (600 if i % 10 == 0 else 20) + str(i)) for i in range(6000)], "doc_id long, text string")
    tokens = packing.token_table(df, tokenizer_path()).select("key", "n").cache()
    mean = tokens.agg(F.avg("n")).first()[0]
    bounds = packing.quantile_bounds(tokens, "key", 10, F.greatest(F.lit(1), F.round(F.col("n") * 2 / mean)).cast("int"))
    sums = [r[1] for r in tokens.groupBy(packing.bucket_of(F.col("key"), bounds)).sum("n").collect()]
    assert len(sums) == 10 and max(sums) < 1.5 * sum(sums) / 10


def test_best_fit_decreasing_equals_plain_search():
    r = random.Random(5)
    lengths, cap = [r.randint(1, 100) for _ in range(600)], 100
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, x in enumerate(rooms) if x >= n]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(cap - n)
    bins = token_output.best_fit_decreasing(lengths, cap)
    assert sorted(i for b in bins for i in b) == list(range(600))
    assert sorted(cap - sum(lengths[i] for i in b) for b in bins) == sorted(rooms)


def loose(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def plain_fingerprints(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else loose(r[1]), r[1]))
    out = set()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        new = fp.edited(t, nxt)
        assert len(new) == len(t) - len(t) // 4 + min(len(nxt), len(t) // 4)
        a, b, c = fp.canonical(t), fp.canonical(new), fp.canonical(nxt)
        out.add((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fp.digest(a), fp.digest(b), float(a == b), float(a == c)))
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_fingerprints(spark, monkeypatch, parts):
    monkeypatch.setattr(fp, "parts_for", lambda *a, **b: parts)
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)]
    assert {tuple(r) for r in fp.fingerprints(frame(spark)).collect()} == plain_fingerprints(rows)
    assert fp.fingerprints(frame(spark).limit(0)).count() == 0
    assert {tuple(r) for r in fp.fingerprints(frame(spark, ["abcdefgh"])).collect()} == plain_fingerprints([(0, "abcdefgh")])


@pytest.mark.parametrize("parts", [1, 4])
def test_fingerprints_of_repeated_and_missing_ids(spark, monkeypatch, parts):
    monkeypatch.setattr(fp, "parts_for", lambda *a, **b: parts)
    rows = [(i % 4 if i % 3 else None, f"{t or ''}{i % 5}") for i, t in enumerate(TEXTS * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in fp.fingerprints(df).collect()]
    assert set(got) == plain_fingerprints(rows) and len(got) == len(rows)
    only = [(None, "b"), (None, "a"), (None, "b")]
    got = [tuple(r) for r in fp.fingerprints(spark.createDataFrame(only, "doc_id long, text string")).collect()]
    assert set(got) == plain_fingerprints(only) and len(got) == 3


def test_digest_clash_is_told_apart_by_bytes(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(6, "another"), (None, "another"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fp.fingerprints(df, hashed=lambda b: fp.digest(b"x"[: len(b) % 2])).collect()
    assert len(got) == len(rows)
    sha = {hashlib.sha256((t or "").encode()).hexdigest(): fp.canonical(t or "") for _, t in rows}
    edited = {r[2] for r in got}
    texts = {}
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else loose(r[1]), r[1]))
    for k, (i, t) in enumerate(ordered):
        new = fp.edited(t, ordered[(k + 1) % len(ordered)][1])
        texts[i, len(t), hashlib.sha256(new.encode()).hexdigest()] = fp.canonical(t), fp.canonical(new)
    named = [(r["fingerprint"], texts[r["doc_id"], r["n_chars"], r["edited_sha256"]][0]) for r in got]
    named += [(r["edited_fingerprint"], texts[r["doc_id"], r["n_chars"], r["edited_sha256"]][1]) for r in got]
    assert sha and edited and all((a == b) == (x == y) for a, x in named for b, y in named)


PIECES = ["bob", "@", "mail.ex-1.com", ".", " ", "1.2.3.4", "300.1.2.3", "5", "+", "(017) 555-7713", "-", "4532 0151 1283 0366", "4111-1111-1111-1111", "x", "+44 20 7946 0958", "0001.2.3.4.5", "a@b.c@d.e", "%", "\n", "é"]


def plain_pii(text):
    out = {k: [] for k in pii.BASE}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(9)
    for _ in range(4000):
        text = "".join(r.choices(PIECES, k=r.randint(0, 12)))
        found = pii.find_spans(text)
        assert {k: found[k] for k in pii.BASE} == plain_pii(text), text


def test_pii_frame_and_redaction(spark):
    text = 'mail bob@ex.com, token = "24be64439e3e49cf46b2d7c9", https://u:p1@host/x and +1 (017) 555-7713'
    f = pii.find_spans(text)
    assert pii.redacted(text, f) == 'mail <EMAIL>, token = "<ACCOUNT>", https://u:p1@host/x and <PHONE>'.replace("https://u:p1@host/x", "<URL>")
    df = frame(spark, [text, None, "clean text"])
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    assert got[3]["spans"] == got[6]["spans"] == "" and got[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[0]["n_email"], got[0]["n_phone"]) == (1, 1)
    assert {r["text"] for r in pii.redact(df).collect()} == {pii.redacted(text, f), None, "clean text"}
    assert pii.personal_data(df.limit(0)).count() == 0
    assert pii.find_spans("1" * 200000)["ip"] == [] and pii.find_spans("a" * 200000 + "@")["email"] == []


def test_many_spans_of_all_kinds_take_linear_time():
    import time

    text = "mail a@b.co and https://u:p@host/x token = a1b2c3d4 " * 20_000
    began = time.process_time()
    found = pii.find_spans(text)
    assert time.process_time() - began < 10 and len(found["email"]) == 20_000 and len(found["account"]) == 20_000
    taken = sorted(x for k in pii.BASE for x in found[k])
    mine = sorted(found["url"] + found["account"])
    assert all(not any(a < e and s < b for a, b in taken[max(0, i - 3) : i + 3]) for i, (s, e) in enumerate(mine[:100]))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "lang").join(language_id.predict_languages(docs), "doc_id").collect()
    tested = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in tested) / len(tested) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_segments_average_over_the_whole_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = language_id.train(docs)
    prose = {r["lang"]: r["t"] for r in docs.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("t")).collect()}
    text = prose["en"][:6000] + " " + prose["de"][:160000] + prose["de"][:9000]
    whole = m.scores([text, "x", text])
    a = language_id._bytes(text)
    step, parts = language_id.SEGMENT, []
    for lo in range(0, len(a), step):
        out = 0
        for n, (known, w) in enumerate(zip(m.known, m.weights), 1):
            codes = language_id._codes(a[lo : lo + step + n - 1])[n - 1][:step].tolist()
            c = set(codes) & set(known.tolist())
            out = out + w[np.searchsorted(known, sorted(c))].sum(0) / np.sqrt(max(1, len(c) + sum(x not in c for x in codes)))
        parts.append(out * min(step, len(a) - lo))
    assert np.allclose(whole[0], sum(parts) / len(a), atol=1e-4) and np.allclose(whole[0], whole[2])
    assert m.languages[int(whole[0].argmax())] == "de"


def test_language_edge_rows(spark):
    rows = [(1, None, "en", 0), (2, "12 + 3 ...", "en", 0), (3, "the and of", None, 0), (4, "the and of", "en", 1), (6, "der die und", "de", 1), (7, "½ ² ①", "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict_languages(df).collect()}
    assert got[1] == got[2] == got[7] == ("und", 0.0) and got[3][0] in ("en", "de", "und")
    assert language_id.predict_languages(df.limit(0)).count() == 0
    none = df.withColumn("lang", df.lang.substr(100, 1)).filter("false").union(df.selectExpr("doc_id", "text", "cast(null as string)", "score"))
    assert {r["lang_pred"] for r in language_id.predict_languages(none).collect()} == {"und"}


def plain_ridge(train, tests):
    """Kernel ridge regression by whole kernels: landmarks are all training texts, so the Nystroem span is the whole one."""
    codes = lambda t: [c.tolist() for c in language_id._codes(language_id._bytes(t))]
    known = [set().union(*(codes(t)[n] for t, _ in train)) for n in range(3)]
    # the n-grams of a text by order, and its size: unknown ones count as often as they occur
    sized = lambda t: [(set(c), len(set(c) & k) + sum(x not in k for x in c)) for c, k in zip(codes(t), known)]
    kernel = lambda a, b: sum(len(x & y) / (m * n) ** 0.5 for (x, m), (y, n) in zip(a, b)) / 3
    texts, langs = [sized(t) for t, _ in train], sorted({x for _, x in train})
    k = np.array([[kernel(a, b) for b in texts] for a in texts])
    n = len(train)
    w = np.array([n / (len(langs) * sum(y == x for _, y in train)) for _, x in train])
    y = np.array([[x == c for c in langs] for _, x in train], float)
    alpha = np.linalg.solve((k * w[:, None]).T @ k + language_id.RIDGE * n * (k + 1e-6 * np.eye(n)), (k * w[:, None]).T @ y)
    return np.array([[kernel(sized(t), b) for b in texts] for t in tests]) @ alpha


def test_model_equals_plain_kernel_ridge(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(90).collect() if r["lang"] and language_id.has_letter(r["text"])]
    rows = [(r["doc_id"], r["text"][:500], r["lang"]) for r in docs]
    model = language_id.train(spark.createDataFrame(rows[:60], "doc_id long, text string, lang string"))
    tests = [t[: language_id.SEGMENT - 60] for _, t, _ in rows[60:]]
    assert np.allclose(model.scores(tests), plain_ridge([(t, x) for _, t, x in rows[:60]], tests), atol=2e-3)


def test_many_languages_and_many_ngrams(spark):
    """200 languages, and more n-grams than 16 bits count: nothing is cut, and the driver holds matrices of the landmarks' size."""
    r = random.Random(1)
    rows = []
    for c in range(200):
        letters = [chr(0x4E00 + 40 * c + i) for i in range(40)]
        rows += [(1000 * c + i, "".join(r.choices(letters, k=60)), f"x{c:03}") for i in range(8)]
    model = language_id.train(spark.createDataFrame(rows[:], "doc_id long, text string, lang string").repartition(4))
    assert len(model.languages) == 200 and len(model.known[2]) > 20_000
    tests = [("".join(r.choices([chr(0x4E00 + 40 * c + i) for i in range(40)], k=60)), f"x{c:03}") for c in range(0, 200, 3)]
    got = [model.languages[i] for i in model.scores([t for t, _ in tests]).argmax(1)]
    assert sum(g == c for g, (_, c) in zip(got, tests)) / len(tests) > 0.95


def test_language_sample_stays_bounded_when_a_doc_id_repeats(spark):
    rows = [(7, f"wort nummer {i % 3}", "de") for i in range(3000)] + [(100 + i, f"word number {i}", "en") for i in range(50)] + [(7, "word", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    got = language_id._sample(df, 20).collect()
    assert sorted((r["lang"], r["doc_id"]) for r in got if r["lang"] == "de") == [("de", 7)]
    assert [r["text"] for r in got if r["lang"] == "de"] == ["wort nummer 0"]
    english = sorted(df.filter("lang = 'en'").select("h", "doc_id").distinct().collect())[:20]
    assert {r["doc_id"] for r in got if r["lang"] == "en"} == {r["doc_id"] for r in english}
