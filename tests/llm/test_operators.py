"""The training-data operators against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shapeflow.llm import chat_format, decontamination, language_id, lm_scoring, minhash_dedup, mixing, quality_classifier, quality_rules, substring_dedup, suffix_dedup
from shapeflow.llm import textops as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "to", "va", "zu") for b in ("b", "d", "g", "l", "m", "n", "r", "s", "t", "x")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def split(t):
    return (t or "").encode().split()


def low(t):
    return (t or "").encode().lower().split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(3, 160)) for _ in range(30)]
    shared, line = prose(rng, 70), "a line that many texts have in common, word for word"
    out = dict(enumerate(base))
    out[40] = base[0]
    out[41] = base[0]
    edited = base[1].split()
    out[42] = " ".join(edited[:-1] + ["other"]) if len(edited) > 1 else base[1]
    for i in (50, 51, 52):
        out[i] = f"{prose(rng, 30)} {shared}\n{line}\n{prose(rng, 20)}"
    out[53] = out[50].upper()
    out |= {60: None, 61: "", 62: " \t\n", 63: "one", 64: "one two", 65: "é\xa0ü 日本 語", 66: "is " * 300, 67: "### $$$ &&& *** " * 20, 68: prose(rng, 9000), 69: "!" * 5000}
    for i in range(70, 90):  # near copies of one text, with more and more changes
        w = base[5].split() * 2 + base[6].split()
        for k in range(i - 70):
            w[(7 * k + i) % len(w)] = f"chg{i}"
        out[i] = " ".join(w)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "xx", f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, equal ids, and columns named like the operators' own."""
    rng = random.Random(9)
    long = prose(rng, 80)
    rows = [(1, long, "a", "s", 1), (1, long, "a", "s", 1), (1, prose(rng, 60), None, None, None), (None, long, None, None, None), (None, None, None, None, None), (2, long + " tail", "b", "s", 2), (3, None, "b", "s", 0), (4, "", None, "t", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    for c in ("score", "row", "size", "rep", "cluster", "mark", "h", "sig", "words", "grams", "source_size", "target", "component_id", "held_out", "lang_pred", "kept", "spans", "id", "place", "label"):
        d = d.withColumn(c, F.lit("clash"))
    return d


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- text helpers ---------------------------------------------------------------------------


def test_words_and_hashes(texts):
    import pyarrow as pa

    col = pa.array(list(texts.values()), pa.string())
    data, offs = T.text_bytes(col)
    h, row, s, e = T.word_hashes(data, offs)
    want = [(i, w) for i, t in enumerate(texts.values()) for w in low(t)]
    got = [(int(r), data[a:b].tobytes().lower()) for r, a, b in zip(row, s, e, strict=True)]
    assert got == want
    assert len(set(h.tolist())) == len({w for _, w in want})
    part = T.text_bytes(col.slice(5, 3))
    assert bytes(part[0]) == b"".join((t or "").encode() for t in list(texts.values())[5:8])


# ---- 1 mixing -------------------------------------------------------------------------------


def water(sizes, weights=(1, 2, 3), most=3):
    names = sorted((n for n in sizes if n is not None), key=lambda n: [ord(c) for c in n]) + [None] * (None in sizes)
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[n] for n in stopped)
        free = sum(w[n] for n in names if n not in stopped)
        t = {n: most * sizes[n] if n in stopped else left * w[n] / free for n in names}
        over = {n for n in names if n not in stopped and t[n] > most * sizes[n] + 1e-9}
        if not over:
            return t
        stopped |= over


def test_mixing(spark, docs, texts):
    got = mixing.mix(docs, block=4).collect()
    again = mixing.mix(docs.repartition(5), block=4).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(split(r["text"]))
    want = water(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r["size"] == len(split(texts[r["doc_id"]])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)


def test_mixing_many(spark):
    rng = random.Random(0)
    rows = [(i, "w " * rng.randint(1, 40), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=8)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r["t"] - r["g"]) <= 40


def test_mixing_edges(spark, odd):
    assert mixing.mix(empty(spark)).count() == 0
    got = mixing.mix(odd)
    assert got.count() == odd.count() and got.where("size = 0 and taken > 0").count() == 0
    assert got.where("doc_id = 1 and source = 's'").select("taken").distinct().count() == 1


# ---- 2 language model -----------------------------------------------------------------------


def _lm(docs):
    d = docs.select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "text")
    train = d.where("not held_out")
    counts = lm_scoring.count_tokens(train)
    return lm_scoring.score(d, counts, lm_scoring.fit(train, counts))


def test_lm_base(spark, docs, texts):
    c = collections.Counter(w for i, t in texts.items() if i % 5 for w in [*low(t), None])
    n, v = sum(c.values()), len(c)
    for r in _lm(docs).collect():
        toks = [*low(texts[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(toks), sum(c[w] > 0 for w in toks), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks))
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_lm_rare_tokens_are_joined(spark, docs, monkeypatch):
    want = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in _lm(docs).collect()}
    monkeypatch.setattr(lm_scoring, "KNOWN", 20)
    for r in _lm(docs).collect():
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][0]) and r["n_known"] == want[r["doc_id"]][1]


def test_lm_learns_context(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):  # two languages: a text's words come from one half of the vocabulary
        half = WORDS[:50] if i % 2 else WORDS[50:]
        rows.append((i, " ".join(rng.choice(half) for _ in range(120))))
    got = _lm(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out")
    r = got.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert r[0] / r[2] > r[1] / r[2] + 0.1


def test_lm_model_is_a_distribution(spark, docs):
    train = docs.select("text")
    m = lm_scoring.fit(train, lm_scoring.count_tokens(train))
    f = np.array([[3], [5], [7]])
    z = m.logits(f)
    p = np.exp(z - z.max())
    assert (p / p.sum()).sum() == pytest.approx(1, abs=1e-5) and z.shape == (1, 2 * lm_scoring.CLASSES)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_lm_trains_on_every_position(spark, docs, texts, monkeypatch, rounds):
    calls, descend = [], lm_scoring._descend
    monkeypatch.setattr(lm_scoring, "_descend", lambda *args: calls.append(args) or descend(*args))
    train = docs.select("text")
    lm_scoring.fit(train, lm_scoring.count_tokens(train), rounds=rounds)
    batch = train.toArrow().combine_chunks().to_batches()[0]
    used = sum(sum(n for t, n in zip(b["table"].to_pylist(), b["n"].to_pylist(), strict=True) if t == 0) for args in calls for b in descend(*args)(iter([batch])))
    assert used == 3 * sum(len(low(t)) + 1 for t in texts.values())  # three features a position


def test_lm_open_table():
    keys = np.unique(np.random.default_rng(0).integers(1, 2**63, 500, dtype=np.uint64))
    t = lm_scoring.open_table(keys)
    assert (lm_scoring.find(t, keys, keys) == np.arange(len(keys))).all()
    assert (lm_scoring.find(t, keys, keys + np.uint64(1)) == np.where(np.isin(keys + np.uint64(1), keys), 0, -1)).all()
    assert (lm_scoring.find(lm_scoring.open_table(keys[:0]), keys[:0], keys) == -1).all()


def test_lm_edges(spark, odd):
    assert _lm(empty(spark)).count() == 0
    got = _lm(odd)
    assert got.count() == odd.count()
    same = [r["base_score"] for r in got.where("doc_id = 1").collect()]
    assert len(same) == 3 and sorted(collections.Counter(same).values()) == [1, 2]
    none = _lm(odd.where("doc_id is null").withColumn("doc_id", F.lit(5).cast("long"))).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == r["base_score"] for r in none)


# ---- 3 language identification --------------------------------------------------------------


def _langs(spark, n=160):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        lang = "abc"[i % 3]
        own = {"a": WORDS[:40], "b": WORDS[30:70], "c": WORDS[60:]}[lang]
        rows.append((i, " ".join(rng.choice(own) for _ in range(30)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.col("doc_id") % 5 == 0)


def test_language_id(spark):
    d = _langs(spark)
    f = language_id.learn(d.where("not held_out"))
    got = language_id.predict(d.where("held_out"), f, ["doc_id", "lang"])
    assert got.where("lang = lang_pred").count() >= 0.9 * got.count() and got.where("score between 0 and 1").count() == got.count()


def test_language_filters_hold_what_was_put_in(spark):
    d = _langs(spark, 30)
    f = language_id.learn(d, least_ratio=0, most_slots=1 << 16)
    import pyarrow as pa

    for i, lang in enumerate(f.langs):
        g, _ = language_id._grams(pa.array([r["text"] for r in d.where(F.col("lang") == lang).collect()]))
        assert ((f.masks(np.unique(g))[:, i // 8] >> (i % 8)) & 1).all()


def test_language_of_rare_ngrams(spark):
    """A language whose n-grams all occur once is found again."""
    rng = random.Random(5)
    a, b = prose(rng, 40), " ".join("".join(rng.choice("xyzqw") for _ in range(6)) for _ in range(20))
    d = spark.createDataFrame([(i, a, "aa") for i in range(20)] + [(99, b, "bb")], "doc_id long, text string, lang string")
    got = {r["lang"]: r for r in language_id.predict(d, language_id.learn(d), ["lang"]).collect()}
    assert got["bb"]["lang_pred"] == "bb" and got["aa"]["lang_pred"] == "aa" and got["bb"]["score"] > 0.9


def test_language_against_brute_force(spark):
    """Shares of n-grams that a language has, from sets instead of filters."""
    import pyarrow as pa

    d = _langs(spark, 60)
    train, rows = d.where("not held_out").collect(), d.where("held_out").collect()
    grams = lambda t: language_id._grams(pa.array([t]))[0].tolist()
    count = {x: collections.Counter(g for r in train if r["lang"] == x for g in grams(r["text"])) for x in "abc"}
    total = {x: sum(count[x].values()) for x in "abc"}
    has = lambda g, x: count[x][g] and count[x][g] / total[x] >= language_id.LEAST_RATIO * max(count[y][g] / total[y] for y in "abc")
    got = {r["doc_id"]: r for r in language_id.predict(d.where("held_out"), language_id.learn(d.where("not held_out")), ["doc_id"]).collect()}
    for r in rows:
        g = grams(r["text"])
        share = {x: sum(bool(has(y, x)) for y in g) / len(g) for x in "abc"}
        best = max(share.values())
        assert share[got[r["doc_id"]]["lang_pred"]] >= best - 0.02
        assert got[r["doc_id"]]["score"] == pytest.approx(best / sum(share.values()), abs=0.05)


def test_language_edges(spark, odd):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "x"), (None, "mi")], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("_text", F.lit("q"))
    f = language_id.learn(_langs(spark, 30))
    got = {r["doc_id"]: r for r in language_id.predict(d.select("doc_id", "text", "score"), f, ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0 and got[4]["lang_pred"] in "abc"
    nothing = language_id.learn(empty(spark))
    assert language_id.predict(d, nothing, ["doc_id"]).where("lang_pred = 'und' and score = 0").count() == 5
    assert language_id.predict(empty(spark), f, ["doc_id"]).count() == 0
    assert language_id.predict(odd, language_id.learn(odd), ["doc_id"]).count() == odd.count()


# ---- 4 quality classifier -------------------------------------------------------------------


def _quality(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 40) if i % 2 else rng.choice(["$$ ## " * 20, (rng.choice(WORDS) + " ") * 40]), i % 2) for i in range(240)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_quality_classifier(spark):
    d = _quality(spark)
    m = quality_classifier.train(d.where("doc_id % 3 <> 0"), epochs=4)
    again = quality_classifier.train(d.where("doc_id % 3 <> 0").repartition(7), epochs=4)
    assert np.array_equal(m[0], again[0]) and m[1] == again[1]
    got = quality_classifier.score(d.where("doc_id % 3 = 0"), m, ["doc_id", "label"])
    assert got.where("(score >= 0.5) = (label = 1)").count() >= 0.95 * got.count()


def test_quality_sample_is_bounded(spark):
    d = _quality(spark)
    a, b = quality_classifier.train(d, sample_rows=50, epochs=1), quality_classifier.train(d.limit(0), epochs=1)
    assert np.isfinite(a[0]).all() and not b[0].any() and b[1] == 0


def test_quality_edges(spark, odd):
    flat = (np.zeros(quality_classifier.BUCKETS, np.float32), 0.0)
    assert quality_classifier.score(empty(spark), flat, ["doc_id"]).count() == 0
    assert quality_classifier.score(odd, flat, ["doc_id"]).where("score = 0.5").count() == odd.count()
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 0), (2, None, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    known = quality_classifier.labelled_rows(odd, labels)
    m = quality_classifier.train(known, epochs=1)
    assert quality_classifier.score(odd, m, ["doc_id"]).where("score between 0 and 1").count() == odd.count()


# ---- 5 suffix arrays ------------------------------------------------------------------------


def brute_removed(texts):
    first, out = {}, {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), int)
        for j in range(len(raw) - 49):
            if first.setdefault(raw[j : j + 50], i) < i:
                gone[j : j + 50] = 1
        kept = bytes(np.frombuffer(raw, np.uint8)[gone == 0])
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_order():
    rng = np.random.default_rng(0)
    for _ in range(150):
        s = rng.integers(1, rng.integers(2, 5), rng.integers(0, 70))
        for depth in (1, 3, 4, 10, 50):
            o = suffix_dedup.suffix_order(s, depth)
            pre = [tuple(s[i : i + depth]) for i in o]
            assert sorted(o) == list(range(len(s))) and pre == sorted(pre)


def _bytes_result(docs):
    cols = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return suffix_dedup.repeated_bytes(docs).mapInArrow(suffix_dedup._digest, cols)


def test_suffix_dedup(spark, docs, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in _bytes_result(docs).collect()}
    assert got == brute_removed(texts)


def test_suffix_dedup_variants_around_one_gram(spark):
    rng = random.Random(8)
    core = "the very same run of forty-odd characters here"
    t = {i: prose(rng, 5)[: i % 9] + core[i % 5 :] + prose(random.Random(i % 4), 6) for i in range(60)}
    t |= {100 + i: "ab" * (30 + i) for i in range(5)}
    d = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in _bytes_result(d).collect()} == brute_removed(t)


def test_suffix_edges(spark, odd):
    assert _bytes_result(empty(spark)).count() == 0
    rows = _bytes_result(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] in (None, 1))
    assert next(r for r in rows if r["doc_id"] == 2)["n_removed"] >= 50


# ---- 6 MinHash ------------------------------------------------------------------------------


def brute_components(texts, k, percent):
    sets = {i: {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if (w := low(t)) else set() for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a2, b2 = find(a), find(b)
                up[max(a2, b2)] = min(a2, b2)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_minhash(spark, docs, texts, k, percent):
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash_dedup.near_duplicates(docs, k=k, percent=percent).collect()}
    assert got == brute_components(texts, k, percent)


def test_minhash_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    rng, base = random.Random(1), prose(random.Random(0), 120).split()
    t = {}
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        t[i] = " ".join(w)
    d = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash_dedup.near_duplicates(d, k=3, percent=85).collect()}
    assert got == brute_components(t, 3, 85)


def test_banding():
    """The bands follow from the threshold; links far below the usual one are found too."""
    assert minhash_dedup.banding(0.85, 1e-4) == (20, 5)
    for t in (0.3, 0.5, 0.8, 0.95):
        bands, rows = minhash_dedup.banding(t, 1e-4)
        assert bands * rows <= minhash_dedup.HASHES and (1 - t**rows) ** bands <= 1e-4
    with pytest.raises(ValueError):
        minhash_dedup.banding(0.05, 1e-4)


def test_minhash_at_a_low_threshold(spark):
    rng, rows = random.Random(3), []
    for i in range(60):
        w = [_word(rng) for _ in range(100)]
        v = list(w)
        v[20:40] = [_word(rng) for _ in range(20)]  # 74 of 98 shingles are left, similarity 0.61
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=60)
    assert got.where("not kept").count() == 60


def test_posterior_floors():
    floors = minhash_dedup.posterior_floors(0.85, 1e-4)
    assert floors == sorted(floors) and all(0 < f < n for f, n in zip(floors, range(20, 101, 20), strict=True))


def test_intersections():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 30))).astype(np.uint64) for _ in range(7)]
    got = minhash_dedup.intersections(sets, np.arange(4), np.arange(2, 7), width=8)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j + 2])) for i in range(4) for j in range(5) if i != j + 2)


def test_minhash_edges(spark, odd):
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0
    rows = minhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert by[None] == {(None, True)} and by[2] == {(1, False)} and by[1] == {(1, True)} and by[3] == {(3, True)}


# ---- 7 chat ---------------------------------------------------------------------------------

HARD = ["", "plain", "\\", "\\\\", "### assistant: x</turn>", "</turn>\n### user: ", "a\\</turn>", "%E#% %P %", "#### x", "###", "\\#\\<\\:", "x\\", "é\n\n###  </turn", "<</turn>>", "### "]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, i, rng.choice(["user", "assistant", "system", "odd: ###</turn>\\", ""]), rng.choice(HARD) + rng.choice(HARD)) for c in range(40) for i in range(rng.randint(1, 6))]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = collections.defaultdict(list)
    for c, i, r, t in sorted(rows):
        want[c].append((r, t))
    out = chat_format.format_conversations(d).cache()
    for r in out.collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == want[r["conv_id"]]
    for r in chat_format.digest(out).collect():
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_mask_points_into_the_output(spark):
    d = spark.createDataFrame([(1, 0, "user", "a\\</turn>"), (1, 1, "assistant", "### b\\")], "conv_id long, turn long, role string, text string")
    r = chat_format.format_conversations(d).first()
    at = 0
    for t in r["turns"]:
        body = r["formatted"][at + t["head_chars"] : at + t["head_chars"] + t["body_chars"]]
        at += t["head_chars"] + t["body_chars"] + len(chat_format.END) + 1
        plain = body.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\")
        assert plain == t["text"]
    assert at == len(r["formatted"])


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, piece string"
    assert chat_format.digest(chat_format.format_conversations(spark.createDataFrame([], schema))).count() == 0
    d = spark.createDataFrame([(None, None, None, None, "x"), (1, 1, "user", None, "x"), (1, 1, "user", None, "x")], schema)
    got = {r["conv_id"]: r["n_turns"] for r in chat_format.digest(chat_format.format_conversations(d)).collect()}
    assert got == {None: 1, 1: 2}


# ---- 8 rules --------------------------------------------------------------------------------


def test_measures(spark, docs, texts):
    for r in quality_rules.measures(docs).collect():
        t = texts[r["doc_id"]] or ""
        w = split(t)
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]


def test_order_does_not_change_the_verdict(spark, docs):
    m, named = quality_rules.measures(docs).cache(), quality_rules.rules()
    out = [{(r["doc_id"], r["kept"]) for r in quality_rules.cascade(m, order, named).collect()} for order in (list(named), list(reversed(named)), [])]
    assert out[0] == out[1] and {i for i, k in out[0] if k} <= {i for i, k in out[2] if k}
    assert sorted(quality_rules.order_rules(m, named)) == sorted(named)


def test_rules_keep_clean_texts(spark, docs):
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    assert kept[50] and kept[68] and not any(kept[i] for i in (60, 61, 62, 63, 66, 67, 69))


def test_rules_edges(spark, odd):
    assert quality_rules.quality_rules(empty(spark)).count() == 0
    assert quality_rules.quality_rules(odd).where("kept is not null").count() == odd.count()


# ---- 9 decontamination ----------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, n)) for i, n in enumerate((12, 20, 30, 3, 1))] + [(9, None), (10, " !! ")]
    body = lambda n: prose(rng, n)
    near = items[2][1].split()
    near[0] = "changed"
    rows = [
        (1, f"{body(20)} {items[0][1]} {body(20)}"), (2, items[1][1].upper().replace(" ", ", ")), (3, f"{body(9)} {' '.join(near)} {body(9)}"), (4, body(60)),
        (5, f"{items[0][1]} {items[1][1]}"), (6, " ".join(items[2][1].split()[:14])), (7, None), (8, ""),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("words", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.find_items(d, b).collect()}
    assert {(i, k) for i, k in got if k < 3} == {(1, 0), (2, 1), (3, 2), (5, 0), (5, 1)}
    assert got[1, 0] == 1 and got[2, 1] == 1 and 0.8 <= got[3, 2] < 1
    short = items[3][1].split()
    assert {i for i, k in got if k == 3} == {i for i, t in rows if t and any(t.lower().replace(",", "").split()[j : j + 3] == short for j in range(len(t.split())))}


def test_simhash_blocks():
    """Any two fingerprints within the radius agree in a block but for a few bits."""
    rng = random.Random(0)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), decontamination.RADIUS):
            y ^= 1 << b
        n, mask = decontamination.BITS, (1 << decontamination.BITS) - 1
        assert any((((x ^ y) >> n * k) & mask).bit_count() <= decontamination.SLACK for k in range(64 // n))


def test_decontamination_of_reordered_items(spark):
    """The halves of an item the other way round, under all positions of the windows."""
    rng = random.Random(8)
    x, y = prose(rng, 24), prose(rng, 24)
    d = spark.createDataFrame([(1, f"{prose(rng, 30)} {y} {x} {prose(rng, 30)}"), (2, f"{prose(rng, 60)} {x}")], "doc_id long, text string")
    b = spark.createDataFrame([(1, f"{x} {y}")], "item_id long, text string")
    got = [tuple(r) for r in decontamination.find_items(d, b).collect()]
    assert got == [(1, 1, pytest.approx(40 / 48), 30, 48)]


def test_decontamination_loses_no_pair(spark):
    """Every pair of similarity 0.8 or more is found, whatever the distance of its fingerprints."""
    rng = random.Random(9)
    items = [(i, prose(rng, 59).split()) for i in range(300)]
    docs = [(i, [f"new{i}" if n == 55 else v for n, v in enumerate(w)]) for i, w in items]
    docs = [(i, w[:1] + [f"new{i}"] + w[2:]) for i, w in docs]  # 49 of 55 shingles are left, similarity 0.803
    table = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{key} long, text string")
    sets = lambda w: {tuple(w[n : n + 5]) for n in range(len(w) - 4)}
    own = dict(items)
    want = {(i, i) for i, w in docs if len(sets(w) & sets(own[i])) >= 0.8 * len(sets(w) | sets(own[i]))}
    assert len(want) > 200 and want == {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(table(docs, "doc_id"), table(items, "item_id")).collect()}


def test_decontamination_edges(spark, odd):
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.find_items(empty(spark), b).count() == 0
    assert decontamination.find_items(odd, b.limit(0)).count() == 0
    item = spark.createDataFrame([(1, odd.where("doc_id = 2").first()["text"]), (2, odd.where("doc_id = 2").first()["text"])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(odd, item).collect()}
    assert got == {(i, k) for i in (1, 2, None) for k in (1, 2)}


# ---- 10 passages ----------------------------------------------------------------------------


def test_passages(spark, docs, texts):
    got = collections.defaultdict(set)
    for r in substring_dedup.near_passages(docs).collect():
        assert r["ref_doc_id"] < r["doc_id"] and r["similarity"] >= 0.8 and r["n_words"] >= 50
        got[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
    seen, want = {}, collections.defaultdict(set)
    for i in sorted(texts):
        w = low(texts[i])
        for j in range(len(w) - 49):
            if seen.setdefault(tuple(w[j : j + 50]), i) < i:
                want[i] |= set(range(j, j + 50))
    assert all(want[i] <= got[i] for i in want)
    assert not set(got) & {68, 63, 60} and 51 in got and 53 in got


def test_near_passage(spark):
    rng = random.Random(11)
    p = prose(rng, 90).split()
    q = list(p)
    q[45] = "edited"
    d = spark.createDataFrame([(1, " ".join([prose(rng, 40), *p, prose(rng, 40)])), (2, " ".join([prose(rng, 25), *q, prose(rng, 25)])), (3, prose(rng, 300))], "doc_id long, text string")
    rows = substring_dedup.near_passages(d).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in rows} == {(2, 1)}
    assert any(r["n_words"] >= 80 and 0.8 <= r["similarity"] < 1 for r in rows)


def test_later_version_of_a_boilerplate(spark):
    """Two documents that share an edited version meet, though many earlier ones have the first version."""
    rng, rows, want = random.Random(21), [], set()
    for n in range(12):
        a = prose(rng, 50).split()
        b = [f"new{n}{i}" if i in (22, 26) else w for i, w in enumerate(a)]
        of = lambda p: " ".join([prose(rng, 20), *p, prose(rng, 20)])
        rows += [(1000 * n + i, of(a)) for i in range(21)] + [(1000 * n + i, of(b)) for i in (500, 900)]
        want.add((1000 * n + 900, 1000 * n + 500))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert want <= {(r["doc_id"], r["ref_doc_id"]) for r in substring_dedup.near_passages(d).collect()}


def test_passage_copies(spark):
    """Copies of a text are reported against its first one; every later text of a shared passage is found, against earlier ones."""
    rng = random.Random(22)
    p, whole = prose(rng, 60), prose(rng, 80)
    rows = [(i, f"{prose(rng, 20)} {p} {prose(rng, 20)}") for i in range(10)] + [(20 + i, whole) for i in range(4)]
    got = {(r["doc_id"], r["ref_doc_id"]) for r in substring_dedup.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, 0) for i in range(1, 10)} | {(20 + i, 20) for i in (1, 2, 3)} <= got
    assert all(k < i and (i < 20) == (k < 20) for i, k in got)


def _recall(spark, docs):
    """Found documents and words, of those that verifying every pair of texts finds."""
    import pyarrow as pa

    g, bounds, *_ = substring_dedup._shingled(pa.array(docs))
    want = collections.defaultdict(set)
    for x in range(len(docs)):
        for y in range(x):
            for i, j, *_ in substring_dedup.passages(g[bounds[x] : bounds[x + 1]], g[bounds[y] : bounds[y + 1]], 46, 0.8):
                want[x] |= set(range(i, j + substring_dedup.K))
    got = collections.defaultdict(set)
    for r in substring_dedup.near_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect():
        got[r["doc_id"]] |= set(range(r["start_word"], r["start_word"] + r["n_words"]))
    assert set(got) <= set(want)
    return len(set(got)) / len(want), sum(len(want[i] & got[i]) for i in want) / sum(map(len, want.values()))


def _word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(6))


@pytest.mark.parametrize("pool", (40, 150))
def test_passages_among_common_phrases(spark, pool):
    """Texts made of the same phrases, with 60-word repeats planted: shingles that many texts have hide none."""
    rng = random.Random(pool)
    phrases = [[_word(rng) for _ in range(12)] for _ in range(pool)]
    docs = [[w for _ in range(rng.randint(10, 20)) for w in rng.choice(phrases)] for _ in range(120)]
    for _ in range(20):
        a, b = rng.sample(range(len(docs)), 2)
        at, to = rng.randrange(len(docs[a]) - 60), rng.randrange(len(docs[b]))
        docs[b][to:to] = docs[a][at : at + 60]
    found, words = _recall(spark, [" ".join(d) for d in docs])
    assert found >= 0.99 and words >= 0.99


@pytest.mark.parametrize("rate", (0.01, 0.02))
def test_edited_passages(spark, rate):
    """Families of passages with words replaced, similarity 0.8 to 0.95 to one another, each in a text of its own."""
    rng, docs = random.Random(7), []
    for _ in range(16):
        p = [_word(rng) for _ in range(rng.randint(50, 90))]
        for _ in range(8):
            q = [_word(rng) if rng.random() < rate else w for w in p]
            docs.append(" ".join([*[_word(rng) for _ in range(40)], *q, *[_word(rng) for _ in range(40)]]))
    rng.shuffle(docs)
    found, words = _recall(spark, docs)
    assert found >= 0.95 and words >= 0.9


def test_joint_signatures():
    """Against all pairs of windows."""
    import pyarrow as pa

    from shapeflow.llm import textops as T

    rng = random.Random(4)
    g, bounds, *_ = substring_dedup._shingled(pa.array([prose(rng, 90), prose(rng, 120), "a b c d e " * 40]))
    w = substring_dedup.compact_windows(g, bounds, 20)
    w["doc"] = w.pop("row")
    got = {(int(k), int(d)) for keys, docs in substring_dedup.joint_signatures(w, 20) for k, d in zip(keys, docs, strict=True)}
    want, n = set(), len(w["key"])
    for x in range(n):
        for y in range(n):
            if w["f"][x] < w["f"][y] and w["doc"][x] == w["doc"][y]:
                a, b = max(w["left"][x], w["left"][y]), min(w["right"][x], w["right"][y])
                if b - a + 1 >= 20 and all(w["first"][z] <= b and w["last"][z] >= a for z in (x, y)):
                    want.add((int(T.mix64(w["key"][x : x + 1] + T.mix64(w["key"][y : y + 1]))[0]), int(w["doc"][x])))
    assert got <= want and len(got) >= 0.9 * len(want) > 0


def _brute_cover(a, b, width, threshold):
    """Places of ``a`` between the first and last shared one of any two near-duplicate stretches, by trying all pairs."""
    spans = lambda x: [(i, j, set(x[i:j].tolist())) for i in range(len(x)) for j in range(i + width, len(x) + 1)]
    out, other = set(), spans(b)
    for i, j, x in spans(a):
        for _, _, y in other:
            if len(x & y) >= threshold * len(x | y) - 1e-12:
                both = [n for n in range(i, j) if int(a[n]) in y]
                out |= set(range(both[0], both[-1] + 1))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_passages_against_brute_force(seed):
    rng = random.Random(seed)
    new = iter(range(1000, 9999))
    p = list(range(16))
    edited = [next(new) if rng.random() < 0.08 else w for w in p]
    loose = list(range(100, 110))
    a = [*p, *loose, *[next(new) for _ in range(3)]]
    b = [*(p[:6] if seed % 2 else []), *[next(new) for _ in range(3)], *edited, *[next(new) if rng.random() < 0.4 else w for w in loose]]
    a, b = np.array(a, np.uint64), np.array(b, np.uint64)
    want = _brute_cover(a, b, 8, 0.8)
    found = substring_dedup.passages(a, b, 8, 0.8)
    assert want <= {x for i, j, *_ in found for x in range(i, j + 1)}
    for i, j, k, m, s in found:
        x, y = set(a[i : j + 1].tolist()), set(b[k : m + 1].tolist())
        assert j - i >= 7 and m - k >= 7 and s == pytest.approx(len(x & y) / len(x | y)) and s >= 0.8


def test_compact_windows():
    rng = np.random.default_rng(3)
    from shapeflow.llm.windows import cartesian_spans, window_minima

    v = rng.integers(0, 2**63, 60, dtype=np.uint64) >> np.uint64(24) << np.uint64(24)
    bounds = np.array([0, 25, 25, 60])
    at, first, last = window_minima(v, bounds, 6)
    got = {int(s): int(a) for a, x, y in zip(at, first, last, strict=True) for s in range(x, y + 1)}
    want = {s: s + int(np.argmin(v[s : s + 6])) for lo, hi in ((0, 25), (25, 60)) for s in range(lo, hi - 5)}
    assert got == want
    left, right = cartesian_spans(v, bounds, at)
    for a, x, y in zip(at, left, right, strict=True):
        lo, hi = (0, 25) if a < 25 else (25, 60)
        assert v[x : y + 1].min() == v[a] and (x == lo or v[x - 1] < v[a]) and (y == hi - 1 or v[y + 1] < v[a])


def test_cut_words_beside_any_column(spark):
    rng = random.Random(2)
    p = prose(rng, 60)
    d = spark.createDataFrame([(1, f"x {p} y", 5, 6, 7), (2, f"u {p} v", 5, 6, 7)], "doc_id long, text string, _id int, _mark int, _spans int")
    out = substring_dedup.cut_words(d, substring_dedup.near_passages(d))
    assert out.columns == d.columns and {tuple(r)[1:] for r in out.where("doc_id = 2").collect()} == {("u v", 5, 6, 7)}


def test_cut_words(spark, docs, texts):
    spans = substring_dedup.near_passages(docs)
    out = {r["doc_id"]: r["text"] for r in substring_dedup.cut_words(docs, spans).collect()}
    assert out[68] == texts[68] and out[60] is None and len(low(out[51])) < len(low(texts[51])) - 50


def test_passage_edges(spark, odd):
    assert substring_dedup.near_passages(empty(spark)).count() == 0
    spans = substring_dedup.near_passages(odd)
    assert {r["doc_id"] for r in spans.collect()} == {2}
    cut = substring_dedup.cut_words(odd, spans)
    assert cut.count() == odd.count() and cut.columns == odd.columns


def test_held_out_rule(spark):
    from shapeflow.llm.runtime import remainder

    for r in spark.range(50).select("id", remainder(F.col("id"), 7).alias("m")).collect():
        assert r["m"] == zlib.crc32(str(r["id"]).encode()) % 7


def test_saved_tables_go(spark, tmp_path, monkeypatch):
    """Tables written on the way are deleted on release, which the end of the session calls."""
    from shapeflow.llm import runtime

    monkeypatch.setattr(runtime, "shared_dir", lambda spark: f"file://{tmp_path}")
    df = runtime.save(spark.range(5), "five")
    assert df.count() == 5 and len([p for p in tmp_path.iterdir() if p.name.startswith("five")]) == 1
    runtime.release()
    assert not list(tmp_path.iterdir())


def test_rules_then_a_filter(spark):
    """A filter on the verdict stays above the measures."""
    rng = random.Random(1)
    d = spark.createDataFrame([(i, prose(rng, 60)) for i in range(30)] + [(99, "a b")], "doc_id long, text string")
    out = quality_rules.quality_rules(d).where("kept")
    assert out.count() == 30
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("monotonically_increasing_id")


def test_very_long_texts(spark):
    rng = random.Random(6)
    text, item = prose(rng, 60_000), prose(rng, 25)
    d = spark.createDataFrame([(1, text, "aa"), (2, f"{prose(rng, 30)} {item}", "bb"), (3, f"{text} {item}", "aa")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(d, language_id.learn(d), ["doc_id"]).collect()}[1] == "aa"
    model = quality_classifier.train(d.select("doc_id", "text", F.expr("cast(doc_id = 2 as int) as label")))
    assert quality_classifier.score(d, model, ["doc_id"]).where("score between 0 and 1").count() == 3
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r["doc_id"], r["start_word"]) for r in decontamination.find_items(d, b).collect()} == {(2, 30), (3, 60_000)}
    c = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text + "</turn>")], "conv_id long, turn long, role string, text string")
    r = chat_format.digest(chat_format.format_conversations(c)).first()
    assert r["n_turns"] == 2 and r["loss_chars"] == len(text) + 7


def test_model_is_a_distribution(spark):
    """Class factors, word factors and the smoothed tails, each summed over all tokens there are."""
    rng = random.Random(12)
    d = spark.createDataFrame([(i, prose(rng, 80)) for i in range(30)], "doc_id long, text string")
    counts = lm_scoring.count_tokens(d)
    m = lm_scoring.fit(d, counts)
    f = np.arange(9, dtype=np.int64).reshape(3, 3)
    e, total, _ = lm_scoring.softmax(m.logits(f))
    assert np.allclose((e / total[:, None]).sum(1), 1, atol=1e-5)
    for y in (0, 5):
        e, total, _ = lm_scoring.softmax(m.logits(f, np.full(3, y)))
        assert np.allclose((e / total[:, None]).sum(1), 1, atol=1e-5)
    own = set(m.known[m.known_id >= 0].view(np.int64).tolist())
    tail = collections.Counter()
    for r in counts.collect():
        if r["h"] not in own:
            tail[r["cls"]] += r["c"] + 0.1
    for c in range(lm_scoring.CLASSES):  # with the unseen token's 0.1
        assert tail[c] + 0.1 == pytest.approx(m.tail_total[c] + 0.1 * (m.tail_distinct[c] + 1))


def test_score_of_a_text_by_hand(spark):
    """The classifier's score from the mean of the features' numbers, text by text."""
    import pyarrow as pa

    rng = random.Random(13)
    rows = [(i, prose(rng, 20) if i % 2 else "### $$$ " * 8, i % 2) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, label int")
    w, bias = quality_classifier.train(d)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(d, (w, bias), ["doc_id"]).collect()}
    for i, t, label in rows:
        f, _ = quality_classifier._features(pa.array([t]))
        z = sum(float(w[x]) for x in f.tolist()) / len(f) + bias
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5) and (got[i] >= 0.5) == bool(label)


def test_tied_turns_and_items(spark):
    """Turns of one number go by role, then text; equal items and repeated rows each count."""
    c = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (1, 1, "user", "z"), (None, 0, "user", "n")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r["turns"] for r in chat_format.format_conversations(c).collect()}
    assert [(t["role"], t["text"]) for t in out[1]] == [("assistant", "a"), ("assistant", "a"), ("user", "b"), ("user", "z")] and len(out[None]) == 1
    rng = random.Random(14)
    item = prose(rng, 30)
    b = spark.createDataFrame([(1, item), (2, item), (2, item)], "item_id long, text string")
    d = spark.createDataFrame([(5, f"x {item}"), (5, f"x {item}"), (6, prose(rng, 40)), (None, item)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["item_id"], r["start_word"]) for r in decontamination.find_items(d, b).collect()))
    assert got == [(0, 1, 0), (0, 2, 0), (5, 1, 1), (5, 2, 1)]


def test_every_link_of_a_passage(spark):
    """Every two different texts that have a passage meet, whatever the first texts of their signatures are; blocks of families too."""
    rng = random.Random(21)
    p = prose(rng, 60)
    d = spark.createDataFrame([(i, f"{prose(rng, 30)} {p} {prose(rng, 30)}") for i in range(12)], "doc_id long, text string")
    want = {(i, j) for i in range(12) for j in range(i)}
    for block in (256, 3):
        substring_dedup.BLOCK, before = block, substring_dedup.BLOCK
        try:
            assert {(r["doc_id"], r["ref_doc_id"]) for r in substring_dedup.near_passages(d).collect()} == want
        finally:
            substring_dedup.BLOCK = before


def test_all_pairs_of_keys():
    rng = np.random.default_rng(5)
    key, doc = rng.integers(0, 40, 300).astype(np.uint64), rng.integers(-60, 60, 300)
    have = {k: set(doc[key == k].tolist()) for k in key.tolist()}
    want = {(a, b) for m in have.values() for a in m for b in m if a > b}
    got = [(int(a), int(b)) for x, y in substring_dedup.all_pairs(key, doc) for a, b in zip(x, y, strict=True)]
    assert set(got) == want and len(got) == len(want)


def test_rounds_of_block_pairs(spark, monkeypatch):
    """Texts that are sent more often than their bytes allow go in rounds, with the same passages; nothing of a round's shuffles is left for the next."""
    rng = random.Random(22)
    p = prose(rng, 60)
    d = spark.createDataFrame([(i, f"{prose(rng, 30)} {p} {prose(rng, 30)}") for i in range(12)], "doc_id long, text string")
    want = sorted(tuple(r) for r in substring_dedup.near_passages(d).collect())
    monkeypatch.setattr(substring_dedup, "BLOCK", 3)
    monkeypatch.setattr(substring_dedup, "ROUND_BYTES", 1500)
    own = d.withColumn("mark", F.xxhash64("text"))
    pairs = spark.createDataFrame([(i, j) for i in range(12) for j in range(i)], "doc_id long, ref_doc_id long")
    rounds = list(substring_dedup._rounds(pairs, own, 1500))
    assert len(rounds) > 3
    sizes = [r.agg(F.sum(F.octet_length("packed"))).first()[0] or 0 for r in rounds]
    assert max(sizes) < sum(sizes) / 2
    assert sorted(tuple(r) for r in substring_dedup.near_passages(d).collect()) == want and len(want) == 66


def test_gradient_rows_are_summed_once():
    rng = np.random.default_rng(4)
    rows = np.minimum(rng.zipf(1.3, 500), 300)
    g = rng.normal(size=(500, 6)).astype(np.float32)
    u, n, s = lm_scoring.row_sums(rows, g)
    want = np.zeros((301, 6))
    np.add.at(want, rows, g)
    assert u.tolist() == np.unique(rows).tolist() and n.tolist() == np.bincount(rows)[u].tolist() and {1, 2} < set(n.tolist())
    assert np.allclose(s, want[u], atol=1e-4)


def test_rows_are_averaged_across_batches():
    rng = np.random.default_rng(5)
    table, r, n = np.sort(rng.integers(0, 2, 40)), np.zeros(40, np.int64), rng.integers(1, 9, 40).astype(float)
    w = [rng.normal(size=4 + 2 * t).astype(np.float32) for t in table.tolist()]
    whole = pa.record_batch([pa.array(table, pa.int32()), pa.array(r), pa.array(n), pa.array([x.tobytes() for x in w], pa.binary())], ["table", "r", "n", "w"])
    for size in (1, 7, 40):
        out = pa.Table.from_batches(list(lm_scoring._average(iter([whole.slice(i, size) for i in range(0, 40, size)]))))
        assert out.column("table").to_pylist() == [0, 1]
        for t, x in zip((0, 1), out.column("w").to_pylist(), strict=True):
            own = table == t
            assert np.allclose(np.frombuffer(x, np.float32), np.average([v for v, k in zip(w, own, strict=True) if k], 0, n[own]), atol=1e-6)


def test_repeated_words_are_few_passages():
    """A run in which each window stands many times in the earlier text is one passage, not one for every place."""
    for a, b in ((2000, 900), (300, 5000), (500, 500 + 1)):
        found = substring_dedup.passages(np.zeros(a, np.uint64), np.zeros(b, np.uint64), 46, 0.8)
        assert len(found) <= a // (b - 46) + 2 and {x for i, j, *_ in found for x in range(i, j + 1)} == set(range(a))
    for period in (1, 2, 7, 60):
        words = np.arange(period, dtype=np.uint64)
        a, b = np.resize(words, 700), np.concatenate([np.full(40, 99, np.uint64), np.resize(words, 700), np.full(3, 98, np.uint64)])
        assert substring_dedup.passages(a, b, 46, 0.8) == [(0, 699, 40, 739, 1.0)]


def test_cover_of_large_groups(spark):
    """Without ``every``, a passage of many documents takes rows in proportion to them, and the words with an earlier copy are those of all pairs."""
    rng = random.Random(6)
    p, family, docs = prose(rng, 60), prose(rng, 150).split(), []
    for n in range(60):
        docs.append(f"{prose(rng, 40)} {p} {'a few more words that some have ' * (n % 7 == 0)}{prose(rng, 40)}")
    for _ in range(30):  # near copies with words replaced
        docs.append(" ".join(w if rng.random() > 0.03 else prose(rng, 1) for w in family))
    rng.shuffle(docs)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")

    def cover(rows):
        return {(r["doc_id"], w) for r in rows for w in range(r["start_word"], r["start_word"] + r["n_words"])}

    every, some = substring_dedup.near_passages(d).collect(), substring_dedup.near_passages(d, every=False).collect()
    assert len(every) > 60 * 59 // 2 and len(some) < 6 * len(docs)
    assert cover(every) == cover(some)


def test_covering_pairs():
    """Copies of a core meet the first one; those that have more in common meet each other; any order of rows gives the same."""
    core, more, loose = np.arange(60), np.arange(100, 104), iter(range(1000, 10_000, 50))
    stretches = [np.concatenate([np.arange(x := next(loose), x + 20), core, more if n in (3, 7) else [], np.arange(x + 20, x + 40)]).astype("<u4") for n in range(12)]
    want = {(n, 0) for n in range(1, 12)} | {(7, 3)}
    for order in (range(12), range(11, -1, -1)):
        docs = np.array(order)
        got = {(int(x), int(y)) for a, b in substring_dedup.covering_pairs(docs, [stretches[n] for n in order], 46, 0.8) for x, y in zip(a, b, strict=True)}
        assert got == want
    assert list(substring_dedup.covering_pairs(np.array([5]), [np.zeros(0, "<u4")], 46, 0.8)) == []
