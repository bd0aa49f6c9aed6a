"""The ten operators against plain versions, and on nulls, empty, long, tied and repeated
rows, empty tables and extra columns with clashing names."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from respan.llm import (decontamination, golay, gru, language_id, language_model, packing, pii, sharding, simhash,
                        substrings, toxicity, winnowing)
from respan.llm.util import bitmap, in_bitmap, tokenizer_path, window_hashes
from tests.conftest import SF_SMALL
from tests.llm import brute

LONG = " ".join(f"wörd{i % 977} e{i}" for i in range(30000))
RNG = random.Random(5)
PROSE = [" ".join(RNG.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(RNG.randint(0, 40))
                  for _ in range(RNG.randint(14, 60))) for _ in range(12)]
SHARED = " ".join(f"s{i}" for i in range(60))
ROWS = ([(i, t) for i, t in enumerate(PROSE)]
        + [(20, PROSE[0]), (21, PROSE[0] + " x"), (22, "lead " + SHARED + " tail"), (23, "other " + SHARED + " end"),
           (24, SHARED), (24, SHARED), (25, None), (26, ""), (27, " \t\n"), (28, "One two"), (29, "日本語の文章です。😀"),
           (None, SHARED), (None, None), (30, LONG), (31, "one two")])
CLASH = ("key", "fp", "t", "d", "h", "doc", "bucket", "shard", "slot", "label", "_key0", "_id1", "copy", "piece", "region",
         "score", "y", "rate", "hits", "word")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, toxic int, item_id long")


def table(spark, name):
    return spark.read.parquet(f"{SF_SMALL}/{name}.parquet")


def same(a, b):
    return collections.Counter(map(tuple, a)) == collections.Counter(map(tuple, b))


# ---------------------------------------------------------------- helpers
def test_bitmap_and_window_hashes(spark):
    h = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)
    df = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long")
    words = bitmap(df, "h", 16)
    assert in_bitmap(h, words).all() and 0 < np.unpackbits(words.view(np.uint8)).sum() <= 500
    a = np.arange(1, 50, dtype=np.uint64)
    w = window_hashes(np.concatenate([a, a]), 5)
    assert (w[:45] == w[49:94]).all() and len(set(w.tolist())) == 49 and not len(window_hashes(a, 60))


def test_golay_code_is_perfect_and_keys_meet():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 23, 4000)
    own, keys = golay.decode(x), golay.keys(x)
    assert ((keys == own[:, None]).sum(axis=1) == 1).all()
    assert set(np.unique((keys >= 0).sum(axis=1))) <= {1, 6}
    for b in range(23):
        y = golay.decode(x ^ (1 << b))
        assert ((keys == y[:, None]).any(axis=1)).all()


def test_gru_gradients_are_right():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float64) for k, v in gru.init(3, 5, rng).items()}
    x, target = rng.integers(0, 5, (6, 4)), rng.normal(size=(6, 3, 4))

    def loss(q):
        s, tape = gru.forward(q, x, np.zeros((3, 4)))
        return float((s * target).sum()), tape

    _, tape = loss(p)
    grads = gru.backward(p, x, tape, target)
    for k in p:
        for i in list(np.ndindex(p[k].shape))[::4]:
            q = {n: v.copy() for n, v in p.items()}
            q[k][i] += 1e-3
            up = loss(q)[0]
            q[k][i] -= 2e-3
            assert abs((up - loss(q)[0]) / 2e-3 - grads[k][i]) < 2e-2


# ---------------------------------------------------------------- 1 language identification
def test_language_id(spark, docs, empty):
    train = table(spark, "documents")
    out = language_id.identify(train, F.col("doc_id") % 4 != 2).join(train.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.doc_id % 4 == 2]
    assert (held.lang_pred == held.lang).mean() > 0.9 and out.score.between(0, 1).all() and len(out) == train.count()
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") == 29, "ja").when(F.col("doc_id") < 12, "en"))
    rows = language_id.identify(labelled, F.lit(True)).collect()
    assert len(rows) == len(ROWS)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {25, 26, 27, None} and {r.lang_pred for r in rows} == {"und", "ja", "en"}
    assert language_id.identify(empty, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_id.identify(labelled, F.lit(False)).collect()} == {"und"}


def test_language_positions_count_once():
    model = language_id.train([("a", b"x" * 128), ("b", b"yz" * 64)] * 4, epochs=1)
    text = bytes(RNG.choice(b"xyz") for _ in range(300))
    whole = language_id.pooled(model, [text, b"xy", text[:128]])
    assert np.allclose(whole.sum(axis=1), 1, atol=1e-4)
    one = language_id.position_probabilities(model, np.frombuffer(text[:128], np.uint8)[:, None])
    assert np.allclose(one[:, :, 0].mean(axis=0), whole[2], atol=1e-5)


# ---------------------------------------------------------------- 2 sharding
def test_sharding(spark, docs, empty):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == len(ROWS)
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    text = {d: t for d, t in ROWS if d is not None}
    for r in rows:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    assert sharding.shard(empty).count() == 0
    real = sharding.shard(table(spark, "documents")).toPandas()
    total = real.groupby("shard")["size"].sum()
    assert len(total) == 8 and total.max() - total.min() < 0.05 * total.mean()
    texts = table(spark, "documents").toPandas().set_index("doc_id").text
    assert (real.assign(t=real.doc_id.map(texts)).groupby("t").shard.nunique() == 1).all()


def test_sharding_splits_only_a_group_above_a_share(spark):
    rows = [(i, "hot " * 50) for i in range(400)] + [(1000 + i, f"cold {i} " * 9) for i in range(300)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    size = out.groupby("shard")["size"].sum()
    assert size.max() - size.min() < 0.05 * size.mean()


def test_write_shards_keeps_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "x") for i in range(40)], "doc_id long, text string, shard string")
    sharding.write_shards(df, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 40 and {r.text for r in back.collect()} == {f"t{i}" for i in range(40)}


# ---------------------------------------------------------------- 3 fingerprints
def test_winnowing(spark, docs, empty):
    rows = winnowing.compare_with_edits(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    ids = sorted((d for d, _ in ROWS if d is not None and d != 24))
    text = {d: t or "" for d, t in ROWS if d is not None}
    for d, nxt in [(i, j) for i, j in zip(ids, ids[1:]) if not i < 24 < j]:
        t, half = text[d], len(text[d]) // 2
        assert by[d].edited_sha256 == hashlib.sha256((t[:len(t) - half] + text[nxt][:half]).encode()).hexdigest()
        assert by[d].n_chars == len(t) and 0 <= by[d].near_edited <= 1 and 0 <= by[d].near_next <= 1
    assert by[0].fingerprint == by[20].fingerprint != by[1].fingerprint and by[26].fingerprint == ""
    assert winnowing.compare_with_edits(empty).count() == 0
    plan = winnowing.compare_with_edits(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_winnowing_picks_the_rightmost_least_hash(spark):
    text = " ".join(RNG.choice("abc") for _ in range(80))
    row = winnowing.with_fingerprint(spark.createDataFrame([(text,)], "text string"), "text", "fp").select(
        "fp", F.transform(F.split("text", " "), lambda x: F.xxhash64(x)).alias("h")).first()
    sums = {}

    def both(a, b):
        if (a, b) not in sums:
            sums[a, b] = None
        return a, b

    pairs = [both(a, b) for a, b in zip(row.h, row.h[1:])]
    hashed = {(r.a, r.b): r.x for r in spark.createDataFrame(sorted(set(pairs)), "a long, b long")
              .withColumn("x", F.xxhash64("a", "b")).collect()}
    two = [hashed[p] for p in pairs]
    quads = list(zip(two, two[2:]))
    hashed = {(r.a, r.b): r.x for r in spark.createDataFrame(sorted(set(quads)), "a long, b long")
              .withColumn("x", F.xxhash64("a", "b")).collect()}
    grams = [(hashed[q] % (1 << 64)) >> 33 for q in quads]
    picked = {min(range(i, i + 8), key=lambda j: (grams[j], -j)) for i in range(len(grams) - 7)}
    assert sorted(picked) == sorted(winnowing.LOW - (v & winnowing.LOW) for v in row.fp)


# ---------------------------------------------------------------- 4 SimHash
def test_simhash(spark, docs, empty):
    known = [(d, t) for d, t in ROWS if d is not None]
    expected = brute.simhash_components(known)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == expected[r.doc_id]
    assert {r.component_id for r in rows if r.doc_id is None} == {expected[24][1], expected[25][1]}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({c for _, c in expected.values()})


def test_simhash_links_every_pair_within_three_bits(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    fps = set(base.tolist())
    for x in base[:20]:
        for n in (1, 2, 3, 4):
            for _ in range(6):
                fps.add(int(x) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    got = simhash.components(simhash.links(df), "test").collect()
    label = {int(np.int64(r.node).astype(np.uint64)): r.component for r in got}
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for x in fps:
        groups[find(x)].add(x)
    for g in groups.values():
        assert len({label.get(x, x) for x in g}) == 1
    assert len({label.get(x, x) for x in fps}) == len(groups)


# ---------------------------------------------------------------- 5 personal data
PII = ["mail a.b+c@ex-am.ple.co.uk, x@y@z.com .@a.b a@b..c me@x.de@y.fr", "ip 1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.255 1.2.3",
       "4111 1111 1111 1111 and 4111-1111-1111-1112, 12 34, 4111111111111111222 9 9", "call +49 (30) 1234-5678. or +1 2 +12345678901234567",
       "+1-800-555-0199+44 20 7946 0958 1.1.1.1@2.2.2.2", "IBAN: DE89 3704 0044 0532 0130 00 and account no DE00 0000 0000 0000 0000 00",
       "see https://bob:secret@host.example/x and https://host.example/y", "9" * 6000 + ".1.1.1 " + "0" * 5000 + ".1.1.1"]


def test_pii(spark, empty):
    alphabet = "0123456789.@+- ()ab%_\n"
    texts = PII + ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(1, 120))) for _ in range(400)] + [None, "", LONG]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.find_personal_data(df).collect():
        t = texts[r.doc_id]
        if t and len(t) > 4300:
            continue  # int() of the plain version has a limit
        found = brute.personal_data(t)
        count = collections.Counter(k for k, _, _ in found)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in pii.BASE_KINDS), t
        assert r.base_sha256 == hashlib.sha256(pii.joined(found).encode()).hexdigest()
        assert r.spans.startswith(pii.joined(found))
    assert pii.find_personal_data(empty).count() == 0
    anchors = pii.automaton()
    kinds = [[k for k, _, _ in pii.spans(t, anchors)] for t in PII]
    assert kinds[5].count("account") == 1 and "login" in kinds[6] and kinds[6].count("login") == 1
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[6].endswith("https://host.example/y") and "secret" not in clean[6]
    assert len(clean) == len(texts) and clean[texts.index(None)] is None


def test_redaction_merges_overlaps():
    assert pii.redacted("abcdefgh", [("ip", 1, 4), ("email", 2, 6)]) == "a[IP]gh"


# ---------------------------------------------------------------- 6 language model
def test_language_model(spark, docs, empty):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = language_model.score(docs, ~held).collect()
    assert len(rows) == len(ROWS)
    counts = collections.Counter()
    for d, t in ROWS:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1:
            counts.update([*brute.words((t or "").lower()), None])
    n, v = sum(counts.values()), len(counts)
    text = {d: t for d, t in ROWS if d is not None}
    for r in rows:
        assert r.train_tokens == n
        if r.doc_id is None:
            continue
        w = [*brute.words((text[r.doc_id] or "").lower()), None]
        base = sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known) == (len(w), sum(counts[x] > 0 for x in w))
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert language_model.score(empty, F.lit(True)).count() == 0
    none = language_model.score(docs, F.lit(False)).collect()
    assert len(none) == len(ROWS) and all(r.train_tokens == 0 and r.n_known == 0 for r in none)


def test_rare_words_by_join_score_like_head_words(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PROSE)], "doc_id long, text string")
    one = {r.doc_id: r.base_score for r in language_model.score(df, F.lit(True)).collect()}
    monkeypatch.setattr(language_model.Vocabulary.__init__, "__defaults__", (40, 10))
    two = {r.doc_id: r.base_score for r in language_model.score(df, F.lit(True)).collect()}
    assert all(abs(one[k] - two[k]) < 1e-9 * abs(one[k]) for k in one)


def test_network_probabilities_sum_to_one_and_carry_state():
    rng = np.random.default_rng(6)
    p = language_model.new_model(rng.integers(1, 90, 70).astype(float))
    h = rng.normal(size=(3, language_model.HIDDEN)).astype(np.float32)
    total = sum(np.exp(language_model.log_probabilities(p, h, np.full(3, s))) for s in range(70))
    assert np.allclose(total, 1, atol=1e-4)
    docs = [rng.integers(0, 70, n).astype(np.int32) for n in (1, 5, 90, 400, 33)]
    together = language_model.document_log_probabilities(p, docs)
    for d, got in zip(docs, together, strict=True):
        h, lp, before = np.zeros((language_model.HIDDEN, 1), np.float32), 0.0, language_model.END
        for s in d:
            h = gru.step(p["U"][:, [before]].copy(), p["W"], h)
            lp += language_model.log_probabilities(p, h.T, np.array([s]))[0]
            before = s
        assert abs(lp / language_model.LN10 - got) < 1e-3 * max(1, abs(got))


def test_training_lowers_the_loss():
    rng = np.random.default_rng(8)
    w = (np.arange(33) * 3 + rng.integers(0, 20, (1500, 1))) % 40
    p = language_model.new_model(np.bincount(w.ravel(), minlength=40).astype(float))
    before = language_model.document_log_probabilities(p, list(w[:50].astype(np.int32))).sum()
    q = language_model.train_windows(p, w.astype(np.int32))
    assert language_model.document_log_probabilities(q, list(w[:50].astype(np.int32))).sum() > 0.8 * before


def test_every_word_is_trained_on(spark):
    span = language_model.SPAN
    for n in (0, 1, span - 1, span, 5 * span + 7):
        w = language_model.text_windows(np.arange(2, n + 2))
        targets = w[:, 1:].ravel()
        assert targets[targets >= 0].tolist() == [*range(2, n + 2), language_model.END]
        assert w[0, 0] == language_model.END and (w[1:, 0] == w[:-1, -1]).all()
    texts = [" ".join(f"w{i % 50}" for i in range(3000)), "日" * 2000 + " 本", None]
    df = spark.createDataFrame([(i, None if t is None else t.encode()) for i, t in enumerate(texts)], "key long, t binary")
    counts = language_model.word_counts(df)
    vocab = language_model.Vocabulary(counts, 3)
    vocab.level = None
    rows = language_model._windows(df, spark.sparkContext.broadcast(vocab)).collect()
    used = {r.key: sum(x >= 0 for x in np.reshape(r.w, (-1, span + 1))[:, 1:].ravel()) for r in rows}
    assert used == {0: 3001, 1: 3, 2: 1}


def test_training_carries_the_state(spark):
    rng = np.random.default_rng(4)
    w = rng.integers(0, 40, (6, language_model.SPAN + 1)).astype(np.int32)
    p = language_model.new_model(np.bincount(w.ravel(), minlength=40).astype(float))
    one = language_model.train_windows(p, w, np.array([6]))
    cut = language_model.train_windows(p, w, np.array([1] * 6), lanes=1)
    assert all(np.isfinite(v).all() for v in one.values()) and not np.allclose(one["W"], cut["W"])


def test_output_gradients_of_all_classes_together():
    rng = np.random.default_rng(6)
    p = language_model.new_model(rng.integers(1, 90, 100).astype(float))
    h = rng.normal(size=(language_model.HIDDEN, 150)).astype(np.float32)
    y = np.where(rng.random(150) < 0.5, 1, rng.integers(-1, 100, 150))
    y[y // 32 == 2] = 3  # a class without targets
    grads, dh = language_model.output_gradients(p, h, y)
    plain = {k: np.zeros(p[k].shape) for k in ("C", "cb", "D", "db")}
    back = np.zeros(h.shape)
    for i in np.flatnonzero(y >= 0):
        c, k = divmod(int(y[i]), language_model.CLASS)
        d = gru.softmax(p["C"] @ h[:, i] + p["cb"], 0) - (np.arange(len(p["C"])) == c)
        e = gru.softmax(p["D"][c] @ h[:, i] + p["db"][c], 0) - (np.arange(language_model.CLASS) == k)
        for name, part, at in (("C", np.outer(d, h[:, i]), ...), ("cb", d, ...), ("D", np.outer(e, h[:, i]), c), ("db", e, c)):
            plain[name][at] += part / (y >= 0).sum()
        back[:, i] = (p["C"].T @ d + p["D"][c].T @ e) / (y >= 0).sum()
    assert all(np.allclose(grads[k], plain[k], atol=1e-6) for k in plain) and np.allclose(dh, back, atol=1e-6)


def test_lanes_of_a_training_task_are_busy():
    """Long texts among short ones leave a task few turns in which most lanes are idle."""
    rng, sizes = np.random.default_rng(2), []
    while sum(sizes) < language_model.TASK_WINDOWS:
        sizes.append(int(np.clip(np.exp(rng.normal(2.2, 1.3)), 1, 400)))
    lanes = language_model.dealt(np.array(sizes), language_model.LANES)
    longest = max(sum(sizes[i] for i in mine) for mine in lanes)
    assert sum(sizes) > 0.6 * longest * language_model.LANES


# ---------------------------------------------------------------- 7 toxicity
def test_toxicity(spark, docs, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(["sun", "moon", "tree", "road", "river", "cloud"]) + str(rng.randint(0, 9)) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            for w in rng.sample(["gruk", "flarn", "zoxle", "plim"], 2):
                words.insert(rng.randint(0, 30), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad) if rng.random() > 0.03 else int(not bad), "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(3, None, "x"), (None, 1, "x")], "doc_id long, toxic int, score string")
    out = {r.doc_id: r for r in toxicity.score(df, lab, F.col("doc_id") % 4 != 0).collect()}
    assert sum(out[i].predicted != int(i % 5 == 0) for i in range(400)) <= 4
    again = toxicity.score(docs, lab, F.lit(True)).collect()
    assert len(again) == len(ROWS) and all(0 <= r.score <= 1 for r in again)
    assert toxicity.score(empty, lab, F.lit(True)).count() == 0
    assert all(r.score == 0 for r in toxicity.score(docs, empty, F.lit(True)).collect())
    kept = toxicity.reject(df, lab, F.lit(True))
    assert kept.columns == df.columns and abs(kept.count() - 320) <= 4


def test_toxicity_copies_are_one_text(spark):
    copied = " ".join(f"odd{i:03d}{'xyz'[i % 3]}" for i in range(400))
    rng = random.Random(8)
    rows = ([(i, copied, 1) for i in range(200)]
            + [(200 + i, f"{rng.choice(PROSE)} w{i} vileword", 1) for i in range(60)]
            + [(300 + i, f"{rng.choice(PROSE)} w{i + 60}", 0) for i in range(300)])
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon, *_ = toxicity.fit(df.drop("toxic"), df.drop("text"), F.lit(True), "doc_id", "text", "toxic")
    assert "=vileword" in lexicon and not [f for f in lexicon if "odd" in f]


def test_toxicity_keeps_every_voter(spark):
    rows = ([(i, " ".join(f"{a}{b}vile{i % 2}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz") + f" w{i}", 1) for i in range(80)]
            + [(100 + i, f"{RNG.choice(PROSE)} w{i + 80}", 0) for i in range(80)])
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon, *_ = toxicity.fit(df.drop("toxic"), df.drop("text"), F.lit(True), "doc_id", "text", "toxic")
    assert len([f for f in lexicon if f.startswith("=")]) == 320


# ---------------------------------------------------------------- 8 decontamination
def test_decontamination(spark, docs, empty):
    item = "If a train leaves Berlin at 9 and travels 60 km with 4 stops how many minutes does Anna wait in Berlin today"
    asked = item.replace("Berlin", "Paris").replace("60", "85").replace("Anna", "Tom").replace("9", "7").replace("4", "3")
    mixed = asked.replace("in Paris today", "in Rome today")
    texts = ["before it " + item + " after it", "some words " + asked + " more words", item, " ".join(item.split()[:9]),
             "calm text without any of that at all really", None, "", "x " + mixed + " y", "1 2 3 4 5 6 7 8 9 10 11 12 13 14"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)],
                               "doc_id long, text string, item_id string, key string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "two words"), (10, "five little words stand here"),
                                   (11, "11 22 33 44 55 66 77 88 99 10 11 12 13 14")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(df, bench).collect()}
    assert {k for k in got if k[1] == 7} == {(0, 7), (1, 7), (2, 7), (7, 7)} and len(got) == 4
    # the slots of the last are consistent up to the word before "Rome" only
    assert got[1, 7].tokens == got[0, 7].tokens == 22 and got[7, 7].tokens < 22
    kept = decontamination.remove_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 8}
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(df, empty).count() == 0
    assert decontamination.remove_leaks(docs, bench).count() == len(ROWS)


def test_decontamination_matches_exact_search(spark):
    out = {(r.doc_id, r.item_id) for r in decontamination.leaks(table(spark, "documents"), table(spark, "benchmark")).collect()}
    items = {r.item_id: r.text.split() for r in table(spark, "benchmark").collect()}
    for r in table(spark, "documents").collect():
        line = f" {' '.join(r.text.split())} "
        for k, w in items.items():
            if any(f" {' '.join(w[i:i + 13])} " in line for i in range(1, len(w) - 12)):
                assert (r.doc_id, k) in out


def leaked(spark, items, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()}


def test_decontamination_finds_verbatim_copies_from_the_first_word(spark):
    letters = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    items = [" ".join([f"Start{n}", *letters[:n - 1]]) for n in range(5, 15)]
    texts = [f"here {t} {end}" for end in ("there", "") for t in items] + [f"Done. {t.lower()}" for t in items]
    texts += [f"words {' '.join(t.split()[1:])}" for t in items[:9]]
    got = leaked(spark, items, texts)
    assert {(i, i % 10) for i in range(30)} <= got
    assert not {(30 + i, i) for i in range(9)} & got


def test_decontamination_finds_refilled_slots(spark):
    pairs = [("Anna has $12. Ben has $15. Anna gives Ben the rest of it and walks home.",
              "Tom has $9. Max has $11. Tom gives Max the rest of it and walks home."),
             ("A 20-year lease of the 3rd house, 5km out, costs seventeen coins in sixty parts or so",
              "A 35-year lease of the 2nd house, 8km out, costs nineteen coins in ninety parts or so"),
             ("Add 12 15 18 21 24 27 to 31 33 35 37 39 41 then take 50 51 52 53 54 away and halve it",
              "Add 13 16 19 22 25 28 to 32 34 36 38 40 42 then take 60 61 62 63 64 away and halve it")]
    got = leaked(spark, [a for a, _ in pairs], [f"so it is said {b} once more" for _, b in pairs]
                 + [" ".join(map(str, range(100, 160))), "Tom has $9. Max has $11. Tom gives Tom the rest of it and walks home."])
    assert got == {(0, 0), (1, 1), (2, 2)}


# ---------------------------------------------------------------- 9 packing
def test_packing(spark, docs, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack(docs, path, 256).collect()
    texts = {d: t for d, t in ROWS if d is not None}
    ids = dict(zip(texts, brute.token_ids(list(texts.values()), path), strict=True))
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    for d, i in ids.items():
        assert sum(r.length for r in pieces[d]) == len(i) * (2 if d == 24 else 1)
        for r in pieces[d]:
            assert r.ids_crc32 == brute.crc_ids(i[r.start:r.start + r.length])
            assert r.length == 256 or r.piece == 0
    assert packing.pack(empty, path).count() == 0
    least = -(-sum(r.length for r in rows) // 256)
    assert len(sequences) <= least * 1.02 + 1


def test_word_ids_equal_the_tokenizer(spark):
    words = packing.word_ids(tokenizer_path("byte_bpe_50k.json"))
    texts = ["a  b", " a", "a ", "  ", "\n a\n\n b \t c", "it's we'll 12 3a b   c", "x <|endoftext|> y", "", "a 　b", "é 😀 ß",
             *["".join(RNG.choice("ab' \n\t 1.") for _ in range(30)) for _ in range(300)]]
    import numpy as np

    expected = [np.asarray(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.ids(texts) == expected


def test_genetic_packing_is_valid_and_no_worse_than_best_fit():
    size = [RNG.randint(1, 99) for _ in range(300)]
    first = packing.Packing(100)
    first.best_fit(list(range(300)), size)
    best = packing.evolve(size, 100, [], seed=3, crossovers=20)
    again = packing.evolve(size, 100, [best.bins, first.bins], seed=4, crossovers=20)
    for p in (best, again):
        assert sorted(i for g in p.bins for i in g) == list(range(300))
        assert all(sum(size[i] for i in g) == 100 - r and r >= 0 for g, r in zip(p.bins, p.room, strict=True))
        assert len(p.bins) <= len(first.bins)
    assert len(again.bins) <= len(best.bins)


# ---------------------------------------------------------------- 10 substring dedup
def test_substring_dedup(spark, docs, empty):
    rows = substrings.deduplicate(docs).collect()
    assert same(rows, brute.substring_dedup(ROWS))
    assert substrings.deduplicate(empty).count() == 0


def test_substring_dedup_of_spliced_texts(spark):
    rng = random.Random(12)
    source = [str(rng.randint(0, 30)) for _ in range(400)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(0, 380)
            w += source[a:a + rng.randint(5, 40)] if rng.random() < 0.7 else [f"u{rng.randint(0, 10**6)}" for _ in range(9)]
        rows.append((rng.randint(0, 45), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = substrings.deduplicate(df, with_text=True).collect()
    assert same([r[:4] for r in out], brute.substring_dedup(rows))
    for r in out:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(b - a for a, b in (map(int, s.split(":")) for s in r.spans.split(",") if s)) == r.n_removed
