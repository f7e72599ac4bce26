"""Mixing and language-model scoring: closed forms, held-out accuracy, probabilities that sum to one."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.llm import lm, mixing
from panelmill.llm.common import words_of

SF = "/root/testdata/sf0.01"


def solve(n, p, goal, ridge):
    """The rates by the dual's fixed point: r = max(0, 1 - p.y), y = scaled residual / ridge, found by damped steps."""
    w, y = n / n.sum(), np.zeros(len(goal))
    c = 1 / (w @ p)
    for _ in range(400_000):
        r = np.maximum(0, 1 - p @ y)
        new = c * ((w * r) @ p - goal) / ridge
        if np.abs(new - y).max() < 1e-9:
            break
        y += 0.002 * (new - y)
    return np.maximum(0, 1 - p @ y)


@pytest.mark.parametrize("goal", [(0.7, 0.3, 0.0), None])
def test_rates_solve_the_least_squares(spark, goal):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.6, 0.2, 0.2], 200) if goal is None else rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(1, 500, 200)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    history = mixing.fit_rates(df, goal, 0.05, 400, 1e-9)
    got = mixing.rates_after(history, p, 1 / 1.05, 0.05)[0]
    w = n / n.sum()
    if goal is None:
        spill = [sum(a * x[k] for a, x in zip(w, p) if max(x) > x[k]) for k in range(3)]
        toxic, junk = (min((w @ p)[k], max(t, 0.6 * spill[k])) for k, t in ((2, 0.0), (1, 0.015)))
        goal = (1 - junk - toxic, junk, toxic)
    assert np.allclose(got, solve(n, p, np.array(goal), 0.05), atol=2e-3) and (got >= 0).all()


def test_default_goals_are_reached_on_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.mix_sources(docs, labels, carry=["doc_id"]).toPandas()
    p, w = rows[["p_clean", "p_junk", "p_toxic"]].to_numpy(), rows["n_tokens"].to_numpy() / rows["n_tokens"].sum()
    spill = [(w * p[:, k])[p.argmax(axis=1) != k].sum() for k in range(3)]
    goal = mixing.goals(w @ p, np.array(spill))
    got = (w * rows["rate"].to_numpy()) @ p
    assert (abs(got - goal) <= 0.04 * (w @ p)).all() and abs(got.sum() - 1) < 0.02
    truth = labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("d")).toPandas().merge(rows, on="doc_id")
    kept = (truth["copies"] > 0).groupby(truth["d"]).mean()
    assert kept[0] > 0.95 and kept[1] < 0.2 and kept[2] < 0.2


def test_mixing_meets_targets_and_tells_toxic_texts(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        kind = rng.choice(["clean"] * 4 + ["junk", "toxic"])
        words = [rng.choice(["sun", "sea", "tree", "stone", "river", "road"]) + rng.choice("abcdef") for _ in range(60)]
        if kind == "junk":
            words = [w + "###" for w in words]
        if kind == "toxic":
            words[rng.randrange(60)] = words[rng.randrange(60)] = "moron"
        docs.append((i, " ".join(words), kind, "x"))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    docs += [(None, "sun sea", "clean", "x"), (601, None, "clean", "x"), (602, "", "clean", "x"), docs[0]]
    labels += [(None, 1, 0), (3, None, None), (9999, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string, rate string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = mixing.mix_sources(df, known, targets=(0.9, 0.1, 0.0)).collect()
    assert len(rows) == len(docs) and {"n_tokens", "p_clean", "rate", "copies"} <= set(rows[0].asDict())
    fresh = [r for r in rows if r["doc_id"] is not None and r["doc_id"] % 2 == 0 and r["n_tokens"]]
    best = [max(mixing.DOMAINS, key=lambda d, r=r: r[f"p_{d}"]) == r["kind"] for r in fresh]
    assert sum(best) / len(best) > 0.95
    total = sum(r["n_tokens"] for r in rows)
    shares = [sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows) / total for d in mixing.DOMAINS]
    assert np.allclose(shares, (0.9, 0.1, 0.0), atol=0.05)
    assert all(r["copies"] == 0 and r["rate"] == 0 for r in rows if not r["n_tokens"])
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in rows)
    assert mixing.mix_sources(df.limit(0), known).count() == 0
    even = mixing.mix_sources(df.limit(3), known.limit(0)).first()
    assert math.isclose(even["p_clean"], 1 / 3, rel_tol=1e-6)


@pytest.mark.parametrize("junk,toxic", [(0.1, 0.01), (0.015, 0.0001), (0.005, 0.001)])
def test_rare_domains_reach_their_targets_and_clean_rates_stay_at_one_or_more(spark, monkeypatch, junk, toxic):
    class Sure:
        def member(self, text):
            words = (text or "").split()
            return np.array([float(words[0] == d) for d in ("clean", "junk", "toxic")]), len(words)

    monkeypatch.setattr(mixing, "fit_classifier", lambda *_: Sure())
    parts = {"clean": round(20_000 * (1 - junk - toxic)), "junk": round(20_000 * junk), "toxic": round(20_000 * toxic)}
    df = spark.createDataFrame([(i, f"{d} " * n) for i, (d, n) in enumerate(parts.items()) if n], "doc_id long, text string")
    rate = {mixing.DOMAINS[r["doc_id"]]: r["rate"] for r in mixing.mix_sources(df, df).collect()}
    assert rate["clean"] >= 1 - 1e-9 and rate.get("toxic", 0) < 0.02
    if junk:
        assert math.isclose(rate["junk"], min(1, 0.015 / junk), abs_tol=0.02)


def test_heldout_domains_on_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(2)) == 0
    model = mixing.fit_classifier(docs, labels.where(half))
    rows = docs.join(labels.where(~half), "doc_id").select("text", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("d")).collect()
    right = sum(int(np.argmax(model.posterior(r["text"]))) == r["d"] for r in rows)
    assert right / len(rows) > 0.85


def stats(rows):
    counts = collections.Counter()
    token = lambda t: [*words_of(t), b"\n"]
    for d, t in rows:
        if not lm.held_out(d):
            counts.update(token(t))
    n, v = sum(counts.values()), len(counts)
    return {d: (lm.held_out(d), len(token(t)), sum(counts[w] > 0 for w in token(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in token(t))) for d, t in rows}


def test_scores(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "Sea", "tree", "été"]) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(None, "the sea"), (500, None), (501, ""), (502, "x" * 100_000), (503, "\x00\x1c odd")]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in lm.score(df, chunk_bytes=4000).collect()}
    assert len(got) == len(rows)
    for d, (held, n, known, total, base) in stats(rows).items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total), d
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    held = [r for d, r in got.items() if r["held_out"] and d and d < 500 and r["n_tokens"] > 5]
    assert sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) > -1.6  # 12 words alike would be -1.08
    assert lm.score(df.limit(0)).count() == 0
    again = lm.score(spark.createDataFrame([rows[0], rows[0]], "doc_id long, text string")).collect()
    assert len(again) == 2 and again[0] == again[1]


def test_copies_score_alike_wherever_slices_part_them(spark):
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(22_000))
    got = lm.score(spark.createDataFrame([(i, text) for i in range(80)], "doc_id long, text string")).collect()
    assert len(got) == 80 and len({r["score"] for r in got}) == 1


def test_a_chunk_splits_its_texts_once(monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "words_of", lambda t: seen.append(t) or words_of(t))
    lm.parts_of(["the sea", "a tree", None])
    assert len(seen) == 3


def test_ranked_grams():
    rng = np.random.default_rng(9)
    for n in (1, 7, lm.SLICE):
        grams = rng.choice(np.append(rng.integers(0, lm.GRAM, n, np.uint64), [0, lm.GRAM]).astype(np.uint64), n)
        keys, which = lm.ranked(grams)
        assert (keys == np.unique(grams)).all() and (keys[which] == grams).all()


def test_predictions_sum_to_one():
    rng = np.random.default_rng(3)
    text = lm.Stream(["the sea the tree " * 20, "a tree by the sea " * 9, None])
    grams = [code[own] for _, code, own in text.grams()]
    keys, counts = np.unique(np.concatenate(grams), return_counts=True)
    low = np.bincount((keys & np.uint64(0xFFFF)).astype(int), counts, 65536).reshape(256, 256)
    root = lm.short_root(low, 2, (0.3, 0.4, 0.5, 0.6, 0.7, 0.8), 1)
    levels = lm.levels_of(keys, counts, 2)
    for _ in range(3):
        lm.sweep(levels, root.tables[0], root, rng)
        for level in levels.values():
            assert (level.t >= 1).all() and (level.t <= level.n).all()
    for context in (b"\n\n\n\n\n", b" the ", b"zzzzz", b"e sea", b"qthe "):
        code = np.uint64(int.from_bytes(context, "big") << 8) | np.arange(256, dtype=np.uint64)
        assert math.isclose(lm.answer(levels, root.tables[0], root, code).sum(), 1, rel_tol=1e-9)


@pytest.mark.parametrize("n,p", [(3, 0.2), (60, 0.01), (3000, 0.05)])
def test_seating_follows_the_expected_number_of_tables(n, p):
    rng, d, s = np.random.default_rng(5), 0.6, 0.5
    got = lm.seat(np.full(4000, n), np.zeros(4000, int), np.full(4000, p), d, s, rng).mean()
    state = np.zeros(n + 1)
    state[1] = 1
    t = np.arange(n + 1)
    for j in range(1, n):
        a = (s + d * t) * p
        open_ = state * a / (a + j - d * t + 1e-300)
        state = state - open_ + np.append(0, open_[:-1])
    assert math.isclose(got, (state * t).sum(), rel_tol=0.06)


def test_keys_of_a_chunk_do_not_depend_on_the_order_of_its_texts():
    texts = ["a b c" * i for i in range(30)] + [None, "", "x" * 100, "été sea"]
    want = lm.parts_of(texts)[0]
    for seed in range(5):
        random.Random(seed).shuffle(texts)
        for (_, a), (_, b) in zip(want, lm.parts_of(texts)[0]):
            assert (a == b).all()
