"""Removal of repeated passages of words against brute force."""

import hashlib
import random

import pytest

from panelmill.llm import passages


def removal(rows, length):
    held = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in held:
        if d is not None:
            for i in range(len(w) - length + 1):
                s = tuple(w[i : i + length])
                first[s] = min(first.get(s, d), d)
    out = []
    for d, w in held:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if d is not None and first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def result(df, length, **more):
    rows = passages.remove_passages(df, length, with_text=True, **more).collect()
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept_sha256"], r["kept"]) for r in rows), key=str)


def corpus(rng, length):
    word = lambda: rng.choice(["a", "b", "É", "c,", "日本", "B"])
    pool = [[word() for _ in range(rng.randint(10, 4 * length))] for _ in range(10)] + [["a"] * 3 * length, ["a", "b"] * 2 * length]
    rows = [(None, " ".join(pool[0] * 3)), (1000, None), (1001, ""), (1002, "short"), (1003, "x\0 " * 80), (1004, "x\0\n\t" * 80), (1005, " \n")]
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts += p[a : a + rng.randint(1, 3 * length)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [rows[10], rows[11], (rows[12][0], " ".join(pool[3] * 2)), (2000, rows[15][1]), (2001, rows[15][1]), (-5, rows[16][1]), (2002, "\n".join(rows[17][1].split()))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("length", [12, 50])
def test_removed_words_equal_brute_force(spark, length):
    rng = random.Random(length)
    rows = corpus(rng, length)
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, chunk string")
    assert result(df, length, chunk_bytes=2000) == removal(rows, length)
    assert passages.remove_passages(df.limit(0), length).count() == 0


def test_small_shards_and_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHARD_PIECES", 5)
    monkeypatch.setattr(passages, "MANY_CHUNKS", 1)
    monkeypatch.setattr(passages, "HOT_PASSAGES", 3)
    monkeypatch.setattr(passages, "SLICE", 700)
    rows = corpus(random.Random(3), 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, 12, chunk_bytes=4000) == removal(rows, 12)


def test_very_long_text_and_one_passage_in_many(spark):
    rng = random.Random(6)
    shared = [f"s{rng.randrange(50)}" for _ in range(70)]
    rows = [(i, " ".join([f"p{i}x{j}" for j in range(9)] + shared + [f"q{i}"])) for i in range(400)]
    long = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    rows += [(900, " ".join(long)), (901, " ".join(long[10_000:25_000] + shared))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, 50) == removal(rows, 50)
