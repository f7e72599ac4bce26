"""Near-duplicates and repeat removal against brute force."""

import hashlib
import random

import numpy as np
import pytest

from panelmill.llm import neardup, repeats
from panelmill.llm.common import words_of


def shingles(text, size):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def classes(rows, size, percent):
    sets = [(d, shingles(t, size)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (d, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if find(j) == find(i) and sets[j][0] is not None]
        low = min(ids) if ids else None
        out.append((d, len(s), low if s else d, d == (low if s else d)))
    return sorted(out, key=str)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    rng = random.Random(size)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, d = [(None, "null id text of some words"), (900, ""), (901, None), (902, " \n"), (903, "A b"), (904, "a B"), (905, "b a"), (906, "x"), (907, "x")], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([40, 120, 600]))]
        # a hub with copies that are alike through it only, chains, and exact copies
        for _ in range(rng.randint(3, 9)):
            d += 1
            rows.append((d, edited(rng, base, rng.randint(0, max(1, len(base) // 25)))))
        d += 1
        rows.append((d, " ".join(base).upper()))
    rows += [rows[20], (rows[21][0], "same id, other words, " + " ".join(vocabulary[:50]))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, size, percent).collect()), key=str)
    assert got == classes(rows, size, percent)
    assert neardup.near_duplicates(df.limit(0), size, percent).count() == 0


def test_crowded_buckets_are_split_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"v{rng.randrange(300)}" for _ in range(150)]
    rows = [(i, edited(rng, base, 2)) for i in range(70)] + [(500, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, 3, 85).collect()), key=str)
    assert got == classes(rows, 3, 85)


def removal(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, x in raw:
        if d is not None:
            for i in range(len(x) - length + 1):
                s = x[i : i + length]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if d is not None and first[x[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = [i for i in range(len(x)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((d, len(x), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [28, 50])
def test_removed_bytes_equal_brute_force(spark, length):
    rng = random.Random(length)
    pool = ["".join(rng.choice("abcé \n") for _ in range(rng.randint(20, 200))) for _ in range(12)] + ["a" * 300, "ab" * 100]
    rows = [(None, pool[0] * 3), (1000, None), (1001, ""), (1002, "short"), (1003, "x\0" * 60), (1004, "x\0" * 60)]
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randint(1, 150)], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 40)))]
        rows.append((i, "".join(parts)))
    rows += [rows[10], rows[11], (rows[12][0], pool[3] * 2), (2000, rows[15][1]), (2001, rows[15][1])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, chunk string")
    got = []
    for r in repeats.remove_repeats(df, length, with_text=True, chunk_bytes=2000).collect():
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        got.append((r["doc_id"], r["n_bytes"], removed, len(r["spans"]), r["kept_sha256"], bytes(r["kept"])))
    assert sorted(got, key=str) == removal(rows, length)
    assert repeats.remove_repeats(df.limit(0), length).count() == 0


def test_index_is_split_by_anchor(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_WINDOWS", 5)
    rng = random.Random(2)
    pool = ["".join(rng.choice("abc ") for _ in range(120)) for _ in range(5)]
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9))) + rng.choice(pool)[rng.randrange(40) :] + str(i)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], sum(s["end"] - s["start"] for s in r["spans"])) for r in repeats.remove_repeats(df).collect()))
    assert got == sorted((r[0], r[2]) for r in removal(rows, 50))


def test_one_passage_in_many_documents(spark, monkeypatch):
    """More windows under one anchor than an index holds: each document goes on in its own way after a common passage."""
    monkeypatch.setattr(repeats, "SHARD_WINDOWS", 20)
    rng = random.Random(7)
    common = "".join(rng.choice("abcdefgh ") for _ in range(90))
    own = lambda: "".join(rng.choice("uvwxyz") for _ in range(rng.randint(30, 60)))
    rows = [(i, own() + common + own()) for i in range(300)] + [(1000 + i, own() + common[:60] + rng.choice(["p" * 20, "q" * 20]) + own()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], sum(s["end"] - s["start"] for s in r["spans"])) for r in repeats.remove_repeats(df).collect()))
    assert got == sorted((r[0], r[2]) for r in removal(rows, 50))


def test_owners_by_offset_equal_the_index():
    rng = np.random.default_rng(5)
    for symbols in (2, 3):
        windows = rng.integers(97, 97 + symbols, (60, 24)).astype(np.uint8)
        windows[10:30, 4:] = windows[0, 4:]
        windows[40:50, 20:] = repeats.EDGE
        owner = rng.permutation(60)
        # each offset by itself, as strings of one anchor are
        got = repeats.owners_by_offset(windows, owner, 12)
        for i in range(60):
            for at in range(13):
                s = windows[i, at : at + 12]
                same = [owner[k] for k in range(60) if (windows[k, at : at + 12] == s).all()]
                assert got[i, at] == (min(same) if (s != repeats.EDGE).all() else np.iinfo(np.int64).max)
