"""The trie of conversations against a plain one."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from panelmill.llm import turntrie


def brute(rows, rebuilt=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    convs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        convs[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode().split()) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, rebuilt=True, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, blk string")
    turns = turntrie.ordered(df)
    ids = turns.select("conv_id").distinct()
    got = turntrie.prefix_trie(turntrie.with_openings(turns) if rebuilt else turns, ids, **more)
    return sorted((tuple(r) for r in got.collect()), key=str)


def talks(rng):
    rows = []
    for c in range(130):
        if c in (40, 60):  # openings that are absent
            continue
        n = rng.choice([0, 1, 2, 3, 5, 9, 14])
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "a b", "a b  c\n", ""])) for t in range(max(n, 1))]
    base = [("user", f"turn {i} x") for i in range(11)]
    for c in range(200, 240):  # long common starts and copies
        for t, (r, x) in enumerate(base[: rng.choice([4, 8, 11])] + [("bot", rng.choice("pqr"))] * rng.randint(0, 2)):
            rows.append((c, t, r, x))
    rows += [(300, None, None, None), (300, 2, "user", None), (300, 2, "user", "tie"), (300, 2, "user", "tie"), (None, 1, "user", "lost"), (-7, 0, "user", "hi"), (7000000, 5, "bot", "only " * 2000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 4])
def test_trie_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(turntrie, "STRETCH", 2)
    rows = talks(random.Random(8))
    assert trie(spark, rows, block=block) == brute(rows)


def test_long_conversations_without_openings(spark):
    rng = random.Random(3)
    rows = [(c, t, "user", str(t if t < 150 - 30 * c else rng.random())) for c in range(4) for t in range(200)]
    assert trie(spark, rows, rebuilt=False) == brute(rows, rebuilt=False)


def test_empty_and_turnless(spark):
    assert trie(spark, []) == []
    # each loses its only turn to an opening that is absent
    rows = [(c, 0, "user", "x") for c in range(21, 200) if zlib.crc32(str(c).encode()) % 4 and c % 20][:6]
    assert trie(spark, rows) == brute(rows) and len(brute(rows)) == 1
