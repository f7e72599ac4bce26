"""Token counts and packing against the tokenizers library and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from panelmill.llm import bpe, packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "Hello, world's  end\n\n  x", "<|endoftext|>a<|endoftext|><|endoftext|>", "<|endoftex", "été ñandú ß  ", "日本語 カタカナ 한국어",
    "՘ unassigned \U00010450 rare", "x" * 5000, "1234567890" * 300, "a b c　d\x85e\x1cf", "'s 't 'RE don't I'll", "\t\n \r\n  tail   ",
    " ".join(f"w{i}" for i in range(3000)), "é ​ zero", "Hello, world's  end\n\n  x",
]


def library(text):
    return bpe.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def test_code_points_outside_the_escape_class_agree():
    count = bpe.counter(PATH)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and not bpe.OTHER.search(chr(c)):
            text = f"a{chr(c)}1 {chr(c)} .{chr(c)}"
            ids = library(text)
            assert ids == bpe.ids(PATH, text).tolist() and len(ids) == count(text), hex(c)


def test_proven_strings_are_one_token():
    proven = sorted(bpe.whole_tokens(PATH))
    assert len(proven) > 40_000
    assert all(len(library(s)) == 1 for s in random.Random(1).sample(proven, 2000))


def test_counts(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, PATH).collect()}
    assert got == {i: len(library(t)) for i, t in enumerate(TEXTS)}
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("limit", [7, 64, 2048])
def test_packing_round_trip(spark, limit):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "no id", 0), (3, "a", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset long")
    got = packing.pack(df, PATH, limit, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= limit and zlib.crc32(r["ids"]) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], ids.tolist()))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(TEXTS):
        want = [*library(t), 0]
        copies = 2 if i == 3 else 1
        parts = sorted(pieces[i], key=lambda p: p[0])[::copies]
        assert [x for p in parts for x in p[2]] == want
        assert [p[1] for p in parts] == [sum(len(q[2]) for q in parts[:k]) for k in range(len(parts))]
        assert all(len(p[2]) == limit for p in parts[1:])
    assert len(pieces[3]) == 2 and pieces[None]
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    assert packing.pack(df.limit(0), PATH, limit).count() == 0


def test_plan_fills_better_than_first_fit():
    rng = random.Random(3)
    counts = {}
    for _ in range(4000):
        x = min(2048, int(rng.lognormvariate(6, 1)) + 1)
        counts[x] = counts.get(x, 0) + 1
    plan = packing.fill_plan(counts, 2048)
    used = {}
    for combo, times in plan:
        assert sum(x * k for x, k in combo) <= 2048
        for x, k in combo:
            used[x] = used.get(x, 0) + k * times
    assert used == counts
    room = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        for i, r in enumerate(room):
            if r >= x:
                room[i] -= x
                break
        else:
            room.append(2048 - x)
    assert sum(t for _, t in plan) <= len(room)


def test_fullest_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        have = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        gap = rng.randint(1, 80)
        sums = {0}
        for x, n in have.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        got = packing.fullest(have, gap)
        assert sum(x * k for x, k in got) == max(s for s in sums if s <= gap)
        assert all(k <= have[x] for x, k in got)
