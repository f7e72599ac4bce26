"""Cross-tokenizer alignment against a brute-force count of overlapping bytes."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelmill.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}
    return t, char, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(ids, pieces, text):
    ends, at = [], 0
    for p in pieces:
        at += len(p)
        ends.append(at)
    return list(zip(ids, [0, *ends], ends)) if b"".join(pieces) == (" " + text).encode() else None


def brute(libraries, rows):
    t, char, sp = libraries
    links, out, texts = Counter(), [], {}
    for i, (d, text) in enumerate(rows):
        a = b = None
        if text:
            e = t.encode(" " + text, add_special_tokens=False)
            a = spans(e.ids, [bytes(char[c] for c in x) for x in e.tokens], text)
            ids = sp.encode(text)
            raw = [sp.id_to_piece(x) for x in ids]
            b = spans(ids, [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(ids, raw)], text)
        if not a or not b:
            out.append([d, 0, 0, 0, [], "", ""])
            continue
        mine = [(x, y) for x, s, e_ in a for y, u, v in b if s < v and u < e_] if len(a) < 400 else sweep(a, b)
        links.update(mine)
        both = sorted({e_ for _, _, e_ in a} & {v for _, _, v in b})
        lo, groups = 0, []
        for hi in both:
            groups.append(",".join(str(x) for x, s, _ in a if lo <= s < hi) + "|" + ",".join(str(x) for x, s, _ in b if lo <= s < hi))
            lo = hi
        s = ";".join(groups)
        out.append([d, len(a), len(b), len(both), mine, hashlib.sha256(s.encode()).hexdigest(), s])
    top = {}
    for (x, y), n in links.items():
        top[y] = max(top.get(y, 0), n)
    return sorted(((d, na, nb, g, len(m), sum(links[p] == top[p[1]] for p in m), sum(links[p] for p in m), h, s) for d, na, nb, g, m, h, s in out), key=str)


def sweep(a, b):
    out, j = [], 0
    for x, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((x, b[k][0]))
            k += 1
    return out


def texts():
    rng = random.Random(4)
    words = ["the", "Über", "naïve", "日本語", "🦙🦙", "é", "don't", "x1234", "<|endoftext|>", "<s>", "<0x41>", "ﬁne", "①", "a,b;c", "\u200b", "คน", "힣", "()", "\r", "\u3000", "--"]
    out = ["", None, " ", "\n", "  \n ", "a", " lead", "trail ", "two  spaces\n\nlines \n x", "tab\there", "nbsp x", "sign ▁ x", "▁", "a\x00b", "x" * 300, "日" * 50, "end\n"]
    for _ in range(60):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "", " \n"]) for _ in range(rng.randint(1, 60))))
    return out


def test_alignment_equals_brute_force(spark, libraries, monkeypatch):
    monkeypatch.setattr(align, "PART", 200)
    rows = list(enumerate(texts())) + [(3, "the the Über"), (3, "the the Über"), (None, "no id 日本")]
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, slice string, n_a int")
    got = align.align(df, A, B, with_groups=True, slice_bytes=500)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(libraries, rows)
    assert align.align(df.limit(0), A, B).count() == 0


def test_very_long_text(spark, libraries):
    rng = random.Random(5)
    long = " ".join(rng.choice(["ab", "Über", "日本", "cd\n", "naïveté"]) for _ in range(60_000))
    rows = [(1, long), (2, "日本 ab"), (3, "a" * 20_000)]
    got = align.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    want = {r[0]: r for r in short_groups(libraries, rows)}
    for r in got:
        assert tuple(r)[1:7] == want[r["doc_id"]][1:]


def short_groups(libraries, rows):
    t, char, sp = libraries
    links, held = Counter(), []
    for d, text in rows:
        e = t.encode(" " + text, add_special_tokens=False)
        a = spans(e.ids, [bytes(char[c] for c in x) for x in e.tokens], text)
        ids = sp.encode(text)
        b = spans(ids, [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in ids], text)
        mine = sweep(a, b)
        links.update(mine)
        held.append((d, len(a), len(b), len({x[2] for x in a} & {x[2] for x in b}), mine))
    top = {}
    for (_, y), n in links.items():
        top[y] = max(top.get(y, 0), n)
    return [(d, na, nb, g, len(m), sum(links[p] == top[p[1]] for p in m), sum(links[p] for p in m)) for d, na, nb, g, m in held]
