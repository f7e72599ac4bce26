"""Top-k search and license scans against brute force."""

import math
import random

from pyspark.sql import functions as F

from panelmill.llm import licenses, topk


def brute(rows, queries, k):
    out = set()
    for qid, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid and len(v) == len(q))
        out |= {(qid, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-3, -1, 0, 0, 2, 500]) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(9)] + [(5000, [1] * 3), (5001, [2] * 3), (6000, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows] + [(None, [1] * 6, "x"), (7000, None, "x")], "vec_id long, v array<long>, dim string")
    queries = [(i, v) for i, v in rows if i % 20 == 0]
    got = topk.top_k(df.where("vec_id % 20 = 0"), df, 5, query_block=8, shard_rows=64)
    assert {tuple(r) for r in got.collect()} == brute(rows, queries, 5)
    assert topk.top_k(df.limit(0), df, 5).count() == 0 and topk.top_k(df, df.limit(0), 5).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [(1 << 27) + i, -(1 << 26) + 3 * i]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    assert {tuple(r) for r in topk.top_k(df, df, 3).collect()} == brute(rows, rows, 3)


def test_scaling(spark):
    df = spark.createDataFrame([(1, [0.1, -0.1]), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, None), (5, [float("inf")]), (6, [])], "vec_id long, e array<float>")
    got = {r["vec_id"]: r["v"] for r in df.select("vec_id", topk.scaled(F.col("e")).alias("v")).collect()}
    assert got == {1: [25, -26], 2: None, 3: None, 4: None, 5: None, 6: []}


def dice(text, template):
    a, b = set(licenses.bigrams_in(text)), set(licenses.bigrams_in(template))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "one", "\n\n", "Released under the MIT License.\n" * 40, "x " * 30_000]
    for _ in range(150):
        lines = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(list(licenses.NOTICES.values())).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["foo", "the", "License,", "4.0"])
            lines.append(rng.choice([" ", "  ", "\t"]).join(words))
        texts.append("\n".join(lines))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, dice int, _bigrams int")
    for r in licenses.scan_licenses(df).collect():
        text = texts[r["doc_id"]] or ""
        units = [(n, x) for n, x in enumerate(text.split("\n"))] + ([(-1, text)] if "\n" in text else [])
        want = {(name, n, round(dice(x, t), 9)) for n, x in units for name, t in licenses.NOTICES.items() if dice(x, t) >= 0.8}
        assert {(m["license"], m["line"], round(m["dice"], 9)) for m in r["matches"]} == want
        assert r["n_licenses"] == len(want) and (r["dice"] is None) == (not want)
        if want:
            best = max(d for *_, d in want)
            assert math.isclose(r["dice"], best, rel_tol=1e-8) and r["license"] == min(n for n, _, d in want if d == best)
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert {r["n_licenses"] for r in licenses.scan_licenses(df, {}).collect()} == {0}
