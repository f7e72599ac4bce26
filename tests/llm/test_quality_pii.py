"""Quality rules and pseudonyms against plain Python."""

import datetime
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from panelmill.llm import pii, quality
from panelmill.llm.common import WORD


def verdicts(rows, max_share, min_docs, min_words, max_repeat, min_left):
    normal = lambda x: " ".join(x.encode().split().__iter__().__class__ and [w.decode() for w in x.encode().lower().split()])
    contents, out = {}, []
    for host, text in rows:
        lines = tuple(normal(x) for x in (text or "").split("\n") if re.search(WORD, x))
        contents.setdefault(host, set()).add(lines)
    common = {}
    for host, texts in contents.items():
        seen = Counter(x for t in texts for x in set(t))
        common[host] = {x for x, n in seen.items() if n > min_docs and n > len(texts) * max_share}
    for host, text in rows:
        text = text or ""
        words = re.findall(WORD, text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        left = sum(len(re.findall(WORD, x)) for x in lines if normal(x) not in common[host])
        failed = len(words) < min_words or len(covered) > max_repeat * len(words)
        kept = not failed and left >= min_words and left >= min_left * len(words)
        clean = "\n".join(x for x in text.split("\n") if not (re.search(WORD, x) and normal(x) in common[host]))
        counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        out.append((counts, failed, kept, clean))
    return out


def test_rules_equal_brute_force(spark):
    rng = random.Random(1)
    pool = [" ".join(rng.choice(["Aa", "b", "é", "d#", "*", "ß|"]) for _ in range(rng.randint(1, 8))) for _ in range(25)]
    rows = [(None, None), ("h1", None), ("h1", ""), ("h1", " \t\n\x0b"), (None, "a b c " * 50), ("h2", "w " * 40_000)]
    for i in range(150):
        lines = [rng.choice([rng.choice(pool), f"own line {i} {rng.random()} x y z"]) for _ in range(rng.randint(1, 12))]
        rows.append((rng.choice(["h1", "h1", "h2", "null", None]), rng.choice(["\n", " \n", "\n\n"]).join(lines)))
    rows += [rows[10]] * 20
    args = {"max_share": 0.1, "min_docs": 3, "min_words": 8, "max_repeat": 0.5, "min_left": 0.4}
    df = spark.createDataFrame([(i, h, t, "x", 9) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string, kept string, _total int")
    got = {r["doc_id"]: r for r in quality.quality_rules(df, **args).collect()}
    for i, (counts, failed, kept, clean) in enumerate(verdicts(rows, **args)):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts, i
        assert (r["base_failed"], r["kept"], r["clean_text"] or "") == (failed, kept, clean), i
        assert r["_total"] == 9
    assert len(got) == len(rows) and quality.quality_rules(df.limit(0)).count() == 0


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def turned(spark, texts, key="k", back=False):
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in enumerate(texts)], "doc_id long, text string, n_dates string, _found string")
    rows = sorted(pii.pseudonymise(df, key, back=back).collect(), key=lambda r: r["doc_id"])
    assert all(r["_found"] == "d" for r in rows)
    return [r["text"] for r in rows], [(r["n_numbers"], r["n_dates"], r["n_names"]) for r in rows]


def test_numbers_keep_their_format_and_turn_back(spark):
    texts = ["card 4111 1111-1111 1111.", "4111111111111111", "also 378282246310005 end", "+1 (017) 555-7713 and +1 017 555 7713", "ip 144.137.247.239, 144.137.247.239",
             "ssn 123-45-6789", "on 2024-02-29 or 29.02.2024 or 02/29/2024", "5555-5555-5555-4444"]
    out, counts = turned(spark, texts)
    for a, b in zip(texts, out):
        assert a != b and re.sub(r"\d+", "9", re.sub(r"\d", "9", a)) == re.sub(r"\d+", "9", re.sub(r"\d", "9", b))
    assert luhn(re.sub(r"\D", "", out[0])) == 0 and re.sub(r"\D", "", out[0]) == out[1]
    assert luhn(re.sub(r"\D", "", out[2])) == luhn(re.sub(r"\D", "", out[7])) == 0
    phones = re.findall(r"\+1 (.*?)(?: and|$)", out[3])
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and phones[0][0] == "("
    a, b = re.findall(r"[\d.]{7,}\d", out[4])
    assert a == b and all(int(x) < 256 for x in a.split("."))
    days = re.findall(r"\d{4}-\d\d-\d\d", out[6]) + re.findall(r"\d\d[./]\d\d[./]\d{4}", out[6])
    assert len({datetime.date.fromisoformat(days[0]), datetime.datetime.strptime(days[1], "%d.%m.%Y").date(), datetime.datetime.strptime(days[2], "%m/%d/%Y").date()}) == 1
    assert counts[0] == (1, 0, 0) and counts[3] == (2, 0, 0) and counts[6] == (0, 3, 0)
    assert turned(spark, out, back=True)[0] == texts
    assert turned(spark, texts, "other")[0] != out


def test_national_phones_days_first_and_social_ranges(spark):
    days = [(datetime.date(1800, 1, 1) + datetime.timedelta(d)) for d in range(0, 146_097, 11)]
    days = [d.strftime("%d/%m/%Y") for d in days if d.day > 12] + ["31/12/2199", "13/01/1800"]
    valid = [f"{a:03d}-{b:02d}-{c:04d}" for a in (1, 123, 665, 667, 899) for b in (1, 45, 99) for c in (1, 6789, 9999)]
    odd = ["000-12-3456", "666-12-3456", "901-12-3456", "123-00-4567", "123-45-0000", "30/02/2020", "31/13/2020", "32/12/2020"]
    phones = ["(013) 555-9871", "013-555-9871", "call 013.555.9871 2 times.", "+1 (013) 555-9871"]
    texts = phones + odd + valid + sorted(set(days))
    out, counts = turned(spark, texts)
    assert out[4:12] == odd and all(a != b for a, b in zip(texts[:4] + texts[40:], out[:4] + out[40:]))
    assert len({re.sub(r"\D", "", x)[-11:][:10] if "call" in x else re.sub(r"\D", "", x)[-10:] for x in out[:4]}) == 1
    assert all(n == (1, 0, 0) for n in counts[:4]) and out[2].endswith(" 2 times.") and out[0][0] == "("
    assert all(datetime.datetime.strptime(x, "%d/%m/%Y").day > 12 for x in out[12 + len(valid):]) and len(set(out)) == len(set(texts))
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in out[12:12 + len(valid)])
    assert turned(spark, out, back=True)[0] == texts


def test_only_valid_cards_and_one_pseudonym_for_a_day(spark):
    rng = random.Random(8)
    runs = [str(rng.randrange(10 ** (n - 1), 10**n)) for n in range(11, 23) for _ in range(25)] + ["1700000000000", "9807915762804490"]
    out, counts = turned(spark, runs)
    for a, b, n in zip(runs, out, counts):
        card = 13 <= len(a) <= 19 and luhn(a) == 0
        assert (a != b) == card and n == (int(card), 0, 0) and len(a) == len(b) and (not card or luhn(b) == 0)
    assert sum(a != b for a, b in zip(runs, out)) > 5
    beside, counts = turned(spark, ["4111 1111 1111 1111 2 times", "12 4111 1111 1111 1111", "4111 1111 1111 1112 2", "4111111111111111"])
    assert beside[0][19:] == " 2 times" and beside[1][:3] == "12 " and beside[2] == "4111 1111 1111 1112 2"
    assert {re.sub(r"\D", "", x) for x in (beside[0][:19], beside[1][3:], beside[3])} == {beside[3]} and [c[0] for c in counts] == [1, 1, 0, 1]
    days = [datetime.date(1800, 1, 1) + datetime.timedelta(rng.randrange(146_097)) for _ in range(200)] + [datetime.date(2020, 12, 31)]
    late = [d for d in days if d.day > 12]
    out, _ = turned(spark, [d.strftime(f) for f in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y") for d in late] + [d.strftime("%d/%m/%Y") for d in late])
    read = [datetime.datetime.strptime(x, f).date() for f, part in zip(("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"), range(4)) for x in out[part * len(late):(part + 1) * len(late)]]
    assert read[:len(late)] * 4 == read and all(d.day > 12 for d in read)
    phones, counts = turned(spark, ["020 7946 0958", "call 0161 496 0000.", "10 7946 0958", "020 7946 0958 1"])
    assert phones[0] != "020 7946 0958" and [c[0] for c in counts] == [1, 1, 0, 0]


def test_cards_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null")
    for r in docs.join(pii.pseudonymise(docs, "k").withColumnRenamed("text", "new"), "doc_id").collect():
        for m in re.finditer(r"(?<![\d-])(?<!\d )\d{13,19}(?![ -]?\d)", r["text"]):
            assert (m[0] in r["new"]) == (luhn(m[0]) != 0), m[0]


def test_permutations_are_one_to_one(spark):
    days = [(datetime.date(1800, 1, 1) + datetime.timedelta(d)).isoformat() for d in range(0, 146_097, 37)]
    out, _ = turned(spark, days)
    assert len(set(out)) == len(days) and all(1800 <= datetime.date.fromisoformat(d).year < 2200 for d in out)
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = {r[0] for r in df.select(pii.number(F.col("d"), "k", "t").alias("n")).collect()}
    assert got == {f"{i:03d}" for i in range(1000)}


def test_names_and_what_is_left_alone(spark):
    texts = [None, "", "no data at all", "und.34@mail7.example.com; UND.34@mail7.example.com", "token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\"",
             "300.1.1.1 and 2023-02-30 and 12345 and 1.2.3 and v1.2.3.4.5", "1" * 40, "a" * 200_000 + "@", "9" * 200_000, "@@@ .@. a@b", "1750-01-01"]
    out, counts = turned(spark, texts)
    assert out[:3] == texts[:3] and out[5:] == texts[5:] and counts[0] == (0, 0, 0)
    a, b = out[3].split("; ")
    assert a == b and a.endswith("@mail7.example.com") and "und" not in a
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[4]) and out[4] != texts[4]
    assert spark.createDataFrame([], "doc_id long, text string").transform(lambda d: pii.pseudonymise(d, "k")).count() == 0
