"""Quality rules: counts inside a text, and lines that many documents of a host share."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, WORD, free_name, written

SYMBOLS = re.compile(r"[#*$%&|<>]")
GAPS = re.compile(r"[ \t-\r]")
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - len(GAPS.findall(text)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat_words(words)


def text_lines(text: str | None) -> tuple[int, int, list[int], list[int]]:
    """A 128-bit name of a text's normalised lines, then their codes (those of ``line_code``) and words, in order."""
    lines = [b" ".join(x.split()).lower() for x in (text or "").encode("utf-8", "replace").split(b"\n") if x.strip()]
    a, b = np.frombuffer(xxhash.xxh3_128_digest(b"\n".join(lines)), np.int64)
    codes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in lines), np.uint64, len(lines))
    return int(a), int(b), codes.view(np.int64).tolist(), [x.count(b" ") + 1 for x in lines]


def normal(line: Column) -> Column:
    """A line without outer white space, inner runs as one space, A-Z in lower case."""
    return F.translate(F.regexp_replace(F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+", " "), UPPER, LOWER)


def line_code(line: Column) -> Column:
    return F.xxhash64(normal(line))


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    max_share: float = 0.05,
    min_docs: int = 10,
    min_words: int = 50,
    max_repeat: float = 0.5,
    min_left: float = 0.3,
) -> DataFrame:
    """Add the counts of each text, base_failed, n_frequent_words, kept and clean_text.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat`` of them in repeated three-word windows.
    A line is frequent when more than ``min_docs`` documents of its host hold it and more than ``max_share`` of the host's
    documents; documents are distinct contents (hashed lines in order), so exact copies count once and do not condemn
    each other. ``clean_text`` has the frequent lines removed. A document is depleted when fewer than ``min_words`` words are
    left, or less than ``min_left`` of its words; ``kept`` is false for base failures and depleted documents.

    Copies are merged before lines are exploded, line counts combine per task, and what comes back to a document is a sum for each
    content, so a host, line or copied text with a third of all rows is no single task's work. ``clean_text`` is a row-local
    expression: a caller that does not select it moves no text.

    A null text counts as empty: it fails, and clean_text is null. A null host is a host of its own. Repeated rows get the same
    verdict. An empty table gives no rows. Other columns stay; columns with the names of the results are replaced.
    """
    lines, content, words, total, found, gone, who, body, k1, k2 = free_name(docs, "_lines", "_content", "_words", "_total", "_found", "_gone", "_host", "_c", "_k1", "_k2")
    column = F.col(f"`{text}`")
    names = [c.split()[0] for c in COUNTS.split(", ")]

    # texts leave a batch one by one: a second copy of all of them would be most of a worker's memory
    @F.arrow_udf(COUNTS)
    def counted(texts: pa.Array) -> pa.Array:
        rows = [text_counts(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)

    @F.arrow_udf("a long, b long, h array<long>, n array<long>")
    def lined(texts: pa.Array) -> pa.Array:
        rows = [text_lines(t.as_py()) for t in texts]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["a", "b", "h", "n"])

    base = docs.withColumn(body, counted(column))
    base = base.withColumns({n: F.col(f"{body}.{n}") for n in names}).drop(body)
    base = base.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * max_repeat))

    host_key = F.coalesce(F.concat(F.lit("="), F.col(f"`{host}`").cast("string")), F.lit("null"))
    name = F.struct(F.col(f"{lines}.a"), F.col(f"{lines}.b"))
    keyed = docs.select(host_key.alias(who), lined(column).alias(lines))
    texts = keyed.groupBy(who, name.alias(content)).agg(F.first(F.arrays_zip(F.col(f"{lines}.h").alias("h"), F.col(f"{lines}.n").alias("n"))).alias(lines))
    texts = written(texts)
    hosts = texts.groupBy(who).agg(F.count("*").alias(total))
    each = texts.select(who, content, F.explode(lines).alias("x")).groupBy(who, content, F.col("x.h").alias("h")).agg(F.sum("x.n").alias(words))
    share = each.groupBy(who, "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs).join(hosts, who)
    share = share.where(F.col("n") > F.col(total) * max_share).select(who, "h")
    hit = each.join(share, [who, "h"]).groupBy(who, content).agg(F.sum(words).alias(gone), F.collect_set("h").alias(found))

    left = base.withColumns({who: host_key, lines: lined(column)}).withColumn(content, name).drop(lines)
    hit = hit.withColumnsRenamed({who: k1, content: k2})
    out = left.join(hit, (F.col(who) == F.col(k1)) & (F.col(content) == F.col(k2)), "left")
    rest = F.col("n_words") - F.coalesce(F.col(gone), F.lit(0))
    out = out.withColumn("n_frequent_words", F.coalesce(F.col(gone), F.lit(0)))
    out = out.withColumn("kept", ~F.col("base_failed") & (rest >= min_words) & (rest >= F.col("n_words") * min_left))
    held = F.filter(F.split(column, "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(F.col(found), line_code(x))))
    out = out.withColumn("clean_text", F.when(F.col(found).isNull(), column).otherwise(F.array_join(held, "\n")))
    return out.drop(who, content, gone, found, k1, k2)
