"""Removal of passages of words that an earlier document holds, found in full-text indexes of shards."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Codes, chunk_of, deal, looked_up, mix, per_process, unpacked, width, written
from .fmindex import FMIndex
from .repeats import slide, whole_groups

#: Words whose least code in a passage names its shard.
GRAM = 8
GOLD = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE = 2 << 20
SHARD_PIECES = 12_000
#: Passages under an anchor that more chunks hold are counted before they go on.
MANY_CHUNKS = 24
#: Distinct passages of one name that go to a shard by themselves; of more, each goes by its own words.
HOT_PASSAGES = 100_000


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Texts side by side as words: codes, and where each text's windows of ``length`` words are."""

    def __init__(self, texts: list[str | None], length: int):
        self.length = length
        self.words = [t.encode().split() if t else [] for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        code = per_process("cased codes", Codes).__getitem__
        self.codes = np.fromiter(map(code, itertools.chain.from_iterable(self.words)), np.uint64, int(self.sizes.sum()))
        many = np.maximum(self.sizes - length + 1, 0)
        #: text and first word of each window
        self.doc = np.repeat(np.arange(len(texts)), many)
        self.at = np.arange(len(self.doc)) + np.repeat(self.starts - (np.cumsum(many) - many), many)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and code of the anchor of each window: the first of its grams with the least code."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n = len(self.codes) - GRAM + 1
        h = np.zeros(n, np.uint64)
        for i in range(GRAM):
            h = mix(h * GOLD + self.codes[i : i + n])
        least = slide(np.arange(n), self.length - GRAM + 1, lambda a, b: np.where(h[b] < h[a], b, a))
        place = least[self.at]
        return place, h[place]

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """Codes of the windows that start at these words."""
        n = len(self.codes)
        done = np.append(np.uint64(0), np.cumsum(self.codes * powers(GOLD, n), dtype=np.uint64))
        return mix((done[at + self.length] - done[at]) * powers(BACK, n)[at]) if n else np.zeros(0, np.uint64)


def text_code(text: str | None) -> tuple[int, int]:
    """A code of 128 bits, in two halves."""
    x = xxhash.xxh3_128_intdigest((text or "").encode())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def sliced(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE or i == len(texts) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def spread(keys: tuple[np.ndarray, ...], low: np.ndarray, high: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct keys with their least low and highest high."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    if not len(first):
        return keys, low, high
    return [k[first] for k in keys], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def remove_passages(docs: DataFrame, length: int = 50, with_text: bool = False, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Words to remove from each document of ``docs`` (doc_id long, text): (doc_id, n_words, spans, kept_sha256[, kept]).

    Words stand between ASCII white space. A word is removed when a passage of ``length`` words that covers it also starts in a document with
    a smaller id. Passages are judged on the input and never cross documents. ``spans`` lists the maximal removed runs as (start, end) in words;
    ``kept`` is what remains, joined by single spaces.

    1. A passage is named by its anchor, the gram of GRAM words with the least code in it. One pass counts which anchors two texts hold,
    and which texts two documents hold; of equal texts only the first document's goes on, the others lose all passages. 2. Passages under
    an anchor that many chunks hold are counted by a code of their words; a passage that a single text holds goes no further. 3. What is left goes, as pieces of
    neighbouring passages under one anchor, to shards by anchor: equal passages meet. Each shard builds a compressed full-text index
    (``FMIndex``) of its distinct pieces' words and streams the pieces through it; a match of ``length`` words or more has the smallest document of its
    interval as owner. 4. Each chunk of documents gets the owners of its pieces back. An anchor with more than HOT_PASSAGES distinct passages is
    dealt out by the passages' own codes. Codes only choose candidates: what is removed is decided on words.

    A null text has no words, nor has an empty one; texts with fewer than ``length`` words lose nothing. A document without an id has no
    order: it loses nothing and takes nothing from others. Rows with equal ids do not take from each other. Texts of any length are
    taken whole. An empty table gives no rows; columns besides doc_id and text are left out, whatever their names.
    """
    if length < GRAM + 2:
        raise ValueError(f"passages must have {GRAM + 2} words or more")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(width(docs), -(-total // chunk_bytes))
    parts = max(width(docs), -(-total // (16 << 20)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (copy, h, chunk, low, high): texts with their first and last id, anchors with their least and highest text."""
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            everything = batch.column(1).to_pylist()
            for a, b in sliced(everything):
                texts, ids, chunk = everything[a:b], batch.column(0).to_numpy()[a:b], batch.column(2).to_numpy()[a:b].astype(np.int64)
                code, half = np.array([text_code(t) for t in texts], np.int64).reshape(-1, 2).T
                words = Words(texts, length)
                place, h = words.anchors()
                new = np.append(True, place[1:] != place[:-1])[: len(place)]
                d, h = words.doc[new], h[new].view(np.int64)
                for copy, keys, low in ((False, (h, np.zeros(len(h), np.int64), chunk[d]), code[d]), (True, (code, half, chunk), ids)):
                    (k, k2, c), low, high = spread(keys, low, low)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), copy)), pa.array(k), pa.array(k2), pa.array(c.astype(np.int32)), pa.array(low), pa.array(high)], ["copy", "h", "h2", "chunk", "low", "high"])

    named = own.withColumn("chunk", chunk_of(chunks)).mapInArrow(name, "copy boolean, h long, h2 long, chunk int, low long, high long")
    # a chunk's rows of a key are one before the key's rows meet, so a window holds a row for each chunk at most
    named = named.groupBy("copy", "h", "h2", "chunk").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    one = Window.partitionBy("copy", "h", "h2")
    asked = named.select("copy", "h", "h2", F.col("chunk").alias("of"), F.min("low").over(one).alias("low"), F.max("high").over(one).alias("high"), (F.count("*").over(one) > MANY_CHUNKS).alias("many"))
    asked = written(asked.where("low < high").drop("high"))
    dealt = deal(own, chunks)

    def firsts(copies: pa.Table) -> dict[tuple[int, int], int]:
        """The first document of each text that several hold."""
        return dict(zip(zip(copies["h"].to_pylist(), copies["h2"].to_pylist(), strict=True), copies["low"].to_pylist(), strict=True))

    class Chunk:
        """The documents of a chunk; of equal texts the first document's, unless another chunk holds it."""

        def __init__(self, mine: pa.Table, theirs: pa.Table):
            self.rows = unpacked(mine)
            self.ids, self.texts = self.rows["doc_id"].to_pylist(), self.rows["text"].to_pylist()
            self.code = [text_code(t) for t in self.texts]
            copies, anchors = theirs.filter(theirs["copy"]), theirs.filter(pa.compute.invert(theirs["copy"])).sort_by("h")
            self.first = firsts(copies)
            self.shared, self.many = anchors["h"].to_numpy(), anchors["many"].to_numpy()

        def leads(self) -> list[int]:
            """Documents to look at: one for each text."""
            seen, out = set(), []
            for i, (d, c) in enumerate(zip(self.ids, self.code, strict=True)):
                if d is not None and c not in seen and self.first.get(c, d) >= d:
                    seen.add(c)
                    out.append(i)
            return out

        def passages(self, crowded: bool = False) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            """Windows under shared anchors, by slices: words, documents, first words, anchors' places and codes, and which anchors many
            chunks hold (only those if ``crowded``)."""
            lead = self.leads() if len(self.shared) and (self.many.any() or not crowded) else []
            texts = [self.texts[i] for i in lead]
            for a, b in sliced(texts):
                words = Words(texts[a:b], length)
                place, h = words.anchors()
                h = h.view(np.int64)
                row = np.minimum(np.searchsorted(self.shared, h), len(self.shared) - 1)
                hit = (self.shared[row] == h) & (self.many[row] | (not crowded))
                yield words, np.array(lead[a:b]), words.at[hit], place[hit], h[hit], self.many[row[hit]]

    def count(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """Distinct passages of a chunk under anchors that many chunks hold, with the least and highest text that has each."""
        chunk, held = mine["chunk"][0].as_py() if mine.num_rows else 0, Chunk(mine, theirs)
        out = []
        for words, lead, at, _, h, _ in held.passages(crowded=True):
            code = np.array([held.code[i][0] for i in lead], np.int64)[np.searchsorted(words.starts, at, "right") - 1] if len(at) else np.zeros(0, np.int64)
            (w, a), low, high = spread((words.hashes(at).view(np.int64), h), code, code)
            out.append(pa.table({"w": w, "anchor": a, "chunk": pa.array(np.full(len(w), chunk), pa.int32()), "low": low, "high": high}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in (("w", pa.int64()), ("anchor", pa.int64()), ("chunk", pa.int32()), ("low", pa.int64()), ("high", pa.int64()))})

    counted = dealt.cogroup(asked.groupBy("of")).applyInArrow(count, "w long, anchor long, chunk int, low long, high long")
    one = Window.partitionBy("w")
    again = counted.select("w", "anchor", F.col("chunk").alias("of"), F.min("low").over(one).alias("low"), F.max("high").over(one).alias("high")).where("low < high")
    again = written(again.select("of", "w", "anchor"))
    crowd = again.groupBy("anchor").agg(F.approx_count_distinct("w").alias("n")).where(F.col("n") > HOT_PASSAGES).select("anchor", F.lit(True).alias("hot"))
    again = looked_up(again, written(crowd), ["anchor"], ["w"]).select("of", "w", F.coalesce("hot", F.lit(False)).alias("hot"))
    none = lambda t: F.lit(None).cast(t)
    # what a chunk asked for in the first round goes with it into the second
    wanted = again.select("of", none("boolean").alias("copy"), F.col("w").alias("h"), none("long").alias("h2"), none("long").alias("low"), none("boolean").alias("many"), "hot").unionByName(
        asked.withColumn("hot", none("boolean"))
    )

    def cut(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """Pieces: neighbouring passages that two texts hold, under one anchor, with where the chunk has them."""
        chunk = mine["chunk"][0].as_py() if mine.num_rows else 0
        first = theirs["copy"].is_valid()
        held, windows = Chunk(mine, theirs.filter(first)), theirs.filter(pa.compute.invert(first)).sort_by("h")
        w, hot = windows["h"].to_numpy(), windows["hot"].to_numpy()
        if not len(w):
            w, hot = np.zeros(1, np.int64), np.zeros(1, bool)
        pieces: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        for words, lead, at, place, h, many in held.passages():
            code = words.hashes(at).view(np.int64)
            row = np.minimum(np.searchsorted(w, code), len(w) - 1)
            known = w[row] == code
            hit = known | ~many
            at, place, h, code, alone = at[hit], place[hit], h[hit], code[hit], (hot[row] & known & many)[hit]
            doc = np.searchsorted(words.starts, at, "right") - 1
            key = np.where(alone, mix(code.view(np.uint64)).view(np.int64), h)
            new = np.append(True, (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | alone[1:] | alone[:-1])[: len(at)]
            start = np.flatnonzero(new)
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(at)], strict=False):
                d = int(doc[a])
                lo = int(at[a] - words.starts[d])
                data = b" ".join(words.words[d][lo : lo + b - a - 1 + length])
                pieces.setdefault((int(key[a]), data), []).append((held.ids[lead[d]], held.code[lead[d]][0], lo))
        low = [min(x)[0] for x in pieces.values()]
        refs = [np.array([y[1:] for y in x], np.int64).tobytes() for x in pieces.values()]
        return pa.table({
            "key": pa.array([k for k, _ in pieces], pa.int64()), "words": pa.array([x for _, x in pieces], pa.binary()), "low": pa.array(low, pa.int64()),
            "chunk": pa.array([chunk] * len(pieces), pa.int32()), "refs": pa.array(refs, pa.binary()),
        })

    pieces = dealt.cogroup(wanted.groupBy("of")).applyInArrow(cut, "key long, words binary, low long, chunk int, refs binary")
    pieces = pieces.repartition(parts, "key").sortWithinPartitions("key", "words")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, SHARD_PIECES):
            number: dict[bytes, int] = {}
            row, low, texts = [], [], []
            last = None
            for data, d in zip(t.column(1).to_pylist(), t.column(2).to_pylist(), strict=True):
                if data != last:
                    last = data
                    texts.append(np.array([number.setdefault(x, len(number)) for x in data.split(b" ")], np.int64))
                    low.append(d)
                low[-1] = min(low[-1], d)
                row.append(len(low) - 1)
            _, least = FMIndex(texts, np.array(low, np.int64), len(number), length).matches(texts)
            owners = [x[: len(x) - length + 1].tobytes() for x in least]
            yield pa.RecordBatch.from_arrays([t.column(3), t.column(4), pa.array([owners[i] for i in row], pa.binary())], ["of", "refs", "owners"])

    found = pieces.mapInArrow(index, "of int, refs binary, owners binary")
    answers = asked.where("copy").select("of", "h", "h2", "low", none("binary").alias("refs"), none("binary").alias("owners")).unionByName(
        found.select("of", none("long").alias("h"), none("long").alias("h2"), none("long").alias("low"), "refs", "owners")
    )

    def remove(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        rows = unpacked(mine)
        ids, texts = rows["doc_id"].to_pylist(), rows["text"].to_pylist()
        copy = theirs["h"].is_valid()
        first, found = firsts(theirs.filter(copy)), theirs.filter(pa.compute.invert(copy))
        owners: dict[int, list[tuple[int, bytes]]] = {}
        for refs, best in zip(found["refs"].to_pylist(), found["owners"].to_pylist(), strict=True):
            for code, lo in np.frombuffer(refs, np.int64).reshape(-1, 2).tolist():
                owners.setdefault(code, []).append((lo, best))
        sizes, spans, digests, kept = [], [], [], []
        for d, text in zip(ids, texts, strict=True):
            words = text.encode().split() if text else []
            gone = np.zeros(len(words), bool)
            code = text_code(text)
            if d is not None and len(words) >= length:
                if first.get(code, d) < d:
                    gone[:] = True
                elif code[0] in owners:
                    turn = np.zeros(len(words) + 1, np.int32)
                    for lo, best in owners[code[0]]:
                        at = np.flatnonzero(np.frombuffer(best, np.int64) < d) + lo
                        np.add.at(turn, at, 1), np.add.at(turn, at + length, -1)
                    gone = np.cumsum(turn[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            rest = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g] if len(edge) else words)
            sizes.append(len(words)), digests.append(hashlib.sha256(rest).hexdigest())
            if with_text:
                kept.append(rest.decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = {"doc_id": rows["doc_id"], "n_words": pa.array(sizes, pa.int64()), "spans": pa.array(spans, kind), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.string())} if with_text else {}))

    schema = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept string" * with_text
    return dealt.cogroup(answers.groupBy("of")).applyInArrow(remove, schema)
