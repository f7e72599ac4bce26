"""Removal of long repeats by a run-length index over the places where texts share bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_of, deal, mix, unpacked, width

ANCHOR = 20
GOLD = np.uint64(0x9E3779B97F4A7C15)
EDGE = 0xFF  # never a byte of UTF-8
SLICE = 1 << 20
SHARD_WINDOWS = 12_000
SETTLE_ROWS = 200_000
LOW48 = np.uint64((1 << 48) - 1)


def words8(a: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a big-endian number."""
    x = a.astype(np.uint64)
    two = x[:-1] << np.uint64(8) | x[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    return four[:-4] << np.uint64(32) | four[4:]


def slide(x: np.ndarray, wide: int, f) -> np.ndarray:
    """f over each run of ``wide`` neighbours."""
    step = 1
    while step * 2 <= wide:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[: len(x) - (wide - step)], x[wide - step :]) if wide > step else x


class Texts:
    """Texts side by side as bytes, with ``length - ANCHOR`` edge bytes around each."""

    def __init__(self, raw: list[bytes], length: int):
        self.length, self.pad = length, length - ANCHOR
        edge = bytes([EDGE]) * self.pad
        self.bytes = np.frombuffer(edge + b"".join(x + edge for x in raw) + bytes([EDGE]) * 8, np.uint8)
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = self.pad + np.concatenate([[0], np.cumsum(self.sizes + self.pad)[:-1]]).astype(np.int64) if raw else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, 48-bit hashes and texts of the anchors.

        An anchor is the ANCHOR-byte string with the least hash in some string of ``length`` bytes, so equal strings of that length
        hold an equal anchor at an equal place.
        """
        places, hashes, a, wide = [], [], self.bytes, self.pad + 1
        for lo in range(0, max(0, len(a) - self.length + 1), SLICE):
            eight = words8(a[lo : lo + SLICE + self.length - 1])
            n = len(eight) - (ANCHOR - 8)
            if n < wide:
                break
            h = eight[:n]
            for i in [*range(8, ANCHOR - 8, 8), ANCHOR - 8]:
                h = mix(h * GOLD + eight[i : i + n])
            low = slide(h, wide, np.minimum)
            none = np.zeros(wide - 1, np.uint64)
            at = np.flatnonzero(slide(np.concatenate([none, low, none]), wide, np.maximum) == h)
            places.append(at + lo), hashes.append(h[at] & LOW48)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at, first = np.unique(np.concatenate(places), return_index=True)
        h = np.concatenate(hashes)[first]
        inside = (a[at] != EDGE) & (a[at + ANCHOR - 1] != EDGE)
        at, h = at[inside], h[inside]
        return at, h, np.searchsorted(self.starts, at, "right") - 1

    def windows(self, at: np.ndarray) -> np.ndarray:
        """All bytes of strings of ``length`` that hold the anchor at a place: one row for each."""
        return np.lib.stride_tricks.sliding_window_view(self.bytes, self.length + self.pad)[at - self.pad]

    def codes(self, at: np.ndarray) -> np.ndarray:
        """64-bit codes of the windows."""
        out = np.empty(len(at), np.uint64)
        for lo in range(0, len(at), 65536):
            w = self.windows(at[lo : lo + 65536])
            w = np.pad(w, ((0, 0), (0, -w.shape[1] % 8))).view(">u8")
            h = np.zeros(len(w), np.uint64)
            for column in w.T:
                h = mix(h * GOLD + column.astype(np.uint64))
            out[lo : lo + 65536] = h
        return out


def raw_texts(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches as parts of about ``rows`` rows, none of which ends inside a run of equal first columns."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= rows:
            h = batch.column(0).to_numpy()
            cut = int(np.searchsorted(h, held[-1].column(0)[-1].as_py(), "right"))
            if cut < batch.num_rows:
                yield pa.concat_batches([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.concat_batches(held)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes, by at least ``depth`` bytes and then by place."""
    n = len(text)
    key = words8(np.append(text, np.zeros(7, np.uint8)))
    order = np.argsort(key, kind="stable")
    rank, k = np.empty(n, np.uint64), 8
    while True:
        fresh = np.empty(n, np.uint64)
        fresh[0] = 0
        ordered = key[order]
        np.cumsum(ordered[1:] != ordered[:-1], out=fresh[1:])
        rank[order] = fresh
        if k >= depth or fresh[-1] == n - 1:
            return order
        key = rank << np.uint64(32)
        key[: n - k] |= rank[k:] + np.uint64(1)
        order = np.argsort(key, kind="stable")
        k *= 2


def agree(eight: np.ndarray, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Equal bytes from places p and q on, counted up to ``most``."""
    out, live = np.zeros(len(p), np.int64), np.arange(len(p))
    last = len(eight) - 1
    for step in range(0, most, 8):
        x = eight[np.minimum(p[live] + step, last)] ^ eight[np.minimum(q[live] + step, last)]
        same = x == 0
        off = live[~same]
        # the leading zero bytes of the difference
        y = x[~same]
        lead = np.zeros(len(y), np.int64)
        for b in range(1, 8):
            lead += (y >> np.uint64(64 - 8 * b)) == 0
        out[off] = step + lead
        live = live[same]
        if not len(live):
            return np.minimum(out, most)
    out[live] = most
    return out


def first_owners(windows: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each string of ``length`` bytes of each window, the smallest owner of a window that holds it; a large number where
    the string touches an edge.

    The windows are one text. Its Burrows-Wheeler transform is cut into runs, and the bytes that a suffix shares with the one before it in
    order are compared at run starts (and window starts) only. Streaming over the text, the matching length then falls by one from place to
    place: inside a run, neighbours stay neighbours when both are extended by the run's byte. Places whose match is ``length`` or
    longer belong to one interval of the order, whose smallest owner is taken.
    """
    n, wide = windows.shape
    text = np.append(np.concatenate([windows, np.full((n, 1), EDGE, np.uint8)], axis=1).ravel(), np.uint8(EDGE))
    size, reach = len(text), length + wide + 1
    order = suffix_order(text, reach)
    bwt = text[order - 1]
    start = np.append(True, bwt[1:] != bwt[:-1])  # rows at which a run starts
    sampled = np.zeros(size, bool)
    sampled[order[start]] = True
    sampled[:: wide + 1] = True
    before = np.empty(size, np.int64)  # the place one row before, in order
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    eight = words8(np.append(text, np.zeros(reach + 8, np.uint8)))
    at = np.flatnonzero(sampled & (before >= 0))
    match = np.zeros(size, np.int64)
    match[at] = agree(eight, at, before[at], reach)
    last = np.maximum.accumulate(np.where(sampled, np.arange(size), 0))
    match = match[last] - (np.arange(size) - last)
    # intervals of rows that share `length` bytes
    group = np.cumsum(match[order] < length)
    group -= group[0]
    far = np.iinfo(np.int64).max
    whole = np.zeros((n, wide + 1), bool)
    edge = np.concatenate([np.zeros((n, 1), np.int32), np.cumsum(windows == EDGE, axis=1, dtype=np.int32)], axis=1)
    whole[:, : wide - length + 1] = edge[:, length:] == edge[:, : wide - length + 1]
    value = np.where(whole, owner[:, None], far).ravel()
    value = np.append(value, far)
    least = np.minimum.reduceat(value[order], np.flatnonzero(np.append(True, np.diff(group) > 0)))
    out = np.empty(size, np.int64)
    out[order] = least[group]
    out = out[:-1].reshape(n, wide + 1)[:, : wide - length + 1]
    return np.where(whole[:, : wide - length + 1], out, far)


def owners_by_offset(windows: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """What ``first_owners`` gives, for more windows of one anchor than an index holds.

    Strings that share an anchor have it at the same offset, so each offset is settled by itself: its strings are sorted, and equal ones take
    their smallest owner. Memory holds one offset's strings.
    """
    n, wide = windows.shape
    far = np.iinfo(np.int64).max
    out = np.full((n, wide - length + 1), far)
    for at in range(wide - length + 1):
        part = np.ascontiguousarray(windows[:, at : at + length])
        whole = np.flatnonzero((part != EDGE).all(axis=1))
        if not len(whole):
            continue
        part = part[whole].view(f"V{length}").ravel()
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        least = np.minimum.reduceat(owner[whole][order], first)
        out[whole[order], at] = np.repeat(least, np.diff(np.append(first, len(order))))
    return out


def promising(windows: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Windows that may share a string of ``length`` with another of their group.

    Such a string extends the anchor by half of the rest or more to the left or to the right, so one of these two longer
    strings is shared too.
    """
    half = (length - ANCHOR) // 2
    pad = length - ANCHOR
    keep = np.zeros(len(windows), bool)
    for lo, hi in ((pad - half, pad + ANCHOR), (pad, pad + ANCHOR + half)):
        part = windows[:, lo:hi]
        w = np.pad(part, ((0, 0), (0, -part.shape[1] % 8))).copy().view(np.uint64)
        h = group.astype(np.uint64)
        for column in w.T:
            h = mix(h * GOLD + column)
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        keep |= count[back] > 1
    return keep


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = False, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Bytes to remove from each document of ``docs`` (doc_id long, text): (doc_id, n_bytes, spans, kept_sha256[, kept]).

    A byte is removed when a string of ``length`` bytes that covers it also starts in a document with a smaller id. Strings are judged on
    the input and never cross documents. ``spans`` lists the maximal removed runs as (start, end) in bytes; ``kept`` is what remains, in bytes.

    1. Every string of ``length`` bytes holds an anchor, chosen by its content. Anchors that two documents hold are found by exchanging
       packed hashes. 2. A window is all bytes that strings around an anchor can cover. Equal windows are one, with their smallest
       document, so groups of copies shrink to one row for each chunk of documents before they move; what a document shares whole windows
       of is settled by that. 3. Windows that share an anchor but differ are fetched once each and go, by anchor, into run-length indexes
       (``first_owners``), which find the first owner of every string. 4. Answers go back to the chunks of documents, which are dealt out by a hash;
       the dealt texts are one exchange that all steps reuse.

    A null text has no bytes (n_bytes 0), nor has an empty one; texts shorter than ``length`` lose nothing. A document without an id has no order:
    it loses nothing and takes nothing from others. Rows with equal ids do not take from each other. An empty table gives no rows.
    """
    if length < ANCHOR + 8:
        raise ValueError(f"repeats must have {ANCHOR + 8} bytes or more")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(width(docs), -(-total // chunk_bytes))
    # some two million anchors: 32 bits of a hash tell them apart well enough, a chance match costs a row
    buckets = max(width(docs), -(-total // (32 << 20)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = own.withColumn("chunk", chunk_of(chunks))

    def bucketed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and key of 48-bit hashes."""
        h = mix(h)
        return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), h.astype(np.uint32)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            texts = Texts(raw_texts(batch.column(1)), length)
            _, h, doc = texts.anchors()
            chunk = batch.column(2).to_numpy()[doc].astype(np.int64)
            bucket, key = bucketed(h)
            order = np.lexsort((doc, key, chunk, bucket))
            key, doc, chunk, bucket = key[order], doc[order], chunk[order], bucket[order]
            new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
            key, chunk, bucket = key[new], chunk[new], bucket[new]
            run = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (bucket[1:] != bucket[:-1])))[: len(key)]
            size = np.diff(np.append(run, len(key)))
            # one row for each bucket: its keys by chunk, and how many there are of each chunk
            cut = np.flatnonzero(np.append(True, np.diff(bucket[run]) != 0))[: len(run)]
            rows = list(zip(cut, np.append(cut[1:], len(run)), strict=False))
            at = np.append(run, len(key))
            data = [[key[at[a] : at[b]].tobytes() for a, b in rows], [chunk[run[a:b]].astype(np.int32).tobytes() for a, b in rows], [size[a:b].astype(np.int32).tobytes() for a, b in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[run[cut]], pa.int32()), *(pa.array(x, pa.binary()) for x in data)], ["bucket", "keys", "chunks", "sizes"])

    def shared(rows: pa.Table) -> pa.Table:
        """For each chunk, the keys of a bucket that two documents or more hold."""
        key, whose, size = (np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (("keys", np.uint32), ("chunks", np.int32), ("sizes", np.int32)))
        whose = np.repeat(whose, size)
        order = np.argsort(key, kind="stable")
        key, whose = key[order], whose[order]
        same = key[1:] == key[:-1]
        twice = np.append(same, False) | np.append(False, same) if len(key) else np.zeros(0, bool)
        pair = np.unique(whose[twice].astype(np.uint64) << np.uint64(32) | key[twice])
        who, first = np.unique(pair >> np.uint64(32), return_index=True)
        data = [pair[a:b].astype(np.uint32).tobytes() for a, b in zip(first, np.append(first[1:], len(pair)), strict=False)]
        return pa.table({"chunk": pa.array(who.astype(np.int32), pa.int32()), "bucket": pa.array([rows["bucket"][0].as_py()] * len(who), pa.int32()), "keys": pa.array(data, pa.binary())})

    asked = own.select("doc_id", "text", "chunk").mapInArrow(ask, "bucket int, keys binary, chunks binary, sizes binary")
    known = asked.groupBy("bucket").applyInArrow(shared, "chunk int, bucket int, keys binary")
    dealt = deal(own.select("doc_id", "text"), chunks)

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """A row for each distinct window of a chunk around a shared anchor, with its first document there."""
        chunk, mine = mine["chunk"][0].as_py() if mine.num_rows else 0, unpacked(mine)
        mine = mine.filter(mine["doc_id"].is_valid())
        wanted = [np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, x in zip(theirs["bucket"].to_pylist(), theirs["keys"].to_pylist(), strict=True)]
        wanted = np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, np.uint64)
        texts = Texts(raw_texts(mine["text"]), length)
        at, h, doc = texts.anchors()
        bucket, key = bucketed(h)
        key = bucket.astype(np.uint64) << np.uint64(32) | key
        hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key if len(wanted) else np.zeros(len(h), bool)
        at, h, doc = at[hit], h[hit], doc[hit]
        code, ids = texts.codes(at), mine["doc_id"].to_numpy()
        who = ids[doc] if len(doc) else np.zeros(0, np.int64)
        order = np.lexsort((at, who, code))
        at, h, doc, code, who = at[order], h[order], doc[order], code[order], who[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))[: len(code)]
        more = np.maximum.reduceat(who, first) > who[first] if len(first) else np.zeros(0, bool)
        return pa.table({
            "h": pa.array((h[first] >> np.uint64(16)).astype(np.uint32).view(np.int32), pa.int32()),
            "code": pa.array(code[first].view(np.int64), pa.int64()), "chunk": pa.array(np.full(len(first), chunk), pa.int32()),
            "low": pa.array(who[first], pa.int64()), "at": pa.array(at[first] - texts.starts[doc[first]], pa.int32()), "more": pa.array(more),
        })

    rows = dealt.cogroup(known.groupBy("chunk")).applyInArrow(meet, "h int, code long, chunk int, low long, at int, more boolean")
    rows = rows.repartition(max(width(docs), -(-total // (16 << 20))), "h").sortWithinPartitions("h", "code", "low", "chunk")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers that need no index (the first document of a window), and one row for each window that shares an anchor with another."""
        for t in whole_groups(batches, SETTLE_ROWS):
            h, code, chunk, low, at, more = (t.column(i).to_numpy() if i < 5 else t.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            new = np.append(True, (h[1:] != h[:-1]) | (code[1:] != code[:-1]))
            first = low[np.flatnonzero(new)][np.cumsum(new) - 1]
            group = np.append(True, h[1:] != h[:-1])
            several = (np.add.reduceat(new.astype(np.int64), np.flatnonzero(group)) > 1)[np.cumsum(group) - 1]
            for index, take in ((False, (first < low) | more), (True, new & several)):
                yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (np.full(len(h), index), h, code, chunk, first, at)], ["index", "h", "code", "chunk", "first", "at"])

    told = rows.mapInArrow(settle, "index boolean, h int, code long, chunk int, first long, at int")

    def fetch(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine = unpacked(mine)
        raw, ids = raw_texts(mine["text"]), mine["doc_id"].to_pylist()
        texts = Texts(raw, length)
        place: dict[int, list[int]] = {}
        for i, d in enumerate(ids):
            place.setdefault(d, []).append(i)
        first, at, code = theirs["first"].to_pylist(), theirs["at"].to_numpy(), theirs["code"].to_numpy()
        where, what = [], []
        for k, d in enumerate(first):
            for i in place.get(d, ()):
                if at[k] + ANCHOR <= len(raw[i]):
                    where.append(int(texts.starts[i] + at[k])), what.append(k)
        where, what = np.array(where, np.int64), np.array(what, np.int64)
        right = texts.codes(where).view(np.int64) == code[what] if len(where) else np.zeros(0, bool)
        what, one = np.unique(what[right], return_index=True)
        data = texts.windows(where[right][one]) if len(one) else np.zeros((0, 1), np.uint8)
        took = theirs.take(pa.array(what, pa.int64()))
        return pa.table({"h": took["h"], "code": took["code"], "chunk": took["chunk"], "first": took["first"], "window": pa.array([x.tobytes() for x in data], pa.binary())})

    apart = told.where("index").select("h", "code", "chunk", "first", "at")
    windows = dealt.cogroup(apart.groupBy("chunk")).applyInArrow(fetch, "h int, code long, chunk int, first long, window binary")
    windows = windows.repartition(max(width(docs), -(-total // (8 << 20))), "h").sortWithinPartitions("h")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, SHARD_WINDOWS):
            group, low = t.column(0).to_numpy(), t.column(3).to_numpy()
            data = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8).reshape(len(group), -1)
            good = np.flatnonzero(promising(data, group, length))
            owners = first_owners if len(good) <= 2 * SHARD_WINDOWS else owners_by_offset
            best = owners(data[good], low[good], length) if len(good) else np.zeros((0, 1), np.int64)
            less = best < low[good][:, None]
            some = np.flatnonzero(less.any(axis=1))
            took = t.take(pa.array(good[some], pa.int64()))
            blob = [np.packbits(less[i]).tobytes() + best[i][less[i]].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([took.column(2), took.column(1), took.column(3), pa.array(blob, pa.binary())], ["chunk", "code", "first", "best"])

    solved = windows.mapInArrow(index, "chunk int, code long, first long, best binary")
    answers = told.where("not index").select("chunk", "code", "first", F.lit(None).cast("binary").alias("best")).unionByName(solved)

    def remove(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine = unpacked(mine)
        raw, ids = raw_texts(mine["text"]), mine["doc_id"]
        texts = Texts(raw, length)
        cover = np.zeros(len(texts.bytes) + 1, np.int32)
        if theirs.num_rows:
            at, _, doc = texts.anchors()
            named = np.array(ids.is_valid().to_pylist(), bool)[doc]
            at, doc = at[named], doc[named]
            code, who = texts.codes(at).view(np.int64), ids.fill_null(0).to_numpy()[doc]
            indexed = theirs["best"].is_valid()
            for some in (theirs.filter(indexed), theirs.filter(pa.compute.invert(indexed))):
                if not some.num_rows or not len(at):
                    continue
                some = some.sort_by("code")
                keys, first = some["code"].to_numpy(), some["first"].to_numpy()
                row = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                hit = keys[row] == code
                lo = np.maximum(at - texts.pad, texts.starts[doc])
                hi = np.minimum(at + length, texts.starts[doc] + texts.sizes[doc])
                full = hit & (who > first[row]) & (hi - lo >= length)
                np.add.at(cover, lo[full], 1), np.add.at(cover, hi[full], -1)
                if some["best"].null_count:
                    continue
                best, bits = some["best"].combine_chunks(), -(-(texts.pad + 1) // 8)
                for k in np.flatnonzero(hit & (who <= first[row])):
                    blob = best[int(row[k])].as_py()
                    j = np.flatnonzero(np.unpackbits(np.frombuffer(blob[:bits], np.uint8)))
                    j = j[np.frombuffer(blob[bits:], np.int64) < who[k]] + at[k] - texts.pad
                    np.add.at(cover, j, 1), np.add.at(cover, j + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        spans, digests, kept = [], [], []
        for i, data in enumerate(raw):
            mask = gone[texts.starts[i] : texts.starts[i] + len(data)]
            if mask.any():
                turn = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
                data = np.frombuffer(data, np.uint8)[~mask].tobytes()
            else:
                spans.append([])
            digests.append(hashlib.sha256(data).hexdigest())
            if with_text:
                kept.append(data)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = {"doc_id": ids, "n_bytes": pa.array(texts.sizes, pa.int64()), "spans": pa.array(spans, kind), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * with_text
    return dealt.cogroup(answers.groupBy("chunk")).applyInArrow(remove, schema)
