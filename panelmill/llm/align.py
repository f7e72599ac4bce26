"""Alignment of the tokens of a byte-level BPE (A) and a sentencepiece model (B) over the same texts."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import once, parts
from .common import packed, written

#: Characters besides space and newline that some library counts as white space, and the piece sign: texts with them are cut nowhere.
ODD = re.compile("[\x09\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u2581\u3000\ufeff]")
CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Put before a chunk for B, which adds a space to what it is given; no piece reaches from it into a space or newline.
GUARD = "x"
#: Characters that are aligned side by side at once.
PART = 100_000
BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


@once
def plain_a(path: str) -> tuple[Tokenizer, list[bytes], np.ndarray]:
    """Tokenizer A with special strings as plain text, and the bytes of each id."""
    ranks, special = parts(path)
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    t.encode_special_tokens = True
    raw = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for s, i in ranks.items():
        raw[i] = s
    return t, raw, np.array([len(x) for x in raw], np.int64)


@once
def plain_b(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes], np.ndarray]:
    """Model B and the bytes of each id. Raises if a piece reaches over the start of a space or newline."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if "▁" in piece.lstrip("▁") or " " in piece or "\n" in piece:
            raise ValueError(f"{path}: piece {i} reaches over a word's start")
        hexed = BYTE.fullmatch(piece)
        raw.append(bytes([int(hexed[1], 16)]) if hexed and sp.is_byte(i) else piece.replace("▁", " ").encode())
    return sp, raw, np.array([len(x) for x in raw], np.int64)


def refined(cut: np.ndarray, coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: ``cut`` where it is ``coarse``, else the last coarse cut before plus the bytes decoded since."""
    if coarse.all():
        return cut
    done = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(coarse, np.arange(len(cut)), -1))
    since = np.where(last >= 0, cut[last] - done[last], 0)
    return np.where(coarse, cut, since + done)


def ends_a(path: str, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids of ``text`` and the byte at which each ends; None if their bytes are not the text's."""
    t, raw, sizes = plain_a(path)
    e = t.encode(text, add_special_tokens=False)
    ids = e.ids
    if b"".join(map(raw.__getitem__, ids)) != data:
        return None
    out = np.array(ids, np.int64)
    cut = np.fromiter((x[1] for x in e.offsets), np.int64, len(ids))
    # of the tokens that share a character, only the last ends where its span ends
    coarse = np.append(cut[1:] != cut[:-1], True)[: len(cut)]
    if len(data) != len(text):
        lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        cut = np.append(np.flatnonzero(lead), len(data))[cut]
    return out, refined(cut, coarse, sizes[out])


def ends_b(path: str, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    sp, raw, sizes = plain_b(path)
    pieces = sp.encode(GUARD + text, return_type="proto").pieces
    spans = np.array([(p.id, p.begin, p.end) for p in pieces], np.int64).reshape(-1, 3)
    joined = b"".join(map(raw.__getitem__, spans[:, 0].tolist()))
    size = len(GUARD)
    if joined != b" " + GUARD.encode() + data or spans[0, 2] != size:
        return None
    # a byte piece has an empty span unless it is the last of its character
    ids, cut, coarse = spans[1:, 0], spans[1:, 2] - size, spans[1:, 1] < spans[1:, 2]
    return ids, refined(cut, coarse, sizes[ids])


class Aligned:
    """The chunks of a slice of documents, each aligned once: token counts, groups as text, and links as pairs of ids."""

    def __init__(self, a: str, b: str):
        self.a, self.b = a, b
        self.count: list[np.ndarray] = []  # for each chunk: n_a, n_b, n_groups, n_links; no tokens: -1
        self.text: list[str] = []
        self.links: list[np.ndarray] = []  # a << 32 | b

    def add(self, chunks: list[str]) -> None:
        """Chunks that may stand side by side: each starts with a space or newline and ends with another character."""
        data = [c.encode() for c in chunks]
        whole, text = b"".join(data), "".join(chunks)
        a, b = ends_a(self.a, text, whole), ends_b(self.b, text, whole)
        if a is None or b is None:
            if len(chunks) > 1:
                half = len(chunks) // 2
                self.add(chunks[:half]), self.add(chunks[half:])
            else:
                self.count.append(np.full((1, 4), -1)), self.text.append(""), self.links.append(np.zeros(0, np.int64))
            return
        (ia, ea), (ib, eb) = a, b
        stop = np.cumsum([len(x) for x in data])
        # between neighbouring ends of either side lies one link
        cut = np.union1d(ea, eb)
        at = np.searchsorted(ea, cut), np.searchsorted(eb, cut)
        both = np.intersect1d(ea, eb, assume_unique=True)
        held = [np.diff(np.searchsorted(x, stop, "right"), prepend=0) for x in (ea, eb, both, cut)]
        self.count.append(np.stack(held, axis=1))
        self.links.append(ia[at[0]] << 32 | ib[at[1]])
        to_a, to_b = (np.searchsorted(x, both, "right").tolist() for x in (ea, eb))
        sa, sb = list(map(str, ia.tolist())), list(map(str, ib.tolist()))
        groups = [",".join(sa[i:j]) + "|" + ",".join(sb[k:m]) for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)]
        end = np.cumsum(held[2]).tolist()
        self.text += [";".join(groups[i:j]) for i, j in zip([0, *end], end, strict=False)]


def align_slice(texts: list[str], a: str, b: str) -> tuple[list[np.ndarray], Aligned]:
    """The chunks of each text, by number, and what is known of the chunks."""
    number: dict[str, int] = {}
    alone, joined = [], []
    held = []
    for text in texts:
        if not text:
            held.append(np.zeros(0, np.int32))
            continue
        chunks = [" " + text] if ODD.search(text) else CHUNK.findall(" " + text)
        row = np.empty(len(chunks), np.int32)
        for i, c in enumerate(chunks):
            n = number.get(c)
            if n is None:
                n = number[c] = len(number)
                # what ends in white space, or is not cut, cannot stand beside others
                (alone if c[-1] in " \n" or ODD.search(c) else joined).append(c)
            row[i] = n
        held.append(row)
    out, order, size, run = Aligned(a, b), [], 0, []
    for c in joined:
        run.append(c)
        size += len(c)
        if size >= PART:
            out.add(run)
            order += run
            run, size = [], 0
    if run:
        out.add(run)
        order += run
    for c in alone:
        out.add([c])
        order.append(c)
    place = np.empty(len(order), np.int32)
    place[[number[c] for c in order]] = np.arange(len(order), dtype=np.int32)
    return [place[row] for row in held], out


def sums(values: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """For each row of chunk numbers, the sum of their values."""
    size = np.array([len(r) for r in rows], np.int64)
    done = np.concatenate([[0], np.cumsum(values[np.concatenate(rows)])]) if size.sum() else np.zeros(1, np.int64)
    to = np.cumsum(size)
    return done[to] - done[to - size]


def align(docs: DataFrame, a: str, b: str, with_groups: bool = False, slice_bytes: int = 8 << 20) -> DataFrame:
    """Align the tokens of two tokenizers over each whole text of ``docs`` (doc_id, text): (doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256[, groups]).

    Character offsets of A and spans of B are coarse cuts; inside characters, and for byte pieces of B, the decoded bytes refine them. Byte
    offsets where tokens of both end cut a text into ``groups`` (``a1,a2|b1;a3|b2``). A link is a pair of tokens whose bytes overlap; an id pair's
    count is the number of links that hold it in all texts. ``n_best`` counts the links whose pair has the highest count of its B id.

    A token never reaches over the start of a run of spaces and newlines, so a slice of documents aligns each distinct chunk between such starts
    once. The slices are written as a table: chunk numbers for each document and links for each chunk. Pairs are counted by an aggregate, and
    each slice gets the counts of its own distinct pairs back; no text moves.

    Null and empty texts have no tokens: zeros and an empty digest; nor have texts that either tokenizer does not give back byte by byte. Texts
    of any length are taken whole (one without spaces is one chunk). Repeated rows count each; an empty table gives no rows; other columns are
    left out, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, size, n = 0, 0, batch.num_rows
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for i in range(n):
                size += sizes[i]
                if size >= slice_bytes or i == n - 1:
                    yield aligned(batch.slice(lo, i + 1 - lo))
                    lo, size = i + 1, 0

    def aligned(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, known = align_slice(batch.column(1).to_pylist(), a, b)
        count = np.concatenate([*known.count, np.zeros((0, 4), np.int64)]).astype(np.int64)
        bad = count[:, 0] < 0
        count[bad] = 0
        size = np.array([len(r) for r in rows], np.int64)
        good = (size > 0) & (sums(bad.astype(np.int64), rows) == 0)
        rows = [r if g else r[:0] for r, g in zip(rows, good, strict=True)]
        per = [sums(count[:, i], rows) for i in range(4)]
        texts = [";".join(map(known.text.__getitem__, r.tolist())) for r in rows]
        digest = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
        table = {"doc_id": batch.column(0)} | {c: pa.array(x) for c, x in zip(("n_a", "n_b", "n_groups", "n_links"), per, strict=True)}
        table |= {"groups_sha256": pa.array(digest, pa.string())} | ({"groups": pa.array(texts, pa.string())} if with_groups else {})
        table["chunks"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))
        links = np.concatenate([*known.links, np.zeros(0, np.int64)])
        uses = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=len(count))
        pair, place = np.unique(links, return_inverse=True)
        n = np.bincount(place, weights=np.repeat(uses, count[:, 3]), minlength=len(pair)).astype(np.int64)
        inside = {"size": pa.array(count[:, 3].astype(np.int32)), "pair": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[:, 3])]), pa.int32()), pa.array(place.astype(np.int32)))}
        keep = n > 0
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([packed(pa.RecordBatch.from_pydict(table))], pa.binary()), pa.array([packed(pa.RecordBatch.from_pydict(inside))], pa.binary()), pa.array([pair.tobytes()], pa.binary()),
             *(pa.array([x], t) for x, t in (((pair[keep] >> 32).astype(np.int32), pa.list_(pa.int32())), ((pair[keep] & 0xFFFFFFFF).astype(np.int32), pa.list_(pa.int32())), (n[keep], pa.list_(pa.int64()))))],
            ["slice", "docs", "inside", "pairs", "a", "b", "n"],
        )

    own = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    held = written(own.mapInArrow(slices, "slice string, docs binary, inside binary, pairs binary, a array<int>, b array<int>, n array<long>"))
    asked = held.select("slice", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("slice", "p.a", "p.b", "p.n")
    total = asked.groupBy("a", "b").agg(F.sum("n").alias("total"))
    # at most one row for each id of A in this window
    total = total.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("b")))
    told = asked.select(F.col("slice").alias("of"), "a", "b").join(total, ["a", "b"])

    def finish(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        docs_, inside = (pa.ipc.open_stream(mine[c][0].as_py()).read_all().combine_chunks() for c in ("docs", "inside"))
        pair = np.frombuffer(mine["pairs"][0].as_py(), np.int64)
        key = theirs["a"].to_numpy().astype(np.int64) << 32 | theirs["b"].to_numpy()
        at = np.searchsorted(pair, key)
        known = [np.zeros(len(pair), np.int64) for _ in range(2)]
        for x, c in zip(known, ("best", "total"), strict=True):
            x[at] = theirs[c].to_numpy()
        size = inside["size"].to_numpy()
        place = inside["pair"].combine_chunks().flatten().to_numpy() if len(inside) else np.zeros(0, np.int32)
        to = np.cumsum(size, dtype=np.int64)
        chunks, lengths = docs_["chunks"].combine_chunks(), np.zeros(0, np.int64)
        flat, lengths = chunks.flatten().to_numpy(), chunks.value_lengths().to_numpy().astype(np.int64)
        stop = np.cumsum(lengths)
        out = []
        for x in known:
            done = np.concatenate([[0], np.cumsum(x[place])])
            each = done[to] - done[to - size]
            done = np.concatenate([[0], np.cumsum(each[flat])])
            out.append(pa.array(done[stop] - done[stop - lengths]))
        cols = {c: docs_[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | dict(zip(("n_best", "count_sum"), out, strict=True))
        return pa.table(cols | {c: docs_[c] for c in ("groups_sha256", *(["groups"] if with_groups else []))})

    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")) + ", groups_sha256 string" + ", groups string" * with_groups
    return held.select("slice", "docs", "inside", "pairs").groupBy("slice").cogroup(told.groupBy("of")).applyInArrow(finish, schema)
