"""Hierarchical Pitman-Yor language model over the bytes of words, seated by Gibbs sampling."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deal, mix, unpacked, width, words_of, written

DEPTH = 5  # bytes of context; a gram has one more
GRAM = (1 << 8 * (DEPTH + 1)) - 1
END = b"\n"
ROOM = 64 - 8 * (DEPTH + 1)  # bits that a gram leaves free
SLICE = 1 << ROOM
BYTES, WORDS = 0, 1


def held_out(doc_id) -> bool:
    """Rows that the model does not learn from; a row without an id is learnt from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Stream:
    """Documents as bytes: each word and a space, then an end byte; DEPTH end bytes stand before as the first context."""

    def __init__(self, texts: list[str | None], said: list[list[bytes]] | None = None):
        """``said`` holds the words of the texts, where they are known."""
        raw = [b" ".join([*words, END]) for words in said or map(words_of, texts)]
        self.bytes = np.frombuffer(b"".join(END * DEPTH + x for x in raw), np.uint8)
        size = np.array([len(x) + DEPTH for x in raw], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first place, grams, whether a document's own byte is predicted) over slices of places."""
        a, n = self.bytes, len(self.bytes)
        for lo in range(DEPTH, n, SLICE):
            part = a[lo - DEPTH : min(n, lo + SLICE)].astype(np.uint64)
            m = len(part) - DEPTH
            code = np.zeros(m, np.uint64)
            for i in range(DEPTH + 1):
                code = code << np.uint64(8) | part[i : i + m]
            own = np.ones(m, bool)
            first = np.searchsorted(self.starts, lo - DEPTH)
            for s in self.starts[first : np.searchsorted(self.starts, lo + m)]:
                own[max(0, s - lo) : max(0, s + DEPTH - lo)] = False
            yield lo, code, own


def ranked(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of a slice, and which of them stands at each place. A gram and its place share 64 bits, so plain numbers are sorted."""
    both = np.sort(grams << np.uint64(ROOM) | np.arange(len(grams), dtype=np.uint64))
    grams, place = both >> np.uint64(ROOM), (both & np.uint64(SLICE - 1)).astype(np.int64)
    new = np.append(True, grams[1:] != grams[:-1])
    which = np.empty(len(grams), np.uint16)
    which[place] = np.cumsum(new) - 1
    return grams[new], which


def merged(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = np.concatenate(keys)
    if counts is None:
        flat = np.sort(flat)
        return flat[np.append(True, flat[1:] != flat[:-1])[: len(flat)]], np.zeros(0, np.int64)
    order = np.argsort(flat)
    flat, n = flat[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))[: len(flat)]
    return flat[first], np.add.reduceat(n, first) if len(first) else n


def buckets_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Grams with the same two bytes of nearest context stay together, so all their contexts of two bytes and more do."""
    return (mix(keys >> np.uint64(8) & np.uint64(0xFFFF) if kind == BYTES else keys) % np.uint64(buckets)).astype(np.int32)


def by_bucket(kind: int, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket and places of its keys, in their order."""
    bucket = buckets_of(kind, keys, buckets)
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))[: len(order)]
    for a, b in zip(first, np.append(first[1:], len(order)), strict=False):
        yield int(bucket[order[a]]), order[a:b]


def all_words(said: list[list[bytes]]) -> np.ndarray:
    """Codes of the tokens of all texts: the words of each, then its end."""
    tokens = chain.from_iterable(chain(words, (END,)) for words in said)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, sum(map(len, said)) + len(said))


@dataclass
class Level:
    """Restaurants of one context length: the pairs (context, byte) as sorted grams, their customers, tables and parents."""

    pair: np.ndarray
    n: np.ndarray
    t: np.ndarray
    context: np.ndarray
    of: np.ndarray  # pair -> context
    parent: np.ndarray  # pair -> pair of the next shorter context
    customers: np.ndarray
    tables: np.ndarray

    def count(self) -> None:
        self.customers = np.bincount(self.of, self.n, len(self.context))
        self.tables = np.bincount(self.of, self.t, len(self.context))


def levels_of(pair: np.ndarray, n: np.ndarray, least: int) -> dict[int, Level]:
    """Restaurants from DEPTH down to ``least`` bytes of context, with one table for each pair."""
    out = {}
    for depth in range(DEPTH, least - 1, -1):
        context, of = np.unique(pair >> np.uint64(8), return_inverse=True)
        above, parent = np.unique(pair & np.uint64((1 << 8 * depth) - 1), return_inverse=True)
        out[depth] = Level(pair, n.astype(np.int64), np.ones(len(pair), np.int64), context, of, parent, n, n)
        out[depth].count()
        pair, n = above, np.bincount(parent, minlength=len(above))
    return out


def seat(n: np.ndarray, other: np.ndarray, p: np.ndarray, d: float, s: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of n customers who sit down one by one, while ``other`` tables of the restaurant serve other bytes.

    The first opens a table; a later one does so with odds (s + d * tables) * p against the seats already taken less d
    for each table. Beyond 32 customers a sixteenth of those seated sits down at once, with the odds held still.
    """
    t, j = np.minimum(n, 1), np.minimum(n, 1)
    live = np.flatnonzero(n > 1)
    while len(live):
        step = np.minimum(np.maximum(1, j[live] // 16), n[live] - j[live])
        a = (s + d * (other[live] + t[live])) * p[live]
        t[live] += rng.binomial(step, a / (a + j[live] - d * t[live]))
        j[live] += step
        live = live[j[live] < n[live]]
    return t


@dataclass(frozen=True)
class Root:
    """Predictive tables of the contexts of one byte, one for each sample (byte before, byte), with a discount for each level."""

    tables: np.ndarray
    discounts: tuple[float, ...]
    strength: float = 0.5


def predict(level: Level, p: np.ndarray, d: float, s: float) -> np.ndarray:
    """Predictive probability of each pair, from that of its parent."""
    return (level.n - d * level.t + (s + d * level.tables[level.of]) * p) / (s + level.customers[level.of])


def sweep(levels: dict[int, Level], table: np.ndarray, root: Root, rng: np.random.Generator) -> None:
    """One Gibbs sweep: every restaurant's tables are drawn anew, given its parent's prediction, from the longest contexts on."""
    low = min(levels)
    first = levels[low].pair & np.uint64(0xFFFF)
    given = {low: table[(first >> np.uint64(8)).astype(np.int64), (first & np.uint64(0xFF)).astype(np.int64)]}
    for depth in range(low, max(levels)):
        level = levels[depth]
        given[depth + 1] = predict(level, given[depth], root.discounts[depth], root.strength)[levels[depth + 1].parent]
    for depth in range(max(levels), low - 1, -1):
        level = levels[depth]
        other = level.tables[level.of] - level.t
        level.t = seat(level.n, other, given[depth], root.discounts[depth], root.strength, rng)
        level.count()
        if depth > low:
            above = levels[depth - 1]
            above.n = np.bincount(level.parent, level.t, len(above.pair)).astype(np.int64)
            above.t = np.minimum(above.t, above.n)
            above.count()


def answer(levels: dict[int, Level], table: np.ndarray, root: Root, grams: np.ndarray) -> np.ndarray:
    """Predictive probabilities of any grams, seen or not."""
    p = table[(grams >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64), (grams & np.uint64(0xFF)).astype(np.int64)]
    for depth in sorted(levels):
        level, d, s = levels[depth], root.discounts[depth], root.strength
        if not len(level.pair):
            continue
        gram = grams & np.uint64((1 << 8 * (depth + 1)) - 1)
        c = np.minimum(np.searchsorted(level.context, gram >> np.uint64(8)), len(level.context) - 1)
        there = level.context[c] == gram >> np.uint64(8)
        i = np.minimum(np.searchsorted(level.pair, gram), len(level.pair) - 1)
        seen = np.where(level.pair[i] == gram, level.n[i] - d * level.t[i], 0.0)
        p = np.where(there, (seen + (s + d * level.tables[c]) * p) / (s + level.customers[c]), p)
    return p


def discount(once: float, twice: float) -> float:
    """The usual estimate from how many pairs have one and two customers."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05


def short_root(customers: np.ndarray, samples: int, discounts: tuple[float, ...], seed: int, sweeps: int = 5) -> Root:
    """Seat the contexts of one byte and of none (256 * 256 and 256 pairs at any size of the input) and average nothing yet."""
    rng = np.random.default_rng(seed)
    n1 = customers.astype(np.int64)
    t1, base = np.minimum(n1, 1), np.full(256, 1 / 256)
    d0, d1, s = discounts[0], discounts[1], 0.5
    n0 = t1.sum(axis=0)
    t0, tables = np.minimum(n0, 1), []
    for k in range(sweeps + samples):
        p0 = (n0 - d0 * t0 + (s + d0 * t0.sum()) * base) / (s + n0.sum())
        other = t1.sum(axis=1, keepdims=True) - t1
        t1 = seat(n1.ravel(), other.ravel(), np.tile(p0, 256), d1, s, rng).reshape(256, 256)
        n0 = t1.sum(axis=0)
        t0 = seat(n0, np.minimum(t0, n0).sum() - np.minimum(t0, n0), base, d0, s, rng)
        p0 = (n0 - d0 * t0 + (s + d0 * t0.sum()) * base) / (s + n0.sum())
        if k >= sweeps:
            tables.append((n1 - d1 * t1 + (s + d1 * t1.sum(axis=1, keepdims=True)) * p0) / (s + n1.sum(axis=1, keepdims=True)))
    return Root(np.stack(tables), discounts, s)


def rng_of(seed: int, bucket: int) -> np.random.Generator:
    return np.random.default_rng([seed, bucket])


class Part:
    """Some documents of a chunk: distinct grams and words, and where the places of the texts point among them."""

    def __init__(self, texts: list[str | None]):
        said = [words_of(t) for t in texts]
        self.stream, words = Stream(texts, said), all_words(said)
        # a place that predicts nothing spans two texts: it must not tell in which order a chunk's texts came
        self.grams = [(lo, own, *ranked(np.where(own, code, np.uint64(0)))) for lo, code, own in self.stream.grams()]
        self.words, place = np.unique(words, return_inverse=True)
        self.place = place.astype(np.int32)
        self.tokens = np.array([len(words) + 1 for words in said])


def parts_of(texts: list[str | None]) -> tuple[list[tuple[int, np.ndarray]], list[Part]]:
    """The parts of a chunk and its distinct keys of each kind."""
    parts = [Part(texts[at : at + 1000]) for at in range(0, len(texts), 1000)]
    return [(BYTES, merged([g[2] for p in parts for g in p.grams])[0]), (WORDS, merged([p.words for p in parts])[0])], parts


def tally(docs: pa.Table, buckets: int, chunk: int) -> pa.Table:
    """A row for each kind and bucket with the distinct keys of a chunk, and how often its training texts hold them."""
    both, parts = parts_of(docs["text"].to_pylist())
    learnt = np.array([not held_out(d) for d in docs["doc_id"].to_pylist()], bool)
    rows = []
    for kind, keys in both:
        counts, at = np.zeros(len(keys), np.int64), 0
        for p in parts:
            mine = learnt[at : at + len(p.tokens)]
            at += len(p.tokens)
            if kind == WORDS:
                counts[np.searchsorted(keys, p.words)] += np.bincount(p.place, np.repeat(mine, p.tokens), len(p.words)).astype(np.int64)
                continue
            teach = np.repeat(mine, p.stream.ends - p.stream.starts)
            for lo, own, u, i in p.grams:
                counts[np.searchsorted(keys, u)] += np.bincount(i[own & teach[lo : lo + len(i)]], minlength=len(u))
        rows += [(kind, bucket, keys[x].tobytes(), counts[x].astype(np.int32).tobytes()) for bucket, x in by_bucket(kind, keys, buckets)]
    names, kinds = ["kind", "bucket", "keys", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names).append_column("chunk", pa.array([chunk] * len(rows), pa.int32()))


def fit(tallies: DataFrame) -> tuple[DataFrame, int, int]:
    """Counts of the grams and words of the training texts, a row for each kind and bucket, with the tokens and distinct words."""

    def add(rows: pa.Table) -> pa.Table:
        k, n = merged([np.frombuffer(x, np.uint64) for x in rows["keys"].to_pylist()], [np.frombuffer(x, np.int32).astype(np.int64) for x in rows["counts"].to_pylist()])
        k, n = k[n > 0], n[n > 0]
        return pa.table({"kind": rows["kind"][:1], "bucket": rows["bucket"][:1], "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary()), "total": pa.array([int(n.sum())]), "types": pa.array([len(k)])})

    parts = tallies.select("kind", "bucket", "keys", "counts")
    model = written(parts.groupBy("kind", "bucket").applyInArrow(add, "kind int, bucket int, keys binary, counts binary, total long, types long"))
    words = model.where(F.col("kind") == WORDS).agg(F.sum("total"), F.sum("types")).first()
    return model, words[0] or 0, words[1] or 0


def fit_root(model: DataFrame, rounds: int, samples: int, sweeps: int, seed: int) -> Root:
    """Seat all restaurants, send the tables of two-byte contexts to the short contexts, and repeat: each round starts from the parents
    that the last one drew. What comes back are sums for 256 * 256 pairs and some counts of counts."""
    root = Root(np.full((1, 256, 256), 1 / 256), (0.5,) * (DEPTH + 1))
    for k in range(rounds):
        now = root

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, keys, counts in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    levels = levels_of(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64), 2)
                    rng = rng_of(seed + k, bucket)
                    for _ in range(sweeps):
                        sweep(levels, now.tables[-1], now, rng)
                    low = levels[2]
                    n = np.bincount((low.pair & np.uint64(0xFFFF)).astype(np.int64), low.t, 65536 + 2 * (DEPTH + 1))
                    for depth, level in levels.items():
                        n[65536 + 2 * depth : 65538 + 2 * depth] = (level.n == 1).sum(), (level.n == 2).sum()
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_pydict({"k": at, "n": n[at].astype(np.int64)})

        got = model.where(F.col("kind") == BYTES).select("bucket", "keys", "counts").mapInArrow(tell, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        sums = np.zeros(65536 + 2 * (DEPTH + 1))
        for r in got:
            sums[r["k"]] = r["n"]
        n1 = sums[:65536].reshape(256, 256)
        d = [0.05, discount((n1 == 1).sum(), (n1 == 2).sum()), *(discount(*sums[65536 + 2 * i : 65538 + 2 * i]) for i in range(2, DEPTH + 1))]
        root = short_root(n1, samples, tuple(d), seed + k)
    return root


def score(docs: DataFrame, rounds: int = 2, burn: int = 2, samples: int = 3, seed: int = 11, chunk_bytes: int = 10 << 20) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text): (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are the words between ASCII white space with A-Z in lower case, then one end. ``score`` is the log10 probability of the text's
    tokens, spelt out as bytes (each word and a space, an end byte), under a hierarchical Pitman-Yor model: a restaurant for each context
    of up to DEPTH bytes, whose parent is the restaurant of the context less its oldest byte, and uniform bytes below all. Spelling
    gives unseen words a probability and bounds the contexts' alphabet. Seats are drawn by Gibbs sweeps and predictive probabilities averaged
    over ``samples`` states. ``base_score`` adds log10((c + 1) / (N + V + 1)) over tokens, from the counts of training tokens.

    Counts are packed by task and merged by bucket (a context's last two bytes, or a word's hash); restaurants of two bytes and more
    live in their bucket, the short ones are a table of fixed size. Texts are dealt into chunks by a hash; a chunk asks each bucket
    once for each distinct gram and word, so a frequent word costs a row for each chunk however often it stands there.

    A null or empty text is its end alone. Rows with crc32(doc_id as text) mod 7 = 2 are held out; a row without an id is learnt from.
    Repeated rows count each time and score alike. An empty table gives no rows. Other columns are not read.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(width(docs), -(-total // (64 << 20)))
    chunks = max(width(docs), -(-total // chunk_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = deal(docs.select("doc_id", "text"), chunks)

    def count(mine: pa.Table) -> pa.Table:
        return tally(unpacked(mine), buckets, mine["chunk"][0].as_py())

    # one pass counts and asks: a chunk's distinct keys with their counts in training texts
    tallies = written(dealt.applyInArrow(count, "kind int, bucket int, keys binary, counts binary, chunk int"))
    model, tokens, types = fit(tallies)
    root = fit_root(model, rounds, samples, burn, seed)

    def reply(known: pa.Table, asked: pa.Table) -> pa.Table:
        asks = [np.frombuffer(x, np.uint64) for x in asked["keys"].to_pylist()]
        if not asks:
            return asked.select(["chunk", "kind", "bucket"]).append_column("values", pa.array([], pa.binary()))
        wanted = merged(asks)[0]
        keys, counts = (np.frombuffer(known[c][0].as_py(), t) if known.num_rows else np.zeros(0, t) for c, t in (("keys", np.uint64), ("counts", np.int64)))
        which, bucket = asked["kind"][0].as_py(), asked["bucket"][0].as_py()
        if which == WORDS:
            value = np.zeros(len(wanted), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                value = np.where(keys[at] == wanted, counts[at], 0)
        else:
            levels, rng = levels_of(keys, counts, 2), rng_of(seed + rounds, bucket)
            for _ in range(burn):
                sweep(levels, root.tables[0], root, rng)
            p = np.zeros(len(wanted))
            for table in root.tables:
                sweep(levels, table, root, rng)
                p += answer(levels, table, root, wanted)
            value = np.log10(p / len(root.tables)).astype(np.float32)
        out = [value[np.searchsorted(wanted, x)].tobytes() for x in asks]
        return asked.select(["chunk", "kind", "bucket"]).append_column("values", pa.array(out, pa.binary()))

    def total_up(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine = unpacked(mine)
        ids, (both, parts) = mine["doc_id"], parts_of(mine["text"].to_pylist())
        table = {}
        for which, keys in both:
            value = np.zeros(len(keys), np.float32 if which == BYTES else np.int64)
            got = {b: v for k, b, v in zip(*[theirs[c].to_pylist() for c in ("kind", "bucket", "values")], strict=True) if k == which}
            for b, at in by_bucket(which, keys, buckets):
                value[at] = np.frombuffer(got[b], value.dtype)
            table[which] = keys, value
        out = {c: [] for c in ("n_tokens", "n_known", "base", "score")}
        for p in parts:
            keys, value = table[BYTES]
            # a text's places are added up at once: where slices part must not show in its score
            logp = np.zeros(len(p.stream.bytes))
            for lo, own, u, i in p.grams:
                logp[lo : lo + len(i)] = np.where(own, value[np.searchsorted(keys, u)].astype(np.float64)[i], 0.0)
            sums = np.add.reduceat(logp, p.stream.starts)
            keys, count = table[WORDS]
            c = count[np.searchsorted(keys, p.words)]
            first = np.cumsum(p.tokens) - p.tokens
            out["n_tokens"] += p.tokens.tolist()
            out["n_known"] += np.add.reduceat((c > 0).astype(np.int64)[p.place], first).tolist()
            out["base"] += np.add.reduceat(np.log10(c + 1.0)[p.place], first).tolist()
            out["score"] += sums.tolist()
        return pa.table({"doc_id": ids, "held_out": pa.array([held_out(d) for d in ids.to_pylist()]), **{c: pa.array(v, pa.float64() if c in ("base", "score") else pa.int64()) for c, v in out.items()}})

    asked = tallies.select("kind", "bucket", "chunk", "keys")
    replies = model.groupBy("kind", "bucket").cogroup(asked.groupBy("kind", "bucket")).applyInArrow(reply, "chunk int, kind int, bucket int, values binary")
    scored = dealt.cogroup(replies.groupBy("chunk")).applyInArrow(total_up, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double")
    weight = float(np.log10(tokens + types + 1))
    base = (F.col("base") - F.col("n_tokens") * F.lit(weight)).alias("base_score")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base, "score")
