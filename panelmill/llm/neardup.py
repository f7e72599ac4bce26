"""Near-duplicates: banded MinHash candidates, checked by odd sketches, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, shingle_set, width, written

SAMPLES, ROWS = 125, 5  # 25 bands of 5: at a similarity of 0.8, 1 of 20,000 links has no band; at 0.85, 1 of 2 million
BITS = 512
BLOCK = 1024
_rng = np.random.default_rng(7)
MULTIPLY = _rng.integers(0, 1 << 63, SAMPLES, np.int64).astype(np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, SAMPLES, np.int64).astype(np.uint64)


def min_hashes(codes: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of 64-bit codes."""
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), 4096):
        part = codes[at : at + 4096, None] * MULTIPLY + ADD
        np.minimum(low, (part ^ (part >> np.uint64(29))).min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: bit b is set when an odd number of (place, sample) pairs fall on it."""
    bit = (mix(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=BITS) % 2 == 1).view(np.uint64)


def most_apart(share: float) -> int:
    """Most bits by which the sketches of two sets of that similarity differ.

    Each sample that differs flips two bits at most. Samples differ by a binomial law; the bound lies 5.6 deviations above
    its mean, so about one link in ten million is lost here.
    """
    off = 1 - share
    return int(2 * (SAMPLES * off + 5.6 * (SAMPLES * off * share) ** 0.5 + 1))


def bands(samples: np.ndarray) -> np.ndarray:
    key = np.zeros(SAMPLES // ROWS, np.uint64)
    for column in samples.reshape(-1, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return mix(key + np.arange(len(key), dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, a, b, bands, sketch) of each row; a and b name its shingle set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, keys, sketches = [], [], [], [], []
            for text in batch.column(1):
                codes = shingle_set(text.as_py(), size)
                low = min_hashes(codes)
                n.append(len(codes))
                x, y = set_name(codes)
                a.append(x), b.append(y)
                keys.append(bands(low).tolist() if len(codes) else [])
                sketches.append(odd_sketch(low).tobytes())
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "a", "b", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n long, a long, b long, bands array<long>, sketch binary")


def set_name(codes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of codes."""
    x, y = mix(codes).sum(dtype=np.uint64), mix(codes ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return tuple(np.array([x, y], np.uint64).view(np.int64).tolist())


def forest(linked) -> list[tuple[int, int]]:
    """A spanning forest over n things; ``linked`` yields for each of them the later ones it is linked with."""
    label, out = None, []
    for i, n, mates in linked:
        if label is None:
            label = np.arange(n)
        mates = mates[label[mates] != label[i]]
        if len(mates):
            roots, first = np.unique(label[mates], return_index=True)
            out += [(i, int(mates[j])) for j in first]
            label[np.isin(label, np.append(roots, label[i]))] = min(int(label[i]), int(roots.min()))
    return out


def in_blocks(df: DataFrame, group: str) -> DataFrame:
    """Give the rows of each group of two or more to the pairs of its blocks: columns i <= j of the pair.

    A group of up to BLOCK rows is one pair (0, 0). A larger one is split, and a row goes to each pair with its block. The pairs are dealt
    out one by one, so those of a crowded group do not meet in one task.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_m"))
    sized = df.join(sizes.where("_m > 1"), group)
    parts = F.ceil(F.col("_m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(3)), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, F.col("_own")).alias("i"), F.greatest(k, F.col("_own")).alias("j")))
    dealt = sized.withColumn("_own", own).withColumn("_pair", F.explode(pairs)).select(*df.columns, "_pair.i", "_pair.j")
    return dealt.repartition(width(df), group, "i", "j")


def alike(apart: int):
    """Forest edges of a bucket's members whose odd sketches differ by ``apart`` bits at most."""

    def link(rows: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        rep, n = rows["rep"].to_numpy(), len(x)

        def near():
            for i in range(n - 1):
                far = np.bitwise_count(x[i + 1 :] ^ x[i]).sum(axis=1)
                yield i, n, i + 1 + np.flatnonzero(far <= apart)

        edges = forest(near())
        return pa.table({"a": pa.array([rep[i] for i, _ in edges], pa.int64()), "b": pa.array([rep[j] for _, j in edges], pa.int64())})

    return link


def confirm(percent: int):
    """Forest edges between members whose whole sets have 100 * common >= percent * union."""

    def link(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in rows["codes"].to_pylist()]
        rep, n = rows["rep"].to_numpy(), len(sets)
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        _, local = np.unique(flat, return_inverse=True)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        mark = np.zeros(local.max() + 1, np.int32)

        def near():
            for i in range(n - 1):
                mark[local[start[i] : start[i] + size[i]]] = 1
                common = np.add.reduceat(mark[local[start[i + 1] :]], start[i + 1 :] - start[i + 1])
                mark[local[start[i] : start[i] + size[i]]] = 0
                yield i, n, i + 1 + np.flatnonzero(100 * common >= percent * (size[i] + size[i + 1 :] - common))

        edges = forest(near())
        return pa.table({"a": pa.array([rep[i] for i, _ in edges], pa.int64()), "b": pa.array([rep[j] for _, j in edges], pa.int64())})

    return link


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Classes of linked documents: (doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id long, text).

    Words are runs between ASCII white space with A-Z in lower case; a document's set is its distinct shingles of ``size`` words, or all
    its words as one shingle if they are fewer. Documents are linked when 100 * common >= percent * union of their sets.

    1. Equal sets become one class. 2. Classes that share a band of MinHash samples meet in a bucket; there the odd sketches say
    which are alike, with a margin for what a sketch can miss. 3. Only what sketches connect is confirmed on whole sets: the sets of a
    connected part meet in one place, and a document is compared with all others there by one lookup of its shingles. Buckets and parts above
    BLOCK members are split into pairs of blocks, and a block returns the links of a spanning forest, never all its pairs: connected
    classes stay connected and rows stay in proportion to members. A band is lost by chance for one link in 20,000 at a similarity of 0.8.

    A null or empty text, or one without words, has no shingles and is linked with nothing. Repeated rows are one class. A row
    without an id belongs to the class of its set; component_id is the smallest id there is (null if none); kept is true where doc_id and
    component_id are equal or both null. An empty table gives no rows. Other columns are not read.
    """
    rows = written(signed(docs, size))
    named = rows.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    named = written(named.where("rep is not null"))
    # a row for each id, as ids may repeat over different texts
    reps = named.select("rep", "sketch", F.explode("bands").alias("band"), F.struct("n", "a", "b").alias("name"))
    reps = reps.select(F.xxhash64("name").alias("rep"), "sketch", "band")
    alive = in_blocks(reps, "band")
    rough = alive.select("band", "i", "j", "rep", "sketch").groupBy("band", "i", "j").applyInArrow(alike(most_apart(percent / 100)), "a long, b long")
    parts = components(rough.distinct())

    keyed = named.select("rep", "n", "a", "b", F.xxhash64(F.struct("n", "a", "b")).alias("node"))
    wanted = keyed.join(parts, "node").select(F.col("rep").alias("doc_id"), F.col("node").alias("rep"), F.col("a").alias("wa"), F.col("b").alias("wb"), "label")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [shingle_set(t.as_py(), size) for t in batch.column(2)]
            right = [i for i, (c, x, y) in enumerate(zip(codes, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)) if set_name(c) == (x, y)]
            took = batch.take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array([codes[i].tobytes() for i in right], pa.binary())], ["label", "rep", "codes"])

    texts = docs.select("doc_id", "text").join(wanted, "doc_id").select("label", "rep", "text", "wa", "wb")
    sets = texts.mapInArrow(fetch, "label long, rep long, codes binary").dropDuplicates(["label", "rep"])
    sure = in_blocks(sets, "label").select("label", "i", "j", "rep", "codes").groupBy("label", "i", "j").applyInArrow(confirm(percent), "a long, b long")
    joined = components(sure)

    classes = keyed.join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classes.groupBy("label").agg(F.min("rep").alias("component"))
    of = classes.join(least, "label").select("n", "a", "b", "component")
    out = rows.select("doc_id", "n", "a", "b").join(of, ["n", "a", "b"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
