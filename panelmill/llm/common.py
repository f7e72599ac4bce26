"""What several operators share: tables between steps, word codes, connected components."""

from __future__ import annotations

import contextlib
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.ipc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.session import ensure_checkpoint_dir

T = TypeVar("T")
SPACE = r"[ \x09-\x0D]"
WORD = r"[^ \x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lists that ``written`` adds the tables it makes to, the innermost last.
_NOTED: list[list[str]] = []


@contextlib.contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Note in ``paths`` which tables are written inside."""
    _NOTED.append(paths)
    try:
        yield
    finally:
        _NOTED.pop()


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete these tables, and let Spark delete the shuffle files of frames that nobody holds any more."""
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared checkpoint folder and read on from there.

    Later steps then neither recompute what stands before, nor depend on an executor that held it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _NOTED:
        _NOTED[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def width(df: DataFrame) -> int:
    """Partitions that shuffles of this session make."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class Codes(dict):
    """64-bit codes of words, kept as long as they are few."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = code
        return code


def per_process(key, make: Callable[[], T]) -> T:
    """What ``make`` returned in this process under ``key``. Kernels travel by value, so a module's own globals live for a task only."""
    kept = sys.modules.setdefault("_panelmill_kept", types.ModuleType("_panelmill_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_codes(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(per_process("codes", Codes).__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct codes of the word shingles of a text; a shorter text is one shingle, no words give none."""
    w = word_codes(text)
    if not len(w):
        return w
    take = min(size, len(w))
    h = np.full(len(w) - take + 1, take, np.uint64)
    for i in range(take):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - take + 1 + i])
    return np.unique(h)


def chunk_of(chunks: int):
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")


def deal(docs: DataFrame, chunks: int):
    """Documents (doc_id, text) dealt into chunks by a hash, grouped by chunk: (chunk, data), a compressed part for each batch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column(2).to_numpy()
            order = np.argsort(chunk, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(chunk[order]) != 0))[: len(order)]
            rows = [order[a:b] for a, b in zip(first, np.append(first[1:], len(order)), strict=False)]
            data = [packed(batch.select(["doc_id", "text"]).take(pa.array(x))) for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[order[first]], pa.int32()), pa.array(data, pa.binary())], ["chunk", "data"])

    own = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text").withColumn("chunk", chunk_of(chunks))
    return own.mapInArrow(pack, "chunk int, data binary").groupBy("chunk")


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(rows: pa.Table) -> pa.Table:
    """The documents (doc_id, text) of a chunk."""
    tables = [pa.ipc.open_stream(x).read_all() for x in rows["data"].to_pylist()]
    if not tables:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    return pa.concat_tables(tables).combine_chunks()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label the nodes of ``edges`` (a, b) with the smallest node they can reach: (node, label).

    Each round hangs every node's larger neighbours, then its smaller ones, under its smallest neighbour, until nothing
    moves; the edges never grow, and a round is a pair of aggregates and joins, so a hub is no one task's work.
    """

    def small_first(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    now, before = written(small_first(edges)), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = small_first(large)
        under = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(under, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(under.select("a", F.col("m").alias("b")))
        now = written(small_first(small))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("the components did not settle")
    labels = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def looked_up(rows: DataFrame, known: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows with the columns of ``known``, which has one row for each of the keys that the rows have (left join).

    A key with many rows is dealt over salts, taken from the columns ``by``: each salt that occurs fetches its own copy of the key's row.
    """
    salt, = free_name(rows, "_salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(width(rows))).cast("int"))
    each = dealt.groupBy(*keys, salt).agg(F.lit(1).alias("_one")).drop("_one").join(known, keys)
    return dealt.join(each, [*keys, salt], "left").drop(salt)
