"""Shared helpers: working folder, word hashing, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Entries a per-worker cache holds before it starts afresh; bytes of text scanned at once.
CACHE_ENTRIES, SCAN_BYTES = 400_000, 1 << 18
#: Token counts are kept in 2**COUNTER_BITS counters, sent in chunks of 2**CHUNK_BITS.
COUNTER_BITS, CHUNK_BITS = 24, 16

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``, or the one given to setCheckpointDir.

    Where neither is set, a session of one process gets a temporary one; on a cluster, where executors wouldn't see it,
    that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        set_by = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_by.isDefined():
            return set_by.get().rstrip("/")
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing. It stays there."""
    at = fresh_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(table: DataFrame) -> None:
    """Delete the files of a table made by ``written``, of which nothing is read any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0].rsplit("/", 1)[0]) if table.inputFiles() else None
    if path is not None and "/ledgerloom/" in path.toString():
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables in between of one call, in the shared folder, and what it broadcasts; both go when the call ends, so its result mustn't read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.made, self.sent = spark, fresh_path(spark, "scratch"), 0, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failed: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        for b in self.sent:
            b.destroy()

    def broadcast(self, value: object) -> Broadcast:
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        df.write.parquet(at := f"{self.at}/{self.made}-{name}")
        return self.spark.read.schema(df.schema).parquet(at)

    def counted(self, df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
        """As written, with aggregates that are taken while the rows pass."""
        seen = Observation()
        table = self.written(df.observe(seen, *[f.alias(k) for k, f in figures.items()]), name)
        return table, seen.get


def spare(df: DataFrame, name: str, *others: DataFrame) -> str:
    """A column name that ``df`` and ``others`` don't have, in any case."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    while name in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def chain(arrays: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash for each sequence (arrays[0][i], arrays[1][i], ...)."""
    h = mix(arrays[0] + GOLD)
    for a in arrays[1:]:
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + a + GOLD)
    return h


def given_back() -> None:
    """Return what a task has freed to the system: Python workers live on between tasks, and what they hoard counts against their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its own ways
        ctypes.CDLL(None).malloc_trim(0)


SPACES = bytes([9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: By length of what is left of a word: which of eight bytes belong to it.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes of a word that are hashed eight at a time; longer words go through a digest.
LONG_WORD = 64


class WordScan:
    """Hashes of all words of a column of texts, straight from its buffers.

    Words are runs without ``gaps`` bytes, A-Z lower-cased (``latin``: other Latin-1 letters too). Their 64-bit hashes
    take eight bytes at a time, so that the work follows the number of words; no two words of one length up to 8 collide.
    """

    def __init__(self, gaps: bytes = SPACES, latin: bool = False):
        self.solid, self.latin = np.ones(256, bool), latin
        self.solid[list(gaps)] = False

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, hash, row, line of each word): rows in slices of about SCAN_BYTES; lines count line feeds before."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        if not n:
            return
        ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
        row = 0
        while row < n:
            to = max(row + 1, int(np.searchsorted(ends, ends[row] + SCAN_BYTES, "right")) - 1)
            yield row, to, *self._words(data[ends[row] : ends[to]], ends[row : to + 1] - ends[row])
            row = to

    def _words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        low = np.zeros(n + 8, np.uint8)
        np.take(_LOWER, data, out=low[:n])
        if self.latin:
            shift = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            low[1:n][shift] += np.uint8(32)
        solid = self.solid[low[:n]]
        first, last, starts = solid.copy(), solid.copy(), ends[:-1][ends[:-1] < n]
        first[1:] &= ~solid[:-1]
        first[starts] = solid[starts]
        last[:-1] &= ~solid[1:]
        last[starts[starts > 0] - 1] = solid[starts[starts > 0] - 1]
        b = np.flatnonzero(first)
        size = np.flatnonzero(last) + 1 - b
        eight = np.ndarray((n + 1,), "<u8", low, strides=(1,))
        h = mix((eight[b] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * GOLD)
        more, done = np.flatnonzero(size > 8), 8
        while len(more) and done < LONG_WORD:
            left = size[more] - done
            h[more] = mix(h[more] * M1 + (eight[b[more] + done] & _MASK[np.minimum(left, 8)]))
            more, done = more[left > 8], done + 8
        for i in more:
            h[i] = int.from_bytes(hashlib.blake2b(low[b[i] : b[i] + size[i]], digest_size=8).digest(), "little")
        row = np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(b, ends)))
        feeds = np.flatnonzero(data == 10)
        line = np.repeat(np.arange(len(feeds) + 1), np.diff(np.concatenate([[0], np.searchsorted(b, feeds), [len(b)]])))
        return h, row, line - np.searchsorted(feeds, ends[:-1])[row]


def counter_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def level_of(count: float) -> int:
    return 1 + round(8 * float(np.log2(count)))


def rarity(rows: DataFrame, tokens_of: Callable[[], Callable[[pa.RecordBatch], Iterator[np.ndarray]]]) -> np.ndarray:
    """How often each counter's tokens occur, as level_of(count) in a byte; 0: never, 1: once.

    The table's size doesn't depend on the data. Tokens that share a counter share a level; that costs filtering
    power, never results, where levels only put all rows' tokens into one order. Tokens are 64-bit hashes.
    """
    chunk = 1 << CHUNK_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, get = np.zeros(1 << COUNTER_BITS, np.uint32), tokens_of()
        for batch in batches:
            for tokens in get(batch):
                at, n = np.unique(counter_of(tokens), return_counts=True)
                table[at] += n.astype(np.uint32)
        parts = table.reshape(-1, chunk)
        for k in np.flatnonzero(parts.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pa.compress(parts[k].tobytes(), "zstd", asbytes=True)], pa.binary())], ["chunk", "counts"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(chunk, np.int64)
        for c in rows["counts"]:
            total += np.frombuffer(pa.decompress(c, 4 * chunk, "zstd", asbytes=True), np.uint32)
        level = np.where(total > 0, 1 + np.round(8 * np.log2(np.maximum(total, 1))), 0)
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "levels": [np.minimum(level, 255).astype(np.uint8).tobytes()]})

    out = np.zeros(((1 << COUNTER_BITS) // chunk, chunk), np.uint8)
    for r in rows.mapInArrow(counted, "chunk long, counts binary").groupBy("chunk").applyInPandas(summed, "chunk long, levels binary").collect():  # as many rows as chunks at most
        out[r["chunk"]] = np.frombuffer(r["levels"], np.uint8)
    return out.reshape(-1)


def bitmap(names: DataFrame) -> np.ndarray:
    """Bitmap (packed, of fixed size) over the leading bits of ``name`` (a hash); a bit too many costs time only."""
    per = 1 << CHUNK_BITS

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(per, bool)
        own[rows["bit"].to_numpy()] = True
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "bits": [np.packbits(own).tobytes()]})

    top = F.shiftrightunsigned("name", 64 - COUNTER_BITS)
    dealt = names.select(F.shiftright(top, CHUNK_BITS).alias("chunk"), top.bitwiseAND(F.lit(per - 1)).alias("bit")).distinct()
    out = np.zeros(((1 << COUNTER_BITS) // per, per // 8), np.uint8)
    for r in dealt.groupBy("chunk").applyInPandas(gather, "chunk long, bits binary").collect():  # as many rows as chunks at most
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def flagged(df: DataFrame, name: str, bits: np.ndarray, into: str) -> DataFrame:
    """``df`` with ``into``: whether the hash ``name`` may be in the bitmap; by join with its chunks, a table of fixed size."""
    chunk, own = spare(df, "chunk"), spare(df, "bits")
    rows = [b.tobytes() for b in bits.reshape(-1, (1 << CHUNK_BITS) // 8)]
    chunks = df.sparkSession.createDataFrame(pa.table({chunk: pa.array(range(len(rows)), pa.int64()), own: pa.array(rows, pa.binary())}))
    top = F.shiftrightunsigned(name, 64 - COUNTER_BITS)
    bit = top.bitwiseAND(F.lit((1 << CHUNK_BITS) - 1))
    byte = F.conv(F.hex(F.substring(F.col(own), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.getbit(byte, (7 - bit.bitwiseAND(F.lit(7))).cast("int")) == 1
    return df.withColumn(chunk, F.shiftright(top, CHUNK_BITS)).join(F.broadcast(chunks), chunk).withColumn(into, on).drop(chunk, own)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` isn't among ``ids`` (a column of that name), nulls too; only those that may be meet the ids in an exchange."""
    h, may = spare(df, "hashed"), spare(df, "may")
    bits = bitmap(ids.select(F.xxhash64(key).alias("name")))
    own = flagged(df.withColumn(h, F.xxhash64(key)), h, bits, may)
    return own.where(~F.col(may)).unionByName(own.where(may).join(ids.select(key).distinct(), key, "left_anti")).select(*df.columns)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: Column, large: int = 1_000, places: int = 64) -> DataFrame:
    """``rows`` with the columns that ``table`` (one row per key, no null keys) has for their keys.

    Keys of more than ``large`` rows by ``weight`` (a column over ``table``) are met in several ``places``. No column but
    the keys may be in both.
    """
    h, may, place = (spare(rows, n, table) for n in ("hashed", "may_be_large", "place"))
    bits = bitmap(table.where(weight > large).select(F.xxhash64(*keys).alias("name")))
    dealt = F.pmod(F.xxhash64(*rows.columns), F.lit(places)).cast("int")
    own = flagged(rows.withColumn(h, F.xxhash64(*keys)), h, bits, may).withColumn(place, F.when(F.col(may), dealt).otherwise(0)).drop(h, may)
    each = F.explode(F.when(F.col(may), F.sequence(F.lit(0), F.lit(places - 1))).otherwise(F.array(F.lit(0))))
    met = flagged(table.withColumn(h, F.xxhash64(*keys)), h, bits, may).withColumn(place, each).drop(h, may)
    return own.join(met, [*keys, place]).drop(place)


def marked(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = (names.view(np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0


def components_in(edges: DataFrame, tables: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """As connected_components, in a table that goes with ``tables``."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    now = tables.written(edges.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").select(hi.alias("u"), lo.alias("v")).distinct(), "edges")
    settled = False
    while True:
        # large star: an edge's lower end gives way to its own lowest neighbour
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        step = now.join(low.toDF("k", "m"), F.col("v") == F.col("k"), "left")
        large, seen = tables.counted(step.select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")), "edges", edges=F.count("*"), moved=F.count_if("moved"))
        if not seen["moved"] and (settled or not seen["edges"]):
            break
        # small star: a node keeps its lowest neighbour, to which the others move
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.select("u", "v").join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(1).alias("moved"))
        both = moved.union(low.select("u", F.col("m").alias("v"), F.lit(0).alias("moved"))).groupBy("u", "v").agg(F.max("moved").alias("moved"))
        now, after = tables.counted(both, "edges", moved=F.sum("moved"))
        now, settled = now.select("u", "v"), not after["moved"]
        if settled and not seen["moved"]:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return tables.written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id for every id in ``edges``: columns (node, component), in a written table.

    Alternates large-star and small-star steps on written edge tables until neither moves an edge. Each step is a
    grouped minimum, partly taken before rows are exchanged, and a join of the edges with it; where a hub's edges meet
    in that join, adaptive execution splits them. Null ends and loops are ignored, repeated edges count once, and an
    empty table has no rows.
    """
    with Scratch(edges.sparkSession) as tables:
        return written(components_in(edges, tables, a, b), "components")
