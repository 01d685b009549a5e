"""Hard negatives by a secondary sort: packed (anchor, descending score, id) keys, read as a stream for each anchor."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, written
from ledgerloom.llm.topk import integers

#: Vectors of a block of candidates and of a block of anchors; anchors that a task scores at once.
BLOCK, ANCHORS, TOGETHER = 8_192, 16_384, 256
TOP, LOW, HIGH = 5, 80, 100

#: Anchor, turned score, whether it is a negative, id: as bytes that sort like the numbers.
_KEY, _TURN = struct.Struct(">QQBQ"), 1 << 63


def packed(anchor: int, score: int, negative: bool, other: int) -> bytes:
    return _KEY.pack(anchor + _TURN, _TURN - 1 - score, negative, other + _TURN)


def unpacked(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, other = _KEY.unpack(key)
    return anchor - _TURN, _TURN - 1 - score, bool(negative), other - _TURN


def mined(keys: Iterator[bytes], positives: int = TOP, negatives: int = TOP, low: int = LOW, high: int = HIGH) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score) from sorted keys.

    Keys come by anchor and falling score; of one score positives first, then by id. A positive opens a window that takes
    the next ``negatives`` within low * positive <= 100 * negative <= high * positive. At any time at most ``positives``
    windows are held, whatever the number of an anchor's rows.
    """
    anchor, opened, windows = None, 0, []
    for key in keys:
        a, score, negative, other = unpacked(key)
        if a != anchor:
            anchor, opened, windows = a, 0, []
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([other, score, 0])
        elif windows:
            for w in windows:
                if low * w[1] <= 100 * score <= high * w[1]:
                    w[2] += 1
                    yield a, w[0], w[2], other, w[1], score
            windows = [w for w in windows if w[2] < negatives and 100 * score >= min(low * w[1], high * w[1])]


def _leading(score: np.ndarray, ids: np.ndarray, may: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``top`` highest scores among those that may count, ties to the smaller id; columns come by id."""
    least = np.iinfo(np.int64).min
    s = np.where(may, score, least)
    n = s.shape[1]
    if n > top:
        cut = np.partition(s, n - top, axis=1)[:, n - top]
        row, col = np.nonzero(may & (s >= cut[:, None]))
    else:
        row, col = np.nonzero(may)
    order = np.lexsort((ids[col], -s[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < top], col[place < top]


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; by doubles where they hold every sum exactly."""
    exact = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 2**53
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if exact else a @ b.T


def _matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


def _pairs(found: list[tuple]) -> pa.Table:
    columns = [np.concatenate([*(f[c] for f in found), np.empty(0, np.int64)]).astype(np.int64) for c in range(3)]
    return pa.table(dict(zip(("anchor", "score", "other"), columns, strict=True)))


def _met(dims: int, anchors: pa.Table, cand: pa.Table) -> Iterator[tuple]:
    """Slices of anchors with their scores against a block of candidates: (first row, anchors' ids, candidates' ids, scores, same label, other id)."""
    ids, rows, label = anchors["id"].to_numpy(), _matrix(anchors["v"], dims), anchors["label"].to_numpy()
    others, vectors, labels = cand["id"].to_numpy(), _matrix(cand["v"], dims), cand["label"].to_numpy()
    for s in range(0, len(ids), TOGETHER):
        own = slice(s, s + TOGETHER)
        yield s, ids[own], others, _scores(rows[own], vectors), label[own, None] == labels[None, :], ids[own, None] != others[None, :]


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256,
    positives: int = TOP, negatives: int = TOP, low: int = LOW, high: int = HIGH, block: int = BLOCK, anchor_block: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and its first positives.

    Scores are integer inner products of floor(scale * component); higher ones come first, ties by smaller id. An anchor's
    positives are its first ``positives`` other rows of its label; a positive's negatives the first ``negatives`` rows of
    another label with low * positive <= 100 * negative <= high * positive (``high`` at most 100), ranked from 1.

    Scored pairs are packed into (anchor, descending score, positives first, id) keys, sorted within the partitions of
    their anchors, and mined as a stream (``mined``). Only pairs that can matter go there: of each block of candidates an
    anchor's first positives, and, once these are known, for each window the block's first negatives within it. So what
    is exchanged for an anchor grows with blocks, not with rows, and no label or vector is hot. Candidates are dealt in
    blocks and meet one block of anchors after the other.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Only vectors of equal
    length are compared; rows with the anchor's own id aren't its candidates; a repeated anchor id counts once, by its
    smallest label and vector; other repeated rows each count. An anchor without positives, and a positive without
    negatives in its window, has no rows; so has an empty table. Scores are exact while they fit 56 bits. Other columns
    are ignored.
    """
    if high > 100:
        raise ValueError("a window opens at its positive: high is at most 100")
    spark = vectors.sparkSession
    label = F.col("label") if label is None else label
    own = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), integers(F.col(vector_col), scale).alias("v"), is_anchor.alias("q")).where("id IS NOT NULL AND v IS NOT NULL AND label IS NOT NULL")
    with Scratch(spark) as tables:
        own, seen = tables.counted(own.withColumn("d", F.size("v")), "vectors", n=F.count("*"), anchors=F.count(F.when(F.col("q"), 1)))
        blocks, anchor_blocks = (seen.get("n") or 0) // block + 1, (seen.get("anchors") or 0) // anchor_block + 1
        each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
        cand = own.select("id", "label", "v", "d", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("b"), each(anchor_blocks).alias("ab"))
        first = own.where("q").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x"))
        first = tables.written(first.select("id", "x.label", "x.v", F.size("x.v").alias("d"), F.pmod(F.xxhash64("id"), F.lit(anchor_blocks)).alias("ab")), "anchors")
        keys = ["d", "b", "ab"]

        def positive(key: tuple, anchors: pa.Table, others: pa.Table) -> pa.Table:
            found = []
            if anchors.num_rows and others.num_rows:
                for _, ids, other, score, same, apart in _met(key[0].as_py(), anchors, others):
                    row, col = _leading(score, other, same & apart, positives)
                    found.append((ids[row], score[row, col], other[col]))
            return _pairs(found)

        def negative(key: tuple, anchors: pa.Table, others: pa.Table) -> pa.Table:
            found = []
            if anchors.num_rows and others.num_rows:
                windows = anchors["windows"].to_pylist()
                for s, ids, other, score, same, apart in _met(key[0].as_py(), anchors, others):
                    need = [set() for _ in ids]
                    for k in range(positives):
                        p = np.array([w[k] if len(w) > k else np.iinfo(np.int64).max // 128 for w in windows[s : s + len(ids)]])[:, None]
                        row, col = _leading(score, other, ~same & apart & (low * p <= 100 * score) & (100 * score <= high * p), negatives)
                        for r, c in zip(row.tolist(), col.tolist(), strict=True):
                            need[r].add(c)
                    row = np.repeat(np.arange(len(ids)), [len(x) for x in need])
                    col = np.array([c for x in need for c in sorted(x)], np.int64)
                    found.append((ids[row], score[row, col], other[col]))
            return _pairs(found)

        kind = "anchor long, score long, other long"
        met = first.withColumn("b", each(blocks)).groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInArrow(positive, kind)
        turn = W.partitionBy("anchor").orderBy(F.desc("score"), "other")
        best = tables.written(met.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= positives).drop("turn"), "positives")
        windows = best.groupBy("anchor").agg(F.collect_list("score").alias("windows"))  # as many as positives
        asks = first.join(windows, F.col("id") == F.col("anchor")).drop("anchor").withColumn("b", each(blocks))
        met = asks.groupBy(*keys).cogroup(cand.toDF(*cand.columns).groupBy(*keys)).applyInArrow(negative, kind)

        both = best.withColumn("negative", F.lit(False)).unionByName(tables.written(met.withColumn("negative", F.lit(True)), "negatives"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = both.rdd.map(lambda r: (packed(r.anchor, r.score, r.negative, r.other), None))
        rows = rows.repartitionAndSortWithinPartitions(parts, lambda key: int.from_bytes(key[:8]) * 0x9E3779B97F4A7C15 >> 13)
        out = rows.mapPartitions(lambda part: mined((k for k, _ in part), positives, negatives, low, high))
        return written(spark.createDataFrame(out, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"), "hard-negatives")
