"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, WordScan, chain, counter_of, given_back, level_of, mix, rarity, spare

#: Labelled rows that a fit uses at most (those with the smallest hashes of their ids).
MAX_TRAIN_ROWS = 24_000
#: Weights that may be broadcast (the penalty doubles until they fit), and the bits of a feature's hash.
MAX_WEIGHTS, BITS = 100_000, 40
ALPHA, BETA, LAMBDA1, LAMBDA2, EPOCHS, LEAST_DOCS = 1.0, 1.0, 8.0, 0.0, 8, 3
#: Score at which a document counts as toxic, and what recall weighs against precision where that cut is set.
CUT, RECALL_WEIGHT = 0.7, 0.5

_GAPS = bytes(c for c in range(128) if not chr(c).isalnum())
_DROP = np.uint64(64 - BITS)


def features(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, of neighbours and of words with one between, within each owner (document); and their owners."""
    out, of = [mix(words) >> _DROP], [owner]
    for gap in (1, 2):
        here = owner[gap:] == owner[:-gap]
        out.append((chain([words[:-gap], words[gap:]])[here] ^ np.uint64(gap << 8)) >> _DROP)
        of.append(owner[gap:][here])
    return np.concatenate(out), np.concatenate(of)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = WordScan(_GAPS, latin=True)
    for batch in batches:
        for start, end, h, row, _ in scan.parts(batch.column(2)):
            f, of = features(h, row)
            order = np.lexsort((f, of))
            f, of = f[order], of[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (of[1:] != of[:-1])
            offsets = np.searchsorted(of[new], np.arange(end - start + 1)).astype(np.int32)
            part = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(f[new].view(np.int64)))], ["id", "y", "features"])


def _frequent(shared: Broadcast, least: int):
    """Rows with only those features that may occur in ``least`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            f, n = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy()
            on = levels[counter_of(f.view(np.uint64) << _DROP)] >= level_of(least)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n)[on], minlength=len(n)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(f[on]))], ["id", "y", "features"])

    return run


class Bags:
    """Features of rows in one flat array, and where each row's begin: no row has an array of its own."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray):
        self.flat, self.starts = flat, starts

    def __len__(self) -> int:
        return len(self.starts) - 1

    def of(self, row: int) -> np.ndarray:
        return self.flat[self.starts[row] : self.starts[row + 1]]


def ftrl(bags: Bags, y: np.ndarray, order: np.ndarray, epochs: int = EPOCHS, l1: float = LAMBDA1, max_weights: int = MAX_WEIGHTS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over binary features: (features, weights other than 0, bias), each coordinate with its own rate.

    Rows are taken in ``order``. The L1 penalty ``l1`` is doubled and the fit done again while more than ``max_weights``
    weights are left.
    """
    names, counts = np.unique(bags.flat, return_counts=True)
    names = names[counts >= LEAST_DOCS]
    at, known = np.zeros(len(bags.flat), np.int32), np.zeros(len(bags.flat), bool)
    for k in range(0, len(at) if len(names) else 0, 1 << 20):  # in pieces: places of all features at once would be as large as the features
        part = bags.flat[k : k + (1 << 20)]
        at[k : k + (1 << 20)] = place = np.minimum(np.searchsorted(names, part), len(names) - 1)
        known[k : k + (1 << 20)] = names[place] == part
    ends = np.concatenate([[0], np.cumsum(known)])[bags.starts[1:]]
    own = Bags(np.insert(at[known], ends, np.int32(len(names))), np.concatenate([[0], ends]) + np.arange(len(bags) + 1))  # a row's last one is the bias
    del at, known
    while True:
        z, n = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
        least = np.append(np.full(len(names), l1), 0.0)

        def weights(at: np.ndarray) -> np.ndarray:
            return np.where(np.abs(z[at]) <= least[at], 0.0, -(z[at] - np.sign(z[at]) * least[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + LAMBDA2))

        for _ in range(epochs):
            for i in order:
                at = own.of(i)
                w = weights(at)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y[i]
                n2 = n[at] + g * g
                z[at] += g - (np.sqrt(n2) - np.sqrt(n[at])) / ALPHA * w
                n[at] = n2
        w = weights(np.arange(len(names) + 1))
        keep = np.flatnonzero(w[:-1])
        if len(keep) <= max_weights:
            return names[keep], w[keep], float(w[-1])
        l1 *= 2


def _logits(model: tuple[np.ndarray, np.ndarray, float], bags: Bags) -> np.ndarray:
    names, weights, bias = model
    out = np.full(len(bags), bias)
    for k in range(len(bags) if len(names) else 0):
        r = bags.of(k)
        at = np.minimum(np.searchsorted(names, r), len(names) - 1)
        out[k] += weights[at][names[at] == r].sum()
    return out


def best_cut(logits: np.ndarray, y: np.ndarray, recall_weight: float = RECALL_WEIGHT) -> float | None:
    """Where rows are best told apart (F measure with ``recall_weight``), halfway between two of them; null with one label."""
    if not len(y) or y.min() == y.max():
        return None
    order = np.argsort(-logits, kind="stable")
    caught, last = np.cumsum(y[order]), np.append(np.diff(logits[order]) != 0, True)
    b = recall_weight**2
    f = np.where(last, (1 + b) * caught / (np.arange(1, len(y) + 1) + b * y.sum()), -1)
    k = int(f.argmax())
    return float(logits[order[k]] - 1 if k + 1 == len(y) else (logits[order[k]] + logits[order[k + 1]]) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, cut: float = CUT, max_weights: int = MAX_WEIGHTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most ``max_rows`` labelled documents: sorted features, their weights and the bias.

    Weights are broadcast when texts are scored, so there are ``max_weights`` of them at most: a vocabulary that leaves
    more is fitted under a doubled penalty (the given tables stay below a hundredth of that).
    Three fits run side by side: one on all rows, and one on either half, which then scores the other. A fit gets its own
    rows only, in batches, and holds their features once. The bias is then moved
    so that ``cut`` is where those scores tell the halves' rows apart best, precision before recall. Rows with a null id
    or label are left out; a repeated id keeps its largest label, and each of its documents counts. Null and empty texts
    have no features; an empty table or one without labels gives a bias of 0, so every score is 0.5. Extra columns are
    ignored.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label_col) != 0).cast("int")).alias("__y"))
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    bare = docs.select(F.col(id_col).alias("__key"), F.col(text_col).cast("string").alias("text"))
    bare = bare.join(F.broadcast(own), F.col("__key") == F.col("__id")).select(F.col("__id").cast("string").alias("id"), "__y", "text")
    kind = "id string, y int, features array<long>"

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said, sizes, flats = [], [], []
        for batch in batches:  # features are copied out, so that no batch outlives the next
            said.append(batch.select(["id", "y", "text"]))
            sizes.append(batch["features"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flats.append(batch["features"].flatten().to_numpy().copy())
        del batch
        rows = pa.Table.from_batches(said)
        starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        flat, k = np.empty(starts[-1], np.int64), 0
        while flats:
            flat[k : k + len(flats[0])] = flats[0]
            k += len(flats.pop(0))
        by_id = pc.sort_indices(rows.select(["id", "text"]), [("id", "ascending"), ("text", "ascending")]).to_numpy()
        f, w, bias = ftrl(Bags(flat, starts), rows["y"].to_numpy().astype(float), by_id[np.random.default_rng(11).permutation(len(by_id))], max_weights=max_weights)
        del flat
        given_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f) + 1, key[0].as_py()), pa.int32()), pa.array(np.append(f, -1)), pa.array(np.append(w, bias))], ["part", "feature", "weight"])

    def other_half(shared: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models = shared.value
            for batch in batches:
                lists, half = batch.column(1), batch.column(2).to_numpy()
                bags = Bags(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]))
                logits = np.choose(half, [_logits(models[1], bags), _logits(models[0], bags)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logits)], ["y", "logit"])

        return run

    with Scratch(docs.sparkSession) as tables:
        rows = tables.written(bare.mapInArrow(_featured, kind), "features")
        levels = tables.broadcast(rarity(rows.select("features"), lambda: lambda batch: [batch.column(0).flatten().to_numpy().view(np.uint64) << _DROP]))
        half = F.pmod(F.xxhash64("id"), F.lit(2)).cast("int")
        kept = rows.mapInArrow(_frequent(levels, LEAST_DOCS), kind).withColumns({"half": half, "text": F.xxhash64("features")})
        got = kept.withColumn("part", F.explode(F.array("half", F.lit(2)))).drop("half").groupBy("part").applyInArrow(run, "part int, feature long, weight double").toPandas().sort_values(["part", "feature"])
        models = []
        for part in range(3):
            f, w = (got.loc[got["part"] == part, c].to_numpy() for c in ("feature", "weight"))
            models.append((f[f >= 0], w[f >= 0], float(w[f == -1].sum())))
        scored = rows.select("y", "features", half.alias("half")).mapInArrow(other_half(tables.broadcast(models[:2])), "y int, logit double").toPandas().sort_values(["y", "logit"], ascending=[False, True])
    at = best_cut(scored["logit"].to_numpy(), scored["y"].to_numpy().astype(float))
    shift = 0.0 if at is None else float(np.log(cut / (1 - cut))) - at
    return models[2][0], models[2][1], models[2][2] + shift


def with_score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text; null and empty texts score by the bias. A column called as ``score_col`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.drop(score_col)
    names_of, text = [*own.columns, score_col], spare(own, "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, bias = shared.value
        names, scan = names.astype(np.uint64), WordScan(_GAPS, latin=True)
        low = np.zeros(1 << 22, bool)
        low[(names & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for start, end, h, row, _ in scan.parts(batch.column(batch.num_columns - 1)):
                f, of = features(h, row)
                may = low[(f & np.uint64((1 << 22) - 1)).astype(np.int64)]
                f, of = f[may], of[may]
                if len(f):
                    at = np.minimum(np.searchsorted(names, f), len(names) - 1)
                    hit = names[at] == f
                    seen = np.unique(of[hit] * np.int64(len(names)) + at[hit])
                    total[start:end] += np.bincount(seen // len(names), weights[seen % len(names)], end - start)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], names_of)

    schema = own.withColumn(score_col, F.lit(0.0)).schema
    return own.withColumn(text, F.col(text_col).cast("string")).mapInArrow(run, schema)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text; null and empty texts score by the bias. Other columns are ignored."""
    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_score(bare, model).select(F.col("id").alias(id_col), "score")
