"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import spare

#: Labelled rows that a fit uses at most: those with the smallest hashes of their ids.
MAX_TRAIN_ROWS = 20_000
#: Rows, drawn with replacement from those of a fit, that one tree grows on at most.
TREE_ROWS = 4_000
TREES, DEPTH, L1, SEED = 24, 3, 0.0005, 7


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of whole texts, all defined for null (as empty) and empty texts."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words, lines = F.split(F.trim(t), r"\s+"), F.split(t, "\n")
    chars, n_words, n_lines = F.greatest(F.length(t), F.lit(1)), F.size(words), F.size(lines)
    return {
        "log_words": F.log(n_words.cast("double")),
        "word_length": chars / n_words,
        "upper": F.regexp_count(t, F.lit(r"\p{Lu}")) / chars,
        "digits": F.regexp_count(t, F.lit(r"\d")) / chars,
        "marks": F.regexp_count(t, F.lit(r"[!?.,;:'\"()-]")) / chars,
        "symbols": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s!?.,;:'\"()-]")) / chars,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "repeats": F.size(F.filter(F.arrays_zip(words.alias("a"), F.slice(words, 2, n_words).alias("b")), lambda x: x["a"] == x["b"])) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_words": n_words / n_lines,
    }


Condition = tuple[int, bool, float]  # statistic, whether it must be over the threshold, threshold


@dataclass(frozen=True)
class RuleEnsemble:
    names: tuple[str, ...]
    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, stats: dict[str, Column]) -> Column:
        """Probability of label 1: conjunctions of comparisons, each adding its weight."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            held = F.lit(True)
            for i, over, cut in rule:
                held = held & ((stats[self.names[i]] > cut) if over else (stats[self.names[i]] <= cut))
            total = total + F.when(held, w).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, path: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Every node's path in one tree grown by squared error over random halves of the statistics."""
    if not depth or len(y) < 10 or y.min() == y.max():
        return []
    best, base = (1e-9, 0, 0.0), ((y - y.mean()) ** 2).sum()
    for i in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
        order = np.argsort(x[:, i], kind="stable")
        v, s = x[order, i], np.cumsum(y[order])
        at = np.arange(1, len(y))
        left, right = s[:-1], s[-1] - s[:-1]
        gain = left**2 / at + right**2 / (len(y) - at) - s[-1] ** 2 / len(y)
        gain[(v[1:] == v[:-1]) | (at < 5) | (len(y) - at < 5)] = 0
        j = int(gain.argmax())
        if gain[j] > best[0]:
            best = (gain[j], int(i), float((v[j] + v[j + 1]) / 2))
    if best[0] < 1e-3 * base:
        return []
    _, i, cut = best
    out = []
    for over in (False, True):
        here = (x[:, i] > cut) == over
        own = (*path, (i, over, cut))
        out += [own, *_paths(x[here], y[here], rng, depth - 1, own)]
    return out


def _lasso(r: np.ndarray, y: np.ndarray, l1: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty by accelerated proximal gradient steps; the bias is free."""
    a = np.hstack([r, np.ones((len(r), 1))])
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * np.linalg.norm(a @ v) ** 2 / len(a) + 1e-12)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -30, 30))) - y) / len(a)
        new = z - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * l1, 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], trees: int = TREES, depth: int = DEPTH, l1: float = L1, seed: int = SEED, tree_rows: int = TREE_ROWS) -> RuleEnsemble:
    """Grow trees on resampled rows (``tree_rows`` at most each), take all paths as rules, keep those with weight under the lasso on all rows.

    With no rows the score is 0.5; with rows of one label, it is that label's smoothed share.
    """
    rate = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(names, (), (), float(np.log(rate / (1 - rate))))
    rng, found = np.random.default_rng(seed), {}
    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), tree_rows))
        for path in _paths(x[rows], y[rows].astype(float), rng, depth):
            held = np.all([(x[:, i] > c) == over for i, over, c in path], 0)
            if 0 < held.sum() < len(y):
                found.setdefault(held.tobytes(), (path, held))
    if not found:
        return RuleEnsemble(names, (), (), float(np.log(rate / (1 - rate))))
    rules, held = zip(*found.values(), strict=True)
    w, bias = _lasso(np.stack(held, 1).astype(float), y.astype(float), l1)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble(names, tuple(rules[i] for i in keep), tuple(float(w[i]) for i in keep), bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS, **options) -> RuleEnsemble:
    """Fit on at most ``max_rows`` labelled documents; statistics of those alone reach the driver. ``options`` go to fit_rules.

    Rows with a null id or label are left out; labels other than 0 count as 1. A repeated id keeps its largest label, and
    of its documents the one with the least statistics counts, so no more than ``max_rows`` rows come back. Equal hashes
    of ids are settled by the id. Very long texts count whole, as their statistics do. Columns of any name may stand
    beside those asked for.
    """
    own = labels.select(F.col(id_col).alias("key"), F.col(label_col).alias("y")).where("key IS NOT NULL AND y IS NOT NULL").groupBy("key").agg(F.max((F.col("y") != 0).cast("int")).alias("y"))
    own = own.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    stats = statistics(F.col("text"))
    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = bare.join(F.broadcast(own), F.col("id") == F.col("key")).select("id", "y", F.struct(*[c.alias(n) for n, c in stats.items()]).alias("s"))
    got = rows.groupBy("id").agg(F.max("y").alias("y"), F.min("s").alias("s")).select("id", "y", "s.*").toPandas().sort_values("id")
    return fit_rules(got[list(stats)].to_numpy(float), got["y"].to_numpy(), tuple(stats), **options)


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the model's score of each whole text; a null or empty text has one too, equal texts have equal ones.

    A column called as ``score_col`` is replaced; all others stay, whatever their names. An empty table stays empty.
    """
    kept = [c for c in docs.columns if c.lower() != score_col.lower()]
    names = {n: spare(docs, f"stat_{n}") for n in statistics(F.col(text_col))}
    full = docs.withColumns({names[n]: c for n, c in statistics(F.col(text_col)).items()})
    return full.select(*[F.col(f"`{c}`") for c in kept], model.score({n: F.col(c) for n, c in names.items()}).alias(score_col))
