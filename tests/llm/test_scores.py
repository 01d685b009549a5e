"""Scores worked out anew from the fitted models, and odd columns."""

import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import rules, toxicity

TEXTS = ["", None, "Plain words here. And more, of them!", "!!! $$$ ### 123", "same same same\nsame same same\n\nX", "ÉTÉ d\'été 12 — ok", "w" * 5_000, "a b " * 20_000]


def stats_of(text):
    t = text or ""
    words, lines = re.split(r"[ \t\n\x0b\f\r]+", t.strip(" ")), t.split("\n")
    chars, n, m = max(len(t), 1), len(words), len(lines)
    marks = "!?.,;:\'\"()-"
    return {
        "log_words": math.log(n), "word_length": chars / n, "upper": sum(c.isupper() for c in t) / chars, "digits": sum(c in "0123456789" for c in t) / chars, "marks": sum(c in marks for c in t) / chars,
        "symbols": sum(not (c.isalnum() or c in marks or c in " \t\n\x0b\f\r") for c in t) / chars, "distinct_words": len(set(words)) / n, "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "distinct_lines": len(set(lines)) / m, "line_words": n / m,
    }


def test_quality_scores_by_hand(spark):
    docs = spark.createDataFrame([(i, (f"good words in line {i}. " if i % 3 else f"$$$ {i} !!! ### {i}\n") * 5, "x", 1, 2) for i in range(300)], "doc_id long, text string, __y string, __id int, stat_upper int")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(1).alias("text"))
    model = rules.train(docs, labels, tree_rows=200)
    assert model.rules and {r.score > 0.5 for r in rules.score(docs, model).where("doc_id % 3 <> 0").collect()} == {True}
    odd = spark.createDataFrame([(i, t, "kept", 7, 0.25) for i, t in enumerate(TEXTS)] + [(0, "", "kept", 7, 0.25)], "doc_id long, text string, __upper string, stat_upper int, Score double")
    rows = rules.score(odd, model).collect()
    assert len(rows) == len(TEXTS) + 1 and rows[0].asDict().keys() == {"doc_id", "text", "__upper", "stat_upper", "score"} and {(r["__upper"], r.stat_upper) for r in rows} == {("kept", 7)}
    for r in rows:
        s = stats_of(r.text)
        total = model.bias + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((s[model.names[i]] > c) == over for i, over, c in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9), r.text
    assert rules.score(odd.limit(0), model).count() == 0 and rules.train(docs.limit(0), labels).rules == ()


def test_toxicity_scores_by_hand(spark):
    """The logit is the bias and the weight of each word, pair and skip pair that a text has, once."""
    docs = spark.createDataFrame([(i, f"you are bad {i % 7} person" if i % 4 == 0 else f"we had a nice {i % 7} day") for i in range(400)], "doc_id long, text string")
    names, weights, bias = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")))
    known = dict(zip(names.tolist(), weights.tolist(), strict=True))
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "you are bad", "YOU are, are bad bad", "a nice you"])], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.score) for r in toxicity.with_score(odd, (names, weights, bias)).collect()}
    scan = toxicity.WordScan(toxicity._GAPS, latin=True)
    import pyarrow as pa

    for text, score in got.values():
        found = set()
        for _, _, h, row, _ in scan.parts(pa.array([text])):
            for k in range(len(h)):
                for f, _ in [toxicity.features(h[[k, *([j] if j is not None else [])]], row[[k, *([j] if j is not None else [])]]) for j in (None, k + 1 if k + 1 < len(h) else None)]:
                    found |= set(f.tolist())
                if k + 2 < len(h):
                    found |= set(toxicity.features(h[[k, k + 1, k + 2]], row[[k, k + 1, k + 2]])[0].tolist())
        logit = bias + sum(known.get(f, 0.0) for f in found)
        assert score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-9)
