"""Tests of operators on cases that an earlier version of them left out."""

import random
import textwrap

import corpus_pipeline
from ledgerloom.llm import licences, queries


def _bigrams(text):
    w = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return set(zip(w, w[1:]))


def _dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0


def test_licences_of_wrapped_notices_and_common_kinds(spark):
    known = licences.TEMPLATES
    prose = ["some words about other things that go on here", "", "and a second line of them with more to say"]
    rows, want = [], {}
    for i, (licence, text) in enumerate(known):
        lines = textwrap.wrap(text, 76)
        rows.append((i, "\n".join([*prose, *lines, *prose])))
        want[i] = (licence, len(prose), 1.0)
    k = next(k for k, (_, x) in enumerate(known) if x.endswith("following conditions:"))
    rows += [(1000, "Licensed under CC BY-NC 4.0."), (1001, "\n".join(prose)), (None, rows[k][1]), (1002, "x\nLicensed under the\n\nMIT License.\ny")]
    want |= {1000: ("CC-BY-NC-4.0", 0, 1.0), 1001: (None, None, None), None: want[k], 1002: ("MIT", 1, 1.0)}
    got = {r.doc_id: (r.licence, r.line, r.dice) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), licences.templates(spark)).collect()}
    assert got == want


def test_runs_of_lines_brute_force(spark):
    rng = random.Random(8)
    known = [(f"L{k}", " ".join(f"w{rng.randrange(30)}" for _ in range(n))) for k, n in enumerate([6, 15, 40])]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(20))]
        for _ in range(rng.randint(1, 2)):
            own = rng.choice(known)[1].split()
            if rng.random() < 0.7:
                own[rng.randrange(len(own))] = "other"
            words += own + [f"w{rng.randrange(30)}" for _ in range(rng.randrange(20))]
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\n", "\n\n"]) for w in words)))
    want = set()
    for i, text in rows:
        lines = text.split("\n")
        n = [len(x.split()) for x in lines]
        full = [k for k in range(len(lines)) if n[k]]
        for t, (_, template) in enumerate(known):
            b = _bigrams(template)
            units = {(k, k): _dice(_bigrams(lines[k]), b) for k in full}
            whole = _dice(_bigrams(text), b) if len(lines) > 1 else 0
            for s in full:
                for e in full:
                    if s < e and (s, e) != (full[0], full[-1]) and 2 * len(b) <= 3 * (sum(n[s : e + 1]) - 1) <= 4.5 * len(b):
                        units[s, e] = _dice(_bigrams("\n".join(lines[s : e + 1])), b)
            units = {u: d for u, d in units.items() if d >= 0.8}
            rank = {u: (d, u[0] - u[1], -u[0]) for u, d in units.items()}
            for u in units:
                if u[0] == u[1] or units[u] > (whole if whole >= 0.8 else 0) and all(rank[u] >= rank[v] for v in units if v[0] <= u[1] and u[0] <= v[1]):
                    want.add((i, *u, t))
            if whole >= 0.8:
                want.add((i, -1, -1, t))
    got = {(r.doc_id, r.line, r["last"], r.template) for r in licences.licence_matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), licences.templates(spark, known)).collect()}
    assert got == want and sum(a < b for _, a, b, _ in got) > 10


def test_lines_of_any_length_brute_force(spark, tmp_path):
    rng = random.Random(9)
    pool = [[f"t{rng.randrange(12)}" for _ in range(rng.randint(1, 7))] for _ in range(60)] + [["Les."], ["日本語の行です。"], ["All", "rights", "reserved."], []]
    rows = [(i, "\n".join(" ".join(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    seen, want = [], {}
    for i, text in rows:
        want[i] = []
        for k, line in enumerate(text.split("\n")):
            s = set(line.lower().split())
            if s:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    want[i].append(k)
                seen.append(s)
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rng.sample(rows, len(rows))], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: [int(k) for k in r.removed.split()] for r in queries.op7_lines(spark, str(tmp_path)).collect()}
    assert got == want
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) for i, t in rows}
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()} == kept
