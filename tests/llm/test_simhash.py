import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import queries, simhash

LONG = " ".join(f"Word{i % 977}" for i in range(120_000))
ODD = ["", None, " \n\t ", "One", "one two", "ONE two THREE", "one  two\nthree", "a b c a b c a b c", "é 日本語 \x1c x y", "w" * 700 + " " + "v" * 40 + " u", "x" * 600_000 + " y z", LONG, "\x00a b", "one two three four"]


def by_hand(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = np.array([xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)) if len(h) else 0


def components(prints):
    """Smallest id reachable, for (id, fingerprint) rows, by comparing all pairs."""
    ids = np.array([i for i, _ in prints])
    p = np.array([x for _, x in prints], np.uint64)
    near = (np.bitwise_count(p[:, None] ^ p[None, :]) <= 3) | (ids[:, None] == ids[None, :])
    label = ids.copy()
    while True:
        low = np.where(near, label[None, :], label.max()).min(1)
        if (low == label).all():
            return dict(zip(ids.tolist(), label.tolist(), strict=True))
        label = low


def test_fingerprints_by_hand():
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["a", "Bc", "d" * 9, "é" * 20, "z" * 90]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    got = simhash.fingerprints(pa.array(texts, pa.string()))
    assert got.tolist() == [by_hand(t) for t in texts]
    assert simhash.fingerprints(pa.array(texts, pa.string()).slice(3, 9)).tolist() == got[3:12].tolist()
    assert len(simhash.fingerprints(pa.array([], pa.string()))) == 0


def test_keys_find_every_pair_within_three_bits():
    golay, rng = simhash.Golay(), np.random.default_rng(1)
    assert golay.count.tolist().count(6) == 1771 and set(golay.count.tolist()) == {1, 6}
    base = rng.integers(0, 2**64, 3_000, np.uint64)
    other = base.copy()
    for _ in range(3):
        other ^= np.where(rng.random(len(base)) < 0.9, np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64), np.uint64(0))
    ka, ra, ca = simhash.keys_of(base, golay)
    kb, rb, cb = simhash.keys_of(other, golay)
    core_a, near_b = {*zip(ra[ca].tolist(), ka[ca].tolist(), strict=True)}, {*zip(rb.tolist(), kb.tolist(), strict=True)}
    assert {r for r, _ in core_a & near_b} == set(range(len(base)))
    core_b, near_a = {*zip(rb[cb].tolist(), kb[cb].tolist(), strict=True)}, {*zip(ra.tolist(), ka.tolist(), strict=True)}
    assert {r for r, _ in core_b & near_a} == set(range(len(base)))


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_components_against_all_pairs(spark, crowd):
    """Clusters of near fingerprints, chains, repeats and odd ids; small crowds take the way over blocks."""
    rng = random.Random(crowd)
    prints = [(i, rng.getrandbits(64)) for i in range(150)]
    for _ in range(6):
        centre = rng.getrandbits(64)
        prints += [(len(prints) + i, centre ^ sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randint(0, 4))})) for i in range(60)]
        prints.sort(key=lambda x: rng.random())
        prints = [(i, x) for i, (_, x) in enumerate(prints)]
    prints += [(7, rng.getrandbits(64)), (7, prints[3][1])]
    rows = [(i, x - (x >> 63 << 64)) for i, x in prints]
    got = simhash.linked(spark.createDataFrame([*rows, (None, rows[0][1])], "id long, print long"), crowd=crowd).collect()
    want = components(prints)
    assert len(got) == len(prints) + 1
    assert {tuple(r) for r in got} == {(i, x, want[i]) for i, x in rows} | {(None, rows[0][1], None)}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    want = components([(i, by_hand(t)) for i, t in enumerate(ODD)])
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{by_hand(t):016x}", want[i]) for i, t in enumerate(ODD)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.where(F.col("doc_id") == 1)).first().fingerprint == "0" * 16


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op11_simhash(spark, "/root/testdata/sf0.001").collect()}
    prints = [(r.doc_id, by_hand(r.text)) for r in docs]
    want = components(prints)
    assert got == {i: (f"{x:016x}", want[i]) for i, x in prints}
