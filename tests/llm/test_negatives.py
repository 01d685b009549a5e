import math
import random

import duckdb
import pytest

from ledgerloom.llm import negatives, queries

KIND = "vec_id long, embedding array<double>, label int, id string, score double"


def by_hand(rows, anchors, low=80, high=100, top=5):
    good = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    firsts = {}
    for i, v, lab in good:
        if i in anchors and (i not in firsts or (lab, v) < firsts[i]):
            firsts[i] = (lab, v)
    out = []
    for a, (lab, v) in firsts.items():
        s = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, w, other in good if i != a and len(w) == len(v))
        for p, i, _ in [x for x in s if x[2] == lab][:top]:
            fit = [x for x in s if x[2] != lab and low * -p <= 100 * -x[0] <= high * -p][:top]
            out += [(a, i, k, x[1], -p, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


def test_keys_sort_like_numbers():
    rng = random.Random(1)
    rows = [(rng.randint(-9, 9), rng.choice([0, -5, 7, 2**55, -(2**55)]), rng.random() < 0.5, rng.randint(-(2**62), 2**62)) for _ in range(300)]
    assert [negatives.unpacked(k) for k in sorted(negatives.packed(*r) for r in rows)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_stream_takes_ties_on_both_sides():
    rows = [(1, 10, True, 2), (1, 10, False, 9), (1, 8, True, 5), (1, 7, True, 6), (1, -3, False, 4), (2, 0, False, 1), (2, 0, True, 3), (2, -1, True, 7)]
    keys = sorted(negatives.packed(*r) for r in rows)
    assert list(negatives.mined(iter(keys))) == [(1, 9, 1, 2, 10, 10), (1, 9, 2, 5, 10, 8), (2, 1, 1, 3, 0, 0)]


@pytest.mark.parametrize("block,anchor_block", [(negatives.BLOCK, negatives.ANCHORS), (40, 7)])
def test_against_all_pairs(spark, block, anchor_block):
    """Ties, repeated rows and ids, vectors of two lengths, nulls and clashing names; in one block and in many."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], rng.choice([0, 0, 0, 1, 2])) for i in range(-20, 280)]
    rows += rows[40:60] + [(i, [rng.random(), rng.random()], i % 3) for i in range(300, 330)] + [(20, [0.5, 0.5, 0.5, 0.5], 1)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0], 0), (400, None, 0), (401, [1.0, None, 1.0, 1.0], 0), (402, [1.0, math.nan, 1.0, 1.0], 0), (403, [1.0, math.inf, 0.0, 0.0], 0), (404, [1.0, 1.0, 1.0, 1.0], None), (405, [], 0)]
    table = spark.createDataFrame([(*r, "x", 0.5) for r in rows], KIND)
    got = sorted(tuple(r) for r in negatives.hard_negatives(table, table.vec_id % 10 == 0, block=block, anchor_block=anchor_block).collect())
    want = by_hand(rows, {i for i, _, _ in rows if i is not None and i % 10 == 0})
    assert got == want and len(want) > 200
    assert negatives.hard_negatives(table.limit(0), table.vec_id % 10 == 0).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = queries.op12_negatives(spark, sf)
    want = con.execute(queries.ORACLE["op12_negatives"]).df()[got.columns].values.tolist()
    assert sorted(map(list, got.collect())) == sorted(want) and len(want)
