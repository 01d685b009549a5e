import hashlib
import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from ledgerloom.llm import prefixtrie, queries

KIND = "conv_id long, turn long, role string, text string, d long, part int"


def by_hand(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = []
    for k, members in nodes.items():
        under = [x for x in nodes if x[: len(k)] == k]
        leaves = [x for x in under if not any(y[:-1] == x for y in nodes if y)]
        saved = sum((len(nodes[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in under if x)
        ends = ",".join(str(c) for c in sorted(members) if built[c] == k)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), sum(1 for x in under if len(x) == len(k) + 1), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], KIND)
    got = prefixtrie.prefix_trie(table, lambda c: c - c % 20, lambda c: F.crc32(c.cast("string").cast("binary")) % 4)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)


def test_against_rebuilt_lists(spark):
    """Shared heads and tails, copies, missing bases, turnless rebuilds, nulls, and one conversation with a third of all turns."""
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b c", "", None, " \t", "d e  f"])
    rows = [(c, t, rng.choice(["user", "bot", None]), word()) for c in range(90) for t in range(rng.randint(1, 5))]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 118) for t in range(4)]
    rows += [(c, 1, "user", "alone") for c in range(203, 219)]
    rows += [(120, t, "bot", f"x {t % 3}") for t in range(200)] + [(141, t, "bot", f"x {t % 3}") for t in range(200)]
    rows += [(300, None, "user", "first"), (300, -5, "user", "second"), (None, 1, "user", "nobody"), (5_000_000_000, 1, "user", "far"), (5_000_000_001, 1, "user", "far")]
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], KIND)
    assert prefixtrie.prefix_trie(empty).count() == 0
    check(spark, [(203, 1, "user", "only head turns")])  # its head is missing, so that nothing may be left
    check(spark, [(c, 1, "user", "w " * 200_000) for c in range(3)])
    only = spark.createDataFrame([(7, 1, "user", "x", 1, 1), (8, 1, "user", "x", 1, 1)], KIND)
    assert [(r.depth, r.n_convs) for r in prefixtrie.prefix_trie(only).orderBy("depth").collect()] == [(0, 2), (1, 2)]


def test_equal_hashes_are_noticed(spark):
    rows = spark.createDataFrame([(1, 1, "user", "one text"), (2, 1, "user", "another")], "conv long, turn long, role string, text string")
    same = rows.select("conv", F.lit(1).alias("d"), F.lit(5).alias("f0"), F.lit(6).alias("f1"), F.col("conv").alias("rc"), "turn", F.xxhash64(F.lit(0), "role", "text").alias("h"))
    assert not prefixtrie._sound(same, rows, 0)
    assert prefixtrie._sound(same, rows.withColumn("text", F.when(F.col("conv") == 1, F.col("text"))).where("conv = 1"), 0)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = queries.op13_trie(spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE['op13_trie']})").fetchall()
    own = sorted(map(tuple, got.collect()), key=str)
    assert own == sorted(want, key=str) == by_hand(rows)
