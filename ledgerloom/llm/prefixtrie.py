"""Prefix trie of rebuilt conversations by composable fingerprints: the head of one conversation, then the rest of another."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, looked_up, written

#: Primes under 2**31, so that a product of two residues fits a long; one lane of fingerprints for each.
PRIMES = (2_147_483_647, 2_147_483_629)
LANES = range(len(PRIMES))
#: Most turns of a head; conversation ids of a node that are packed into one text.
MOST, PACK = 3, 4_096
WORDS = r"[^\x20\x09-\x0D]+"
#: A node: its depth and the product of its turns in each lane.
NODE = ["d", *(f"f{i}" for i in LANES)]


def _bases(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"base {seed} {i}".encode()).digest()[:8]) % (PRIMES[i] - 2) + 2 for i in LANES]


def _mod(x: Column, lane: int) -> Column:
    return F.pmod(x, F.lit(PRIMES[lane]).cast("long"))


def _power(base: int, exponent: Column, lane: int) -> Column:
    """base ** exponent in a lane, for exponents under 2**32: one product for each bit."""
    one = F.lit(1).cast("long")
    factors = [F.when(F.shiftright(exponent, bit).bitwiseAND(one) == 1, F.lit(pow(base, 1 << bit, PRIMES[lane])).cast("long")).otherwise(one) for bit in range(32)]
    while len(factors) > 1:
        factors = [_mod(x * y, lane) for x, y in zip(factors[::2], factors[1::2], strict=True)]
    return factors[0]


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0).cast("long"))


def _turns(raw: DataFrame, tables: Scratch, seed: int) -> tuple[DataFrame, DataFrame]:
    """(turns, parts): each turn with its place k, its own term e and the prefix product p up to it; each part of a conversation.

    A sequence's product is the sum of hash * base ** place, so products compose: the later one is shifted by a power of
    the base and added. Turns are cut into ranges by (conversation, turn), so a conversation of any length lies in many
    parts. Within a part places and products are taken by a window; what lies before it is composed over the parts.
    """
    base = _bases(seed)
    hashed = raw.select("conv", "turn", F.xxhash64(F.lit(seed), "role", "text").alias("h"), F.size(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).cast("long").alias("w"), *[_mod(F.xxhash64(F.lit(seed), F.lit(i), "role", "text"), i).alias(f"t{i}") for i in LANES])
    order = [F.asc_nulls_first("turn"), F.col("h")]
    ranged = tables.written(hashed.repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id()), "ranged")
    upto = W.partitionBy("conv", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.withColumn("k", F.row_number().over(W.partitionBy("conv", "part").orderBy(*order)).cast("long"))
    local = local.select("*", *[_mod(F.col(f"t{i}") * _power(base[i], F.col("k"), i), i).alias(f"e{i}") for i in LANES])
    local = local.select("conv", "part", "turn", "h", "k", "w", F.sum("w").over(upto).alias("cum"), *[f"e{i}" for i in LANES], *[_mod(F.sum(f"e{i}").over(upto), i).alias(f"p{i}") for i in LANES])
    local = tables.written(local, "local")
    parts = local.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("w").alias("words"), *[_mod(F.sum(f"e{i}"), i).alias(f"s{i}") for i in LANES])
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("*", _zero(F.sum("n").over(before)).alias("k0"), _zero(F.sum("words").over(before)).alias("w0"))
    parts = parts.select("*", *[_power(base[i], F.col("k0"), i).alias(f"m{i}") for i in LANES])
    parts = tables.written(parts.select("*", *[_zero(_mod(F.sum(_mod(F.col(f"s{i}") * F.col(f"m{i}"), i)).over(before), i)).alias(f"c{i}") for i in LANES]), "parts")
    whole = local.join(parts.drop("n", "words"), ["conv", "part"]).select(
        "conv", "part", "turn", "h", "w", (F.col("k") + F.col("k0")).alias("k"), (F.col("cum") + F.col("w0")).alias("cum"),
        *[_mod(F.col(f"e{i}") * F.col(f"m{i}"), i).alias(f"e{i}") for i in LANES], *[_mod(F.col(f"c{i}") + F.col(f"p{i}") * F.col(f"m{i}"), i).alias(f"p{i}") for i in LANES],
    )
    return tables.written(whole, "turns"), parts.select("conv", "part", "n", "words")


def _rebuilt(turns: DataFrame, parts: DataFrame, source: Callable[[Column], Column], head: Callable[[Column], Column], tables: Scratch, seed: int) -> tuple[DataFrame, DataFrame]:
    """(convs, paths): each rebuilt conversation, and a row for each of its prefixes: its product f, its parent's g, the turn it ends in.

    The product of a rebuilt prefix is that of its head plus that of own turns after their head, shifted to where they now
    stand. Neither texts nor lists of turns are rebuilt; a row refers to its turn by (rc, turn, h).
    """
    first = turns.where(F.col("k") <= MOST).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("k", "cum", "w", "turn", "h", *[f"{x}{i}" for x in "ep" for i in LANES]))).alias("first"))  # MOST at most
    convs = parts.groupBy("conv").agg(F.sum("n").alias("own"), F.sum("words").alias("own_words")).join(first, "conv")
    convs = convs.withColumn("source", source(F.col("conv"))).withColumn("gone", F.greatest(F.lit(0), F.least(F.lit(MOST), _zero(head(F.col("conv"))))).cast("int"))
    bases = convs.select(F.col("conv").alias("source"), F.col("first").alias("heads"))
    convs = convs.join(bases, "source", "left").withColumn("heads", F.when(F.col("heads").isNotNull(), F.slice("heads", F.lit(1), F.col("gone"))).otherwise(F.slice("first", 1, 0)))

    def upto(turns: str, n: Column, field: str) -> Column:
        return F.when(n > 0, F.try_element_at(turns, F.greatest(n, F.lit(1)))[field]).otherwise(F.lit(0).cast("long"))

    b, g = F.size("heads"), F.least("gone", "own").cast("int")
    convs = convs.select(
        "conv", "source", "heads", F.col("gone").cast("long").alias("gone"), (F.col("gone") - b).alias("shift"), (b + F.col("own") - g).alias("len"), (upto("heads", b, "cum") - upto("first", g, "cum")).alias("dw"),
        (upto("heads", b, "cum") - upto("first", g, "cum") + F.col("own_words")).alias("total"), *[upto("heads", b, f"p{i}").alias(f"b{i}") for i in LANES], *[upto("first", g, f"p{i}").alias(f"o{i}") for i in LANES],
    )
    convs = tables.written(convs, "convs")
    each = parts.select("conv", "part").join(convs.drop("source", "heads", "total"), "conv")
    back = [F.element_at(F.array(*[F.lit(pow(b, -s, PRIMES[i])).cast("long") for s in range(MOST + 1)]), F.col("shift") + 1) for i, b in enumerate(_bases(seed))]
    product = [_mod(_mod(F.col(f"p{i}") - F.col(f"o{i}"), i) * back[i] + F.col(f"b{i}"), i).alias(f"f{i}") for i in LANES]
    term = [_mod(F.col(f"e{i}") * back[i], i).alias(f"e{i}") for i in LANES]
    own = turns.join(each, ["conv", "part"]).where("k > gone").select("conv", "part", "len", (F.col("k") - F.col("shift")).alias("d"), (F.col("cum") + F.col("dw")).alias("cum"), "w", F.col("conv").alias("rc"), "turn", "h", *product, *term)
    heads = convs.select("conv", "len", "source", F.explode("heads").alias("x")).select("conv", F.lit(-1).alias("part"), "len", "x.k", "x.cum", "x.w", "source", "x.turn", "x.h", *[f"x.p{i}" for i in LANES], *[f"x.e{i}" for i in LANES])
    paths = own.union(heads)
    return convs, tables.written(paths.select(*own.columns[: -len(PRIMES)], *[_mod(F.col(f"f{i}") - F.col(f"e{i}"), i).alias(f"g{i}") for i in LANES]), "paths")


def _sound(paths: DataFrame, raw: DataFrame, seed: int) -> bool:
    """Whether all rows of a node end in equal turns, whose texts are fetched by reference; rows of one and the same turn need none.

    Equal turns have equal terms, so the rows' parents have equal products too, and turn by turn whole prefixes are equal.
    """
    ref = F.struct("rc", "turn", "h")
    mixed = paths.groupBy(*NODE).agg(F.min(ref).alias("a"), F.max(ref).alias("z")).where("a <> z").select(*NODE)
    refs = paths.join(mixed, NODE).select(*NODE, "rc", F.col("turn").alias("rt"), F.col("h").alias("rh")).distinct()
    texts = raw.select("conv", "turn", F.xxhash64(F.lit(seed), "role", "text").alias("h"), F.struct("role", "text").alias("x"))
    met = refs.join(texts, (refs["rc"] == texts["conv"]) & refs["rt"].eqNullSafe(texts["turn"]) & (refs["rh"] == texts["h"]))
    return met.groupBy(*NODE).agg(F.min("x").alias("a"), F.max("x").alias("z")).where("a <> z").isEmpty()


def _ends(ended: DataFrame) -> DataFrame:
    """SHA-256 of each node's ended conversation ids, ascending and joined by commas; ids come packed and sorted, one pack at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in (*range(len(NODE)), len(NODE) + 1)), strict=True):
                if key != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _rows(done)
        yield _rows([(*node, digest.hexdigest())] if node is not None else [])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(NODE))), pa.array([r[-1] for r in rows], pa.string())], [*NODE, "ends_sha256"])

    packs = ended.groupBy(*NODE, F.floor(F.col("conv") / PACK).alias("pack")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))  # PACK at most
    return packs.repartition(*NODE).sortWithinPartitions(*NODE, "pack").mapInArrow(run, ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, source: Callable[[Column], Column] = lambda c: c, head: Callable[[Column], Column] = lambda c: F.lit(0), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    A conversation c is rebuilt from the first ``head(c)`` turns (0 to 3) of conversation ``source(c)`` and its own turns
    after as many. Fingerprints of prefixes are composed from those of heads and of own turns; nodes group equal ones,
    and are verified on the texts of the turns that their rows refer to. Where two texts have equal hashes all is done
    again with other ones, so results are exact.

    A node is named by its smallest member and its depth; the root has depth 0. With the depth from which a conversation
    is the smallest member of its nodes, children, leaves and saved tokens of all subtrees are sums over members: nothing
    climbs the trie, however deep. A long conversation lies in many parts; a node of many members is summed before rows
    are exchanged, and looked up in several places. One task streams a node's ended ids, packed, through its hash.

    Null roles and texts are empty ones, null turn numbers come first, turns of one number in the order of a hash of role
    and text (repeated rows are repeated turns). Rows with a null id take no part; an empty table has no rows, not even a
    root. Ids lie within 53 bits, turns of a conversation within 32. Other columns are ignored.
    """
    raw = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("conv IS NOT NULL")
    with Scratch(conversations.sparkSession) as tables:
        for seed in count():
            turns, parts = _turns(raw, tables, seed)
            convs, paths = _rebuilt(turns, parts, source, head, tables, seed)
            if _sound(paths, raw, seed):
                return written(_nodes(parts, convs, paths, tables), "prefix-trie")


def _nodes(parts: DataFrame, convs: DataFrame, paths: DataFrame, tables: Scratch) -> DataFrame:
    found = paths.groupBy(*NODE).agg(F.count("*").alias("n"), F.count_if(F.col("d") == F.col("len")).alias("ended"), F.min(F.struct("conv", (F.col("cum") - F.col("w")).alias("before"), *[f"g{i}" for i in LANES])).alias("x"))
    found = tables.written(found.select(*NODE, "n", (F.col("n") == F.col("ended")).alias("childless"), "x.*"), "found")
    # from its depth ``s`` on a conversation is its nodes' smallest member; ``before`` are the words above
    owned = found.groupBy("conv").agg(F.min(F.struct("d", "before", *[f"g{i}" for i in LANES])).alias("x"), F.max(F.col("childless").cast("long")).alias("leaf"))
    owned = tables.written(owned.select("conv", "leaf", F.col("x.d").alias("s"), "x.before", (F.col("x.d") - 1).alias("d"), *[F.col(f"x.g{i}").alias(f"f{i}") for i in LANES]), "owned")
    top = convs.agg(F.min("conv")).first()[0]
    above = looked_up(owned.where("s > 1"), found.select(*NODE, "n", F.col("conv").alias("above")), NODE, F.col("n")).select("conv", "leaf", "s", "before", "above")
    above = above.unionByName(owned.where("s = 1").select("conv", "leaf", "s", "before", F.lit(top).cast("long").alias("above")))
    info = convs.select("conv", "len", "total").join(above, "conv", "left")
    info = tables.written(info.withColumn("before", F.coalesce("before", "total")).withColumn("leaf", _zero(F.col("leaf"))), "info")
    dealt = parts.select("conv", "part").union(convs.select("conv", F.lit(-1))).join(info.drop("len"), "conv")
    rows = paths.join(dealt, ["conv", "part"])
    owner = F.coalesce(F.col("d") >= F.col("s"), F.lit(False))
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.max(F.when(owner, F.when(F.col("d") > F.col("s"), F.col("conv")).otherwise(F.col("above")))).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.count_if((F.col("d") + 1 >= F.col("s")) & (F.col("d") < F.col("len"))).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(F.when(owner, 0).otherwise(F.col("before") - F.col("cum") + F.col("w"))).alias("saved_tokens"),
    )
    none = F.lit(0).cast("long")
    root = info.agg(F.min("conv").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("s") == 1).alias("n_children"), F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.sum("before").alias("saved_tokens"))
    nodes = nodes.unionByName(root.where("n_convs > 0").select(*[none.alias(c) for c in NODE], "*"))
    ended = paths.where("d = len").select(*NODE, "conv").union(convs.where("len = 0").select(*[none] * len(NODE), "conv"))
    out = nodes.join(_ends(ended), NODE, "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.coalesce("saved_tokens", none).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
