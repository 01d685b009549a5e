"""Near duplicates by SimHash: fingerprints of word shingles that differ in few bits, found by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SCAN_BYTES, SPACES, Scratch, components_in, looked_up, written

WORDS, BITS, SEED = 3, 3, 42
#: Members of a bucket that one task compares with each other; larger buckets are cut into blocks of this size.
CROWD = 2_048

# The five primes of XXH64.
PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
#: Shingles of more bytes are hashed one by one by the library, shorter ones all together.
LONG_SHINGLE = 256

_SOLID = np.ones(256, bool)
_SOLID[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANES = np.uint64(0x0101010101010101)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _turned(acc + lane * PRIMES[1], 31) * PRIMES[0]


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of ``data`` (bytes, with eight to spare at the end) at once."""
    p1, p2, p3, p4, p5 = PRIMES
    n = len(data) - 8
    eight, four = np.ndarray((n + 1,), "<u8", data, strides=(1,)), np.ndarray((n + 1,), "<u4", data, strides=(1,))
    h = np.full(len(start), seed, np.uint64) + p5
    at, left = start.astype(np.int64), size.astype(np.int64)
    big = np.flatnonzero((left >= 32) & (left <= LONG_SHINGLE))
    if len(big):
        acc = [np.full(len(big), x, np.uint64) for x in (seed + int(p1) + int(p2) & 2**64 - 1, seed + int(p2) & 2**64 - 1, seed, seed - int(p1) & 2**64 - 1)]
        live = np.arange(len(big))
        while len(live):
            rows = big[live]
            for k in range(4):
                acc[k][live] = _round(acc[k][live], eight[at[rows] + 8 * k])
            at[rows] += 32
            left[rows] -= 32
            live = live[left[big[live]] >= 32]
        whole = _turned(acc[0], 1) + _turned(acc[1], 7) + _turned(acc[2], 12) + _turned(acc[3], 18)
        for a in acc:
            whole = (whole ^ _round(np.uint64(0), a)) * p1 + p4
        h[big] = whole
    h += size.astype(np.uint64)
    rows = np.flatnonzero((left >= 8) & (size <= LONG_SHINGLE))
    while len(rows):
        h[rows] = _turned(h[rows] ^ _round(np.uint64(0), eight[at[rows]]), 27) * p1 + p4
        at[rows] += 8
        left[rows] -= 8
        rows = rows[left[rows] >= 8]
    rows = np.flatnonzero((left >= 4) & (size <= LONG_SHINGLE))
    h[rows] = _turned(h[rows] ^ (four[at[rows]].astype(np.uint64) * p1), 23) * p2 + p3
    at[rows] += 4
    left[rows] -= 4
    rows = np.flatnonzero((left >= 1) & (size <= LONG_SHINGLE))
    while len(rows):
        h[rows] = _turned(h[rows] ^ (data[at[rows]].astype(np.uint64) * p5), 11) * p1
        at[rows] += 1
        left[rows] -= 1
        rows = rows[left[rows] >= 1]
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size > LONG_SHINGLE):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes(), seed)
    return h


def _hashes(data: np.ndarray, ends: np.ndarray, words: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all word shingles of texts that lie one after the other; ``short``: of whole texts of fewer words too."""
    n = len(data)
    low = np.take(_LOWER, data)
    solid = _SOLID[low]
    first, last, starts = solid.copy(), solid.copy(), ends[:-1][ends[:-1] < n]
    first[1:] &= ~solid[:-1]
    first[starts] = solid[starts]
    last[:-1] &= ~solid[1:]
    last[starts[starts > 0] - 1] = solid[starts[starts > 0] - 1]
    b = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - b
    # one gap byte after each word stays, as a space
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    low[~solid] = 32
    at = np.cumsum(keep)[b] - 1
    compact = np.concatenate([low[keep], np.zeros(8, np.uint8)])
    count = np.diff(np.searchsorted(b, ends))
    row = np.repeat(np.arange(len(ends) - 1), count)
    end = at + size
    head = np.flatnonzero(row[: len(row) - words + 1] == row[words - 1 :]) if len(row) >= words else np.empty(0, np.int64)
    start, stop, rows = at[head], end[head + words - 1], row[head]
    few = np.flatnonzero((count > 0) & (count < words)) if short else np.empty(0, np.int64)
    if len(few):
        lead = (np.cumsum(count) - count)[few]
        start, stop, rows = np.concatenate([start, at[lead]]), np.concatenate([stop, end[lead + count[few] - 1]]), np.concatenate([rows, few])
        order = np.argsort(rows, kind="stable")
        start, stop, rows = start[order], stop[order], rows[order]
    return xxh64(compact, start, stop - start), rows


def _counts(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How often each of 64 bits is set in the hashes of each of ``n`` rows (ascending): byte lanes take up to 255 hashes each."""
    out = np.zeros((n, 64), np.int64)
    if len(h):
        lead = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        place = np.arange(len(h)) - np.repeat(lead, np.diff(np.concatenate([lead, [len(h)]])))
        cut = np.flatnonzero(place % 255 == 0)
        lanes = np.stack([np.add.reduceat((h >> np.uint64(k)) & _LANES, cut) for k in range(8)], 1)  # lane of byte j, shift k: bit 8 j + k
        np.add.at(out, row[cut], lanes.view(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64))
    return out


def _long_text(data: np.ndarray, words: int) -> tuple[np.ndarray, int]:
    """(bit counts, hashes) of one long text, in slices that end at gaps; the last words of a slice go before the next."""
    total, n, at, carry = np.zeros(64, np.int64), 0, 0, b""
    while at < len(data):
        to = min(len(data), at + SCAN_BYTES)
        while to < len(data) and _SOLID[data[to]]:
            gap = np.flatnonzero(~_SOLID[data[to : to + SCAN_BYTES]])
            to = to + int(gap[0]) if len(gap) else min(len(data), to + SCAN_BYTES)
        own = np.frombuffer(carry + b" " + data[at:to].tobytes(), np.uint8)
        h, row = _hashes(own, np.array([0, len(own)]), words, short=to == len(data) and not n)
        total, n, at = total + _counts(h, row, 1)[0], n + len(h), to
        carry = b" ".join(own.tobytes().split()[-(words - 1) :]) if words > 1 else b""
    return total, n


def fingerprints(texts: pa.Array, words: int = WORDS) -> np.ndarray:
    """SimHash of whole texts: a bit is 1 if set in over half the XXH64 of all word shingles, repeats included.

    A-Z is lower-cased and words are runs without ASCII white space, joined by one space. A text of fewer words is one
    shingle; one without words, or null, has fingerprint zero.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + SCAN_BYTES, "right")) - 1)
        own = data[ends[row] : ends[to]]
        if len(own) > SCAN_BYTES:
            counts, total = _long_text(own, words)
            counts, total = counts[None, :], np.array([total])
        elif len(own):
            h, rows = _hashes(own, ends[row : to + 1] - ends[row], words)
            counts, total = _counts(h, rows, to - row), np.bincount(rows, minlength=to - row)
        else:
            counts, total = np.zeros((to - row, 64), np.int64), np.zeros(to - row, np.int64)
        out[row:to] = (np.where(2 * counts > total[:, None], weights, np.uint64(0))).sum(1, dtype=np.uint64)
        row = to
    return out


class Golay:
    """The perfect binary Golay code of 23 bits: every word lies within three bits of exactly one codeword.

    A word three bits from its own codeword has five more at four bits, any other has none; so ``near`` lists one or six
    codeword indices. Words that differ in one bit share the index that either decodes to.
    """

    GENERATOR = 0b110001110101

    def __init__(self) -> None:
        high = np.arange(1 << 12, dtype=np.int64) << 11
        for bit in range(22, 10, -1):
            high = np.where(high >> bit & 1, high ^ (self.GENERATOR << bit - 11), high)
        self.high = high  # what is left of the 12 leading bits modulo the generator
        flips = np.array([sum(1 << i for i in c) for k in range(5) for c in combinations(range(23), k)], np.int64)
        syndrome = self.syndrome(flips)
        order = np.argsort(syndrome, kind="stable")  # fewer bits first
        syndrome, flips = syndrome[order], flips[order]
        place = np.arange(len(flips)) - np.searchsorted(syndrome, syndrome)
        self.count = np.bincount(syndrome, minlength=1 << 11)
        self.flips = np.zeros((1 << 11, 6), np.int64)
        self.flips[syndrome, place] = flips

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.high[words >> 11] ^ (words & 0x7FF)

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices, how many): of each word's codewords within four bits, the nearest first."""
        s = self.syndrome(words)
        return (words[:, None] ^ self.flips[s]) >> 11, self.count[s]


#: Bits of the three segments of a fingerprint.
SEGMENTS = (22, 21, 21)


def keys_of(prints: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, core) of fingerprints: any two within three bits share a key that is core for either of them.

    Three errors over three segments leave one segment whole and another with at most one error, or one error in each.
    First kind of key: a whole segment and a nearby codeword index of another (six ordered pairs). Second kind: a nearby
    index of the first segment, and a whole half of each of the others, since one error spares a half (four choices).
    The index that a segment decodes to is core, the others aren't: of two segments with one error between them, either's
    own index is near the other.
    """
    parts, to = [], 64
    for bits in SEGMENTS:
        to -= bits
        parts.append((prints >> np.uint64(to)).astype(np.int64) & (1 << bits) - 1)
    near = [golay.near(p) for p in parts]
    row, turn = np.arange(len(prints)), np.arange(6)
    halves = [(p >> 10, p & 0x3FF) for p in parts]
    kinds = [(j, parts[i] << 12) for i in range(3) for j in range(3) if i != j] + [(0, (halves[1][x] << 11 | halves[2][y]) << 12) for x in range(2) for y in range(2)]
    keys, rows, cores = [], [], []
    for kind, (j, rest) in enumerate(kinds):
        index, count = near[j]
        key = (rest[:, None] | index) << 4 | kind
        some = turn < count[:, None]
        keys.append(key[some])
        rows.append(np.broadcast_to(row[:, None], key.shape)[some])
        cores.append(np.broadcast_to(turn == 0, key.shape)[some])
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(cores)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for batch in batches:
        for s in range(0, batch.num_rows, 4_096):
            prints = batch.column(0).slice(s, 4_096).to_numpy()
            key, row, core = keys_of(prints.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row]), pa.array(core)], ["key", "print", "core"])


def forest(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, may: np.ndarray | None, bits: int) -> list[tuple[int, int]]:
    """Links (row of a, row of b) within ``bits`` bits that join all labels which such links join, and no more of them than that.

    ``may``: which pairs to look at (rows of a by rows of b), or all. Rows of ``a`` are compared a block at a time.
    """
    la, lb, links = la.copy(), lb.copy(), []
    for s in range(0, len(a), 256):
        close = np.bitwise_count(a[s : s + 256, None] ^ b[None, :]) <= bits
        if may is not None:
            close &= may[s : s + 256]
        for i, row in enumerate(close, s):
            while len(js := np.flatnonzero(row & (lb != la[i]))):
                old, new = lb[js[0]], la[i]
                lb[lb == old], la[la == old] = new, new
                links.append((i, int(js[0])))
    return links


def _joined(bits: int, crowd: int):
    """Streams rows sorted by key. Links of a bucket come out as rows (a, b, null); a bucket of over ``crowd`` members as (key, null, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]

        def settled(key: np.ndarray, prints: np.ndarray, core: np.ndarray) -> tuple[list, list]:
            lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            size = np.diff(np.concatenate([lead, [len(key)]]))
            links, crowded = [], []
            for s, n in zip(lead[size > 1], size[size > 1], strict=True):
                own = slice(s, s + n)
                if n > crowd:
                    crowded.append(int(key[s]))
                elif core[own].any():
                    p = prints[own]
                    at = np.flatnonzero(core[own])
                    got = forest(p[at].view(np.uint64), p.view(np.uint64), at, np.arange(n), None, bits)
                    links += [(int(p[at[i]]), int(p[j])) for i, j in got]
            return links, crowded

        def batch_of(links: list, crowded: list) -> pa.RecordBatch:
            a, b = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([*a, *[None] * len(crowded)], pa.int64()), pa.array([*b, *[None] * len(crowded)], pa.int64()), pa.array([*[None] * len(links), *crowded], pa.int64())], ["a", "b", "crowded"])

        past = None  # a crowded key whose members still come
        for batch in batches:
            key, prints, core = (np.concatenate([x, y.to_numpy(zero_copy_only=False)]) for x, y in zip(held, batch.columns, strict=True))
            fresh = key != past if past is not None else np.ones(len(key), bool)
            key, prints, core = key[fresh], prints[fresh], core[fresh]
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            links, crowded = settled(key[:cut], prints[:cut], core[:cut])
            held = [key[cut:], prints[cut:], core[cut:]]
            if len(held[0]) > crowd:
                past = int(held[0][0])
                crowded.append(past)
                held = [x[:0] for x in held]
            yield batch_of(links, crowded)
        yield batch_of(*settled(*held))

    return run


def _across(bits: int):
    """Links between one block of a crowded bucket's members outside its main component and one block of all its members."""

    def run(key: tuple, few: pa.Table, all_: pa.Table) -> pa.Table:
        links: list = []
        if few.num_rows and all_.num_rows:
            a, b = few["print"].to_numpy(), all_["print"].to_numpy()
            core = few["core"].to_numpy()[:, None] | all_["core"].to_numpy()[None, :]
            got = forest(a.view(np.uint64), b.view(np.uint64), few["component"].to_numpy(), all_["component"].to_numpy(), core, bits)
            links = [(int(a[i]), int(b[j])) for i, j in got]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _crowded(rows: DataFrame, links: DataFrame, tables: Scratch, bits: int, crowd: int) -> DataFrame:
    """Links of crowded buckets that the links so far leave out.

    Members of a bucket's largest component so far meet the others only; both are dealt out in blocks, and each pair of
    blocks returns as many links as it joins components.
    """
    component = components_in(links, tables).withColumnRenamed("node", "print")
    now = tables.written(rows.join(component, "print", "left").withColumn("component", F.coalesce("component", "print")), "crowded")
    sizes = now.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("most < n")
    main = tables.written(main.select("key", "main", F.ceil(F.col("n") / crowd).alias("blocks"), F.ceil((F.col("n") - F.col("most")) / crowd).alias("few_blocks")), "main")
    mixed = now.join(main, "key")
    block = lambda n: F.pmod(F.xxhash64("print", F.lit("block")), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    few = mixed.where("component <> main").withColumn("x", block("few_blocks")).withColumn("y", each("blocks"))
    all_ = mixed.withColumn("y", block("blocks")).withColumn("x", each("few_blocks"))
    all_ = all_.toDF(*all_.columns)  # names of their own, or the two sides can't be told apart
    got = few.groupBy("key", "x", "y").cogroup(all_.groupBy("key", "x", "y")).applyInArrow(_across(bits), "a long, b long")
    return got.distinct()


def with_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Rows (id, print): the fingerprint of each text as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), words).view(np.int64))], ["id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, print long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """One row per input row: (id, fingerprint as 16 hex digits, component_id: the smallest id reachable over links).

    ``words`` a shingle; see ``fingerprints`` and ``linked``. Null or empty texts have fingerprint zero and link like any
    other. Ids are whole numbers, or texts of such. An empty table has no rows; other columns are ignored.
    """
    out = linked(with_prints(docs, id_col, text_col, words), bits, crowd)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def linked(prints: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Rows (id, print) with component_id, the smallest id reachable over fingerprints within ``bits`` (at most three) bits.

    Equal fingerprints are one class, so copies never meet in pairs. Classes that lie close share a key of nearby Golay
    codewords (see ``keys_of``); a bucket's links, verified on whole fingerprints, come out as a forest, so a crowd of
    near copies gives as many links as it has members, not as many as it has pairs. Buckets of more than ``crowd``
    classes are cut into blocks that meet after all others are linked, those that already lie in one component not at
    all; no link between components is lost.

    A row with a null id gets a null component and links nothing. Rows that repeat an id are one node, which joins the
    components of its fingerprints. An empty table has no rows.
    """
    if not 0 <= bits <= 3:
        raise ValueError("three segments of Golay codes find up to three bits")
    with Scratch(prints.sparkSession) as tables:
        prints = tables.written(prints.select("id", "print"), "prints")
        known = prints.where("id IS NOT NULL")
        classes = tables.written(known.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "classes")
        keyed = classes.select("print").mapInArrow(_keyed, "key long, print long, core boolean")
        met = tables.written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_joined(bits, crowd), "a long, b long, crowded long"), "met")
        twice = known.groupBy("id").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a <> z").select("id", "a")
        twice = known.join(twice, "id").where("print <> a").select("a", F.col("print").alias("b"))
        links = tables.written(met.where("b IS NOT NULL").select("a", "b").union(twice).distinct(), "links")
        crowds = met.where("crowded IS NOT NULL").select(F.col("crowded").alias("key"))
        if not crowds.isEmpty():
            rows = tables.written(keyed.join(crowds, "key"), "crowds")
            links = links.union(tables.written(_crowded(rows, links, tables, bits, crowd), "links"))
        component = components_in(links, tables).toDF("print", "component")
        joined = tables.written(classes.join(component, "print", "left").withColumn("component", F.coalesce("component", "print")), "joined")
        first = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
        by_print = tables.written(looked_up(joined, first, ["component"], F.col("prints")).select("print", "component_id", "copies"), "by-print")
        out = looked_up(known, by_print, ["print"], F.col("copies")).select("id", "print", "component_id")
        return written(out.unionByName(prints.where("id IS NULL").withColumn("component_id", F.lit(None).cast("long"))), "fingerprints")
