"""Line dedup: exact set-similarity join of lines by prefix, position and length filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ledgerloom.llm.common import Scratch, WordScan, bitmap, counter_of, flagged, level_of, marked, mix, rarity, spare, written

#: Least words of a line that is compared, unless told otherwise (1: all lines with words, as op7_lines and the pipeline do), and least Jaccard similarity (percent) of its distinct words.
LEAST_WORDS, PERCENT = 5, 80


class Limits(NamedTuple):
    """What bounds the work under one key; other values give the same result.

    A token of more words than ``hot`` is joined together with each later one of the prefix. Under a key of over
    ``crowd`` sets each meets at most the ``tries`` earliest of those before it at first. A task reports a key of so many of its sets as ``local``;
    the ``most`` heaviest reported keys are dealt to groups of about ``salted`` entries each.
    """

    hot: int = 4_000
    crowd: int = 512
    tries: int = 2
    local: int = 64
    salted: int = 4_096
    most: int = 1 << 17


#: Entries of a group, and pairs that are looked at together.
GROUP, PAIRS = 250_000, 1 << 21
#: Keys that a task counts at a time.
CHUNK = 1 << 21
#: Sets of more tokens have a second word of parities.
LARGE = 80

_TOKEN_BITS, _LINE_BITS = 44, 12
_LOW, _KEY = np.uint64((1 << _TOKEN_BITS) - 1), np.uint64((1 << (64 - _LINE_BITS)) - 1)
_SALT = np.uint64(0x9FB21C651E98DF25)


def _lines(texts: pa.Array, scan: WordScan, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Token hash and line of every word of lines with ``least`` words; row and number in its text of each such line."""
    for base, _, tokens, row, number in scan.parts(texts):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(row)))
        keep = n >= least
        line = np.repeat(np.cumsum(keep) - 1, n)
        if not keep.all():
            words = np.repeat(keep, n)
            tokens, line, first = tokens[words], line[words], first[keep]
        yield tokens, line, row[first] + base, number[first]


def _sets(tokens: np.ndarray, line: np.ndarray, lines: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each line, rarest first (their level stands above the hash); their line, place and the line's size."""
    key = (levels[counter_of(tokens)].astype(np.uint64) << np.uint64(_TOKEN_BITS)) | (tokens >> np.uint64(64 - _TOKEN_BITS))
    if lines >> _LINE_BITS:
        order = np.lexsort((key, line))
        key, line = key[order], line[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        key, line = key[new], line[new]
    else:  # both fit one number
        both = np.sort((line.astype(np.uint64) << np.uint64(64 - _LINE_BITS)) | key)
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        both = both[new]
        key, line = both & _KEY, (both >> np.uint64(64 - _LINE_BITS)).astype(np.int64)
    size = np.bincount(line, minlength=lines)
    return key, line, np.arange(len(key)) - (np.cumsum(size) - size)[line], size


def _sums(key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each line's set, and parities of its tokens.

    The parities of two sets differ in at most as many bits as tokens are in one set only. Large sets have 128 of them,
    in two words, others 64, in the first; both words folded make the 64 of any set.
    """
    if not len(size):
        return (np.empty(0, np.int64),) * 4
    start, own = np.cumsum(size) - size, mix(key & _LOW)
    a = np.add.reduceat(own, start)
    b = np.add.reduceat(mix(own + _SALT), start)
    bit, upper = np.uint64(1) << (own >> np.uint64(58)), ((own >> np.uint64(57)) & np.uint64(1)).astype(bool)
    upper &= np.repeat(size > LARGE, size)
    low = np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), bit), start)
    high = np.bitwise_xor.reduceat(np.where(upper, bit, np.uint64(0)), start)
    return a.view(np.int64), b.view(np.int64), low.view(np.int64), high.view(np.int64)


def _apart(n: np.ndarray, low: np.ndarray, high: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the parities of sets differ."""
    x, y = low[i] ^ low[j], high[i] ^ high[j]
    bits = np.bitwise_count(x ^ y).astype(np.int64)
    both = (n[i] > LARGE) & (n[j] > LARGE)
    if both.any():
        bits[both] = np.bitwise_count(x[both]).astype(np.int64) + np.bitwise_count(y[both])
    return bits


class _Seen:
    """Which sets are new to a task; forgets at times, which costs repeated rows only."""

    def __init__(self, most: int = 1 << 20):
        self.known, self.most = np.empty(0, np.uint64), most

    def new(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a.view(np.uint64) + mix(b.view(np.uint64))
        own, at = np.unique(both, return_index=True)
        if len(self.known):
            there = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
            fresh = self.known[there] != own
            own, at = own[fresh], at[fresh]
        self.known = np.sort(np.concatenate([self.known if len(self.known) < self.most else self.known[:0], own]))
        out = np.zeros(len(a), bool)
        out[at] = True
        return out


class _Frequent:
    """Keys that a task meets often, with one set of each. A key met once among CHUNK isn't kept, so that counts may be short."""

    def __init__(self):
        self.keys, self.names, self.held, self.done = [], [], 0, []

    def add(self, keys: np.ndarray, names: np.ndarray) -> None:
        self.keys.append(keys)
        self.names.append(names)
        self.held += len(keys)
        if self.held >= CHUNK:
            self._fold()

    def _fold(self) -> None:
        keys, first, count = np.unique(np.concatenate([*self.keys, np.empty(0, np.int64)]), return_index=True, return_counts=True)
        on = count > 1
        self.done.append((keys[on], np.concatenate([*self.names, np.empty(0, np.int64)])[first[on]], count[on]))
        self.keys, self.names, self.held = [], [], 0

    def of_least(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._fold()
        keys, names, count = (np.concatenate(c) for c in zip(*self.done, strict=True))
        own, first, of = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(of, count, len(own)).astype(np.int64)
        return own[total >= least], names[first[total >= least]], total[total >= least]


def _prefixes(key: np.ndarray, line: np.ndarray, place: np.ndarray, size: np.ndarray, on: np.ndarray, percent: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of a prefix token (its first ``cold`` ones are single tokens) and 64-bit key: what two matching sets share at least once."""
    prefix = size - -(-percent * size // 100) + 1
    level = key >> np.uint64(_TOKEN_BITS)
    inside = (place < prefix[line]) & (level > 1) & (on & (100 * size >= percent * (size + 1)))[line]  # smaller sets match equal ones only
    hot = np.uint64(level_of(most))
    cold = np.flatnonzero(inside & (level < hot))
    at, keys = [cold], [mix(key[cold])]
    warm, step = np.flatnonzero(inside & (level >= hot)), 1
    while len(warm):  # a hot token and each later one of the prefix, taken one longer
        warm = warm[place[warm] + step < np.minimum(prefix + 1, size)[line[warm]]]
        at.append(warm), keys.append(mix(key[warm] * np.uint64(3) + mix(key[warm + step])))
        step += 1
    return np.concatenate(at), np.concatenate(keys), len(cold)


_LINE_ROW = "line int, name long, other long, n int, parity long, parity2 long, at long, keys array<long>, places array<int>"


def _scanned(shared: Broadcast, least: int, percent: int, limits: Limits) -> Callable:
    """A row for each line; keys and places are of prefix tokens that another line may share.

    A task's frequent keys follow: rows of line -1 with the key, how many sets had it, and the name of one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, scan, seen, frequent, kind = shared.value, WordScan(), _Seen(), _Frequent(), None
        for batch in batches:
            kind, order = batch.column(0).type, batch.column(2).to_numpy(zero_copy_only=False)
            for tokens, line, row, number in _lines(batch.column(1), scan, least):
                key, line, place, size = _sets(tokens, line, len(row), levels)
                a, b, parity, parity2 = _sums(key, size)
                at, keys, cold = _prefixes(key, line, place, size, seen.new(a, b), percent, limits.hot)
                own = line[at]
                if len(keys) > cold:
                    of = own[cold:]
                    frequent.add(keys[cold:].view(np.int64), a[of])
                by = np.argsort(own, kind="stable")
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(row)))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(a), pa.array(b), pa.array(size.astype(np.int32)), pa.array(parity), pa.array(parity2), pa.array(order[row]),
                    pa.ListArray.from_arrays(ends, pa.array(keys[by].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(place[at[by]].astype(np.int32))),
                ], ["doc", "line", "name", "other", "n", "parity", "parity2", "at", "keys", "places"])
        if kind is not None:
            keys, names, count = frequent.of_least(limits.local)
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(keys), kind), pa.array(np.full(len(keys), -1, np.int32)), pa.array(names), *(pa.nulls(len(keys), x) for x in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())),
                pa.ListArray.from_arrays(ends, pa.array(keys)), pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32))),
            ], ["doc", "line", "name", "other", "n", "parity", "parity2", "at", "keys", "places"])

    return run


#: What a group gets of an entry: enough of the key and of the set's name (what collides is one pair more to verify), parities, place of its document in the order, size, place in its line, and whether it asks for matches (1) or meets a part of its key's sets (2).
_ENTRY = [("key", "<u4"), ("high", "<u4"), ("low", "<u2"), ("parity", "<u8"), ("parity2", "<u8"), ("at", "<u8"), ("n", "<u4"), ("place", "<u4"), ("state", "u1")]
_NAME_BITS = 48


def _short(name: np.ndarray) -> np.ndarray:
    return name.view(np.uint64) >> np.uint64(64 - _NAME_BITS)


def _blob(parts: list[np.ndarray]) -> bytes:
    """Columns one after the other, each above its least value in the fewest bytes that hold it; least values and widths stand in front."""
    head, out = [len(parts[0]).to_bytes(4, "little")], []
    for (_, kind), x in zip(_ENTRY, parts, strict=True):
        x = x.astype(kind)
        least, most = int(x.min()), int(x.max())
        width = next(w for w in (0, 1, 2, 4, 8) if (most - least) >> 8 * w == 0)
        head.append(bytes([width]) + least.to_bytes(8, "little"))
        out.append((x - x.dtype.type(least)).astype(f"<u{width}").tobytes() if width else b"")
    return b"".join(head + out)


def _unpacked(blobs: pa.ChunkedArray) -> list[np.ndarray]:
    columns: list[list[np.ndarray]] = [[] for _ in _ENTRY]
    for blob in blobs:
        data = blob.as_py()
        n, at = int.from_bytes(data[:4], "little"), 4 + 9 * len(_ENTRY)
        for k, c in enumerate(columns):
            width, least = data[4 + 9 * k], int.from_bytes(data[5 + 9 * k : 13 + 9 * k], "little")
            own = np.frombuffer(data, f"<u{width}", n, at) if width else np.zeros(n, "u1")
            c.append(own.astype(np.uint64) + np.uint64(least))
            at += n * width
    return [np.concatenate(c) for c in columns]


def _dealt(groups: int, frequent: Broadcast, asking: Broadcast | None, wanted: Broadcast | None) -> Callable:
    """Rows (group, entries) of prefix entries, by hash of the key; a frequent key's sets go to several groups, its first one and those that ask to all.

    With ``asking`` (bits by name), only entries whose key is in ``wanted`` (bits by key) count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, salts, leaders = frequent.value
        for batch in batches:
            lists = batch.column("keys")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            key, of = lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(n)), n)
            place = batch.column("places").flatten().to_numpy()
            name, parity, parity2, at, size = (batch.column(c).to_numpy() for c in ("name", "parity", "parity2", "at", "n"))
            asks = np.zeros(len(name), bool) if asking is None else marked(asking.value, name)
            if wanted is not None:
                on = marked(wanted.value, key.view(np.int64))
                key, of, place = key[on], of[on], place[on]
            if len(known) and len(key):
                there = np.minimum(np.searchsorted(known, key), len(known) - 1)
                salt = np.where(known[there] == key, salts[there], 1)
                every = asks[of] | (leaders[there] == name[of])
            else:
                salt, every = np.ones(len(key), np.int64), np.zeros(len(key), bool)
            copies = np.where(every, salt, 1)
            i = np.repeat(np.arange(len(key)), copies)
            turn = np.arange(len(i)) - np.repeat(np.cumsum(copies) - copies, copies)
            own = (name[of[i]].view(np.uint64) % salt[i].astype(np.uint64)).astype(np.int64)
            sub = key[i] + np.where(salt[i] > 1, np.where(every[i], turn, own) + 1, 0).astype(np.uint64) * _SALT
            sub = np.where(salt[i] > 1, mix(sub), sub)
            group = (sub >> np.uint64(32)) % np.uint64(groups)
            order = np.argsort(group, kind="stable")
            i, group = i[order], group[order]
            short = _short(name)[of[i]]
            place_of = at.view(np.uint64) ^ np.uint64(1 << 63)
            parts = [sub[order] & np.uint64(0xFFFFFFFF), short >> np.uint64(16), short & np.uint64(0xFFFF), parity.view(np.uint64)[of[i]], parity2.view(np.uint64)[of[i]], place_of[of[i]], size[of[i]], place[i], asks[of[i]] + 2 * (salt[i] > 1)]
            cuts = np.flatnonzero(np.diff(group, prepend=group[:1] + np.uint64(1)) != 0) if len(group) else np.empty(0, np.int64)
            ends = np.append(cuts[1:], len(group))
            blobs = [_blob([p[s:e] for p in parts]) for s, e in zip(cuts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(group[cuts].astype(np.int64)), pa.array(blobs, pa.binary())], ["group", "entries"])

    return run


def _candidates(percent: int, all_of: bool, exact: bool, limits: Limits) -> Callable:
    """Pairs of (short) names under a key that pass the filters; null partners stand for pairs that were left for later.

    Under a key of a crowd, a set meets the earliest few; the later end of what is left out is reported (both ends where
    the order isn't ``exact``), and all sets of a key that is dealt to several groups. With ``all_of``, sets that ask
    meet all others.
    """

    def run(table: pa.Table) -> pa.Table:
        key, high, low, parity, parity2, at, n, place, state = _unpacked(table.column("entries"))
        name = (high << np.uint64(16)) | low
        order = np.lexsort((name, (key << np.uint64(32)) | n))
        key, name, parity, parity2, at, n, place, state = (x[order] for x in (key, name, parity, parity2, at, n, place, state))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, parity, parity2, at, n, place, state = (x[new] for x in (key, name, parity, parity2, at, n, place, state))
        n, place, name, asks = n.astype(np.int64), place.astype(np.int64), name.astype(np.int64), (state & np.uint64(1)).astype(bool)
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        crowd = np.cumsum(first) - 1
        members = np.bincount(crowd)
        # sorted by size: a smaller set's position bounds how large its partners can be
        most = np.minimum(100 * n // percent, (100 + percent) * (n - place) // percent - n)
        wide = int(n.max(initial=0)) + 2
        until = np.searchsorted(crowd * wide + n, crowd * wide + np.clip(most, -1, wide - 1), "right")
        count = np.maximum(until - np.arange(len(key)) - 1, 0)
        total = np.cumsum(count)
        out: list[np.ndarray] = []
        later: list[np.ndarray] = [] if all_of else [name[state & np.uint64(2) > 0]]
        start = 0
        crowded: list[np.ndarray] = []
        while start < len(key):
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS, "right")))
            c = count[start:end]
            i = np.repeat(np.arange(start, end), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            both = n[i] + n[j]
            on = (100 + percent) * (n[j] - place[j]) >= percent * both
            if all_of:
                on &= asks[i] | asks[j]
            i, j, both = i[on], j[on], both[on]
            on = _apart(n, parity, parity2, i, j) * (100 + percent) <= (100 - percent) * both
            i, j = i[on], j[on]
            many = np.zeros(len(i), bool) if all_of else members[crowd[i]] > limits.crowd
            out.append(np.stack([name[i[~many]], name[j[~many]]], 1))
            if many.any():
                crowded.append(np.stack([i[many], j[many]], 1))
            start = end
            if crowded and (start >= len(key) or sum(map(len, crowded)) > 4 * PAIRS):
                i, j = np.concatenate(crowded).T
                crowded = []
                swap = (at[i] > at[j]) | ((at[i] == at[j]) & (name[i] > name[j]))
                x, y = np.where(swap, j, i), np.where(swap, i, j)
                by = np.lexsort((name[x], at[x], y))
                x, y = x[by], y[by]
                fresh = np.ones(len(y), bool)
                fresh[1:] = y[1:] != y[:-1]
                left = np.arange(len(y)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] >= limits.tries
                out.append(np.stack([name[x[~left]], name[y[~left]]], 1))
                later += [name[y[left]], name[x[left & (at[x] == at[y])]] if exact else name[x[left]]]
        pairs = np.concatenate([*out, np.empty((0, 2), np.int64)])
        pairs.sort(axis=1)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(1))[: len(pairs)]]
        left = np.unique(np.concatenate([*later, np.empty(0, np.int64)])).astype(np.int64)
        both = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(left), pa.int64())])
        return pa.table({"name": np.concatenate([pairs[:, 0], left]), "name2": both})

    return run


def _wanted(shared: Broadcast, bits: Broadcast, least: int) -> Callable:
    """Rows (short name, name, other, tokens) of lines whose name may be among the wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, marks, scan, seen = shared.value, bits.value, WordScan(), _Seen()
        for batch in batches:
            for tokens, line, row, _ in _lines(batch.column(0), scan, least):
                key, line, _, size = _sets(tokens, line, len(row), levels)
                a, b, *_ = _sums(key, size)
                on = marked(marks, a)
                on[on] = seen.new(a[on], b[on])
                offsets = np.concatenate([[0], np.cumsum(size[on])]).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(offsets), pa.array((key & _LOW)[on[line]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_short(a[on]).astype(np.int64)), pa.array(a[on]), pa.array(b[on]), own], ["short", "name", "other", "tokens"])

    return run


def _kept_by_name(bits: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(bits.value, batch.column("name").to_numpy())))

    return run


def _keys_of(bits: Broadcast) -> Callable:
    """Distinct prefix keys of lines whose name may be marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = batch.filter(pa.array(marked(bits.value, batch.column("name").to_numpy())))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(on.column("keys").flatten().to_numpy()))], ["name"])

    return run


def _cuts(bare: DataFrame, least_words: int, percent: int, limits: Limits, exact: bool, tables: Scratch) -> DataFrame:
    """(row, lines): the numbers of the lines that are cut from each (doc, text, at), by hash of the row; ``exact``: at orders documents but for ties."""
    spark = bare.sparkSession

    def tokens_of() -> Callable:
        scan = WordScan()
        return lambda batch: (tokens for tokens, *_ in _lines(batch.column(0), scan, least_words))

    levels = tables.broadcast(rarity(bare.select("text"), tokens_of))
    kind = bare.schema["doc"].dataType.simpleString()
    all_lines, counts = tables.counted(bare.mapInArrow(_scanned(levels, least_words, percent, limits), f"doc {kind}, {_LINE_ROW}"), "lines", entries=F.sum(F.when(F.col("line") >= 0, F.size("keys"))))
    lines = all_lines.where("line >= 0")
    groups = max((counts["entries"] or 0) // GROUP + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    reports = all_lines.where("line < 0").select(F.col("keys")[0].alias("key"), F.col("places")[0].alias("sets"), "name").groupBy("key").agg(F.sum("sets").alias("sets"), F.min("name").alias("name"))
    reports = sorted(reports.where(F.col("sets") > limits.salted).orderBy(F.desc("sets"), "key").limit(limits.most).collect(), key=lambda r: r["key"] % (1 << 64))
    frequent = tables.broadcast((np.array([r["key"] % (1 << 64) for r in reports], np.uint64), np.array([-(-r["sets"] // limits.salted) for r in reports], np.int64), np.array([r["name"] for r in reports], np.int64)))
    firsts = lines.groupBy("name", "other").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("lines"))
    firsts = tables.written(firsts, "firsts")

    def met(asking: Broadcast | None = None, wanted: Broadcast | None = None) -> DataFrame:
        dealt = lines.where(F.size("keys") > 0).select("name", "n", "parity", "parity2", "at", "keys", "places").mapInArrow(_dealt(groups, frequent, asking, wanted), "group long, entries binary")
        return dealt.groupBy("group").applyInArrow(_candidates(percent, wanted is not None, exact, limits), "name long, name2 long")

    def verified(pairs: DataFrame) -> DataFrame:
        """(name, other) of sets of which an earlier one is a match."""
        names = pairs.select("name").union(pairs.select("name2")).distinct()
        marks = tables.broadcast(bitmap(names.select(F.shiftleft("name", 64 - _NAME_BITS).alias("name"))))
        own = tables.written(firsts.select("name", "other", "first").mapInArrow(_kept_by_name(marks), firsts.select("name", "other", "first").schema), "wanted")
        texts = flagged(bare.select("doc.row", "text"), "row", bitmap(own.select(F.col("first.doc.row").alias("name"))), "may").where("may").select("text")
        sets = texts.mapInArrow(_wanted(levels, marks, least_words), "short long, name long, other long, tokens array<long>")
        sets = tables.written(sets.dropDuplicates(["name", "other"]).join(own, ["name", "other"]), "sets")
        one = sets.select(F.col("short").alias("name"), F.struct("name", "other").alias("set"), "tokens", "first")
        both = pairs.join(one, "name").join(one.select(F.col("name").alias("name2"), F.col("set").alias("set2"), F.col("tokens").alias("tokens2"), F.col("first").alias("first2")), "name2")
        i = F.size(F.array_intersect("tokens", "tokens2"))
        both = both.withColumn("i", i).where(100 * F.col("i") >= percent * (F.size("tokens") + F.size("tokens2") - F.col("i")))
        later = F.when(F.col("first") > F.col("first2"), F.col("set")).otherwise(F.col("set2"))
        return tables.written(both.select(later.alias("set")).distinct().select("set.*"), "settled")

    raw = tables.written(met(), "candidates")
    tried = tables.written(raw.where("name2 IS NOT NULL").distinct(), "pairs")
    settled = verified(tried)
    asks = raw.where("name2 IS NULL").select("name").distinct().join(settled.select(F.shiftrightunsigned("name", 64 - _NAME_BITS).alias("name")), "name", "left_anti")
    asks = tables.written(asks.select(F.shiftleft("name", 64 - _NAME_BITS).alias("name")), "asks")
    if not asks.isEmpty():
        asking = tables.broadcast(bitmap(asks))
        wanted = tables.broadcast(bitmap(lines.select("name", "keys").mapInArrow(_keys_of(asking), "name long")))
        rest = tables.written(met(asking, wanted).distinct().join(tried, ["name", "name2"], "left_anti"), "pairs")
        if not rest.isEmpty():
            settled = settled.union(verified(rest)).distinct()

    due = firsts.join(settled.withColumn("gone", F.lit(True)), ["name", "other"], "left").where("gone OR lines > 1").select("name", "other", "first", "gone")
    due = tables.written(due, "due")
    bits = tables.broadcast(bitmap(due.select("name")))
    thin = lines.select("doc", "line", "name", "other")
    cut = thin.mapInArrow(_kept_by_name(bits), thin.schema).join(due, ["name", "other"]).where(F.coalesce("gone", F.lit(False)) | (F.struct("doc", "line") > F.col("first")))
    return written(cut.groupBy(F.col("doc.row").alias("row")).agg(F.array_sort(F.collect_set("line")).alias("lines")), "cuts")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT, limits: Limits = Limits()) -> DataFrame:
    """``docs`` with each text's later matches cut out, and columns n_lines and removed_lines (numbers from 0).

    A text's lines end at line feeds. A line of at least ``least_words`` words is cut if an earlier one, cut or not, has
    100 * |shared| >= percent * |all| distinct words (A-Z lower-cased, parted by ASCII white space); order is that of
    ids, nulls first, then of a hash of the row, then of lines in the text. Shorter lines stay; with ``least_words`` 1
    those are blank ones. All tokens are put in one order, rarest first; two lines that match share a token of their
    prefixes, lie close enough in length, and have enough tokens left after the shared one; what passes is verified on
    full sets. Lines with equal sets are one entry, so copies make no pairs, and tokens of many words are joined
    together with a second one.

    Entries are exchanged once, packed by hash of their key, in groups of bounded size: keys that a task meets often are
    reported and dealt to several groups, each with one of the key's sets. One earlier match settles a line, so under a
    key of many sets each meets a few at first; sets that then have no earlier match ask all others.

    Null and empty texts stay as they are (null: no lines). Rows equal in id and text are cut alike. Extra columns are
    kept; those called n_lines or removed_lines are replaced.
    """
    row = F.xxhash64(id_col, text_col)
    whole = isinstance(docs.schema[id_col].dataType, IntegralType)
    place = F.coalesce(F.col(id_col).cast("long") if whole else F.xxhash64(id_col), F.lit(-(2**63)))
    bare = docs.select(F.struct(F.col(id_col).alias("id"), row.alias("row")).alias("doc"), F.col(text_col).cast("string").alias("text"), place.alias("at"))
    with Scratch(docs.sparkSession) as tables:
        cut = _cuts(bare, least_words, percent, limits, whole, tables)

    own = docs.drop("n_lines", "removed_lines")
    key, gone, may = spare(own, "row"), spare(own, "gone"), spare(own, "may")
    touched = flagged(own.withColumn(key, row), key, bitmap(cut.select(F.col("row").alias("name"))), may)
    text = F.col(text_col).cast("string")
    less = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n"))
    joined = touched.where(may).join(cut.toDF(key, gone), key, "left")
    added = {"n_lines": F.coalesce((F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int"), F.lit(0))}
    none = F.array().cast("array<int>")
    with_cuts = joined.withColumns(added | {"removed_lines": F.coalesce(gone, none), text_col: less})
    whole_ones = touched.where(~F.col(may)).withColumns(added | {"removed_lines": none, text_col: text})
    return whole_ones.unionByName(with_cuts.drop(gone)).drop(key, may)
