"""Byte-level BPE by prefix dynamic programming, and its inverse."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import CACHE_ENTRIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
NEVER = 1 << 60
#: Stands between pieces; no byte.
BORDER = "\u0100"
#: Chunks that a worker keeps.
CHUNKS = 700_000

#: A pattern match never runs on past a character that isn't white space into a space, so texts may be cut before such spaces.
_ODD_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


class PrefixBPE:
    """Encoder over a rank table (bytes -> id; ids are merge ranks).

    For every prefix of the input the last token of its encoding is unique. A token t is the last one of a prefix if
    the prefix before t ends with a token p such that the bytes of p and t, encoded together, stay p and t. So one
    table of last tokens, filled from left to right, holds the encodings of all prefixes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.tokens = {i: b for b, i in ranks.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self._stays: dict[tuple[int, int], bool] = {}
        self.lengths = [len(self.tokens.get(i, b"")) for i in range(max(self.tokens) + 1)]
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(token)):
                pair = ranks.get(token[:cut], NEVER), ranks.get(token[cut:], NEVER)
                if max(pair) < i and self._apart(*pair):
                    self.merged[pair], self.halves[i] = i, pair
                    break

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens whose bytes stand side by side.

        The tokens next to the border change while merges are applied in rank order: walking back in time, the younger
        of the two is replaced by its own half at the border. At each time a merge across the border counts only if it
        comes before the older neighbour's next merge; of equal ranks, the one further left comes first.
        """
        until = NEVER
        while True:
            if self.merged.get((left, right), NEVER) < until:
                return False
            whole_left, whole_right = left not in self.halves, right not in self.halves
            if whole_left and whole_right:
                return True
            if whole_right or (left > right and not whole_left):
                until, left = left, self.halves[left][1]
            else:
                until, right = right + 1, self.halves[right][0]

    def stays(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._stays.get(key)
        if known is None:
            if len(self._stays) >= CACHE_ENTRIES:
                self._stays.clear()
            known = self._stays[key] = self._apart(left, right)
        return known

    def extend(self, data: bytes, last: list[int], to: int | None = None) -> None:
        """Append to ``last`` the last tokens of the prefixes of ``data`` up to length ``to``; last[i] belongs to i + 1 bytes."""
        ranks, longest, merged = self.ranks, self.longest, self.stays
        for end in range(len(last) + 1, (len(data) if to is None else to) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(data[start:end])
                if token is not None and (not start or merged(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("the ranks lack a byte")

    def read(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens holds."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        last: list[int] = []
        self.extend(data, last)
        return self.read(last)

    def encode_many(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Encodings of many pieces, by one table over all of them side by side.

        The automaton finds, for each end, the tokens that end there, longest first.
        """
        text = BORDER + BORDER.join(p.decode("latin-1") for p in pieces)
        last = [0] * len(text)  # token + 1; -1 stands before a piece
        at = 0
        for p in pieces:
            last[at] = -1
            at += len(p) + 1
        lengths, known, stays = self.lengths, self._stays, self.stays
        for end, token in self.automaton.iter(text):
            if not last[end]:
                before = last[end - lengths[token]]
                if before < 0 or (before and (known[key] if (key := (before - 1, token)) in known else stays(*key))):
                    last[end] = token + 1
        at = 0
        for p in pieces:
            out, at = [], at + len(p) + 1
            end = at - 1
            while (token := last[end] - 1) >= 0:
                out.append(token)
                end -= lengths[token]
            out.reverse()
            yield out


class Editable:
    """Bytes of one pattern match with their table: exact appends, and edits that re-encode only what they touch."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, []
        bpe.extend(data, self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns how many prefixes were encoded again.

        A prefix's last token depends only on its last ``longest`` bytes and on the last tokens of that many prefixes
        before, so once ``longest`` of them in a row after the edit are as they were, all later ones are too.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, same, at = old[:start], 0, start
        while at < len(self.data):
            self.bpe.extend(self.data, self.last, at := at + 1)
            same = same + 1 if at > start + len(new) and self.last[-1] == old[at - 1 - shift] else 0
            if same == self.bpe.longest:
                self.last += old[at - shift :]
                break
        return at - start

    def ids(self) -> list[int]:
        return self.bpe.read(self.last)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _bpe(path: str) -> PrefixBPE:
    return PrefixBPE(load_ranks(path))


def cut_at_spaces(text: str) -> tuple[str, list[str]]:
    """Cut a text before spaces that follow other than white space; matches of the pattern never cross such a cut.

    Returns what stands before the first cut, and the other chunks without the space that each begins with.
    """
    if _ODD_SPACE.search(text):
        head, *rest = _CUT.split(text)
        return head, [x[1:] for x in rest]
    head, *rest = text.split(" ")
    return head, rest


def matches(find, chunk: str) -> list[str]:
    """Matches of the pattern in a space and a chunk; words, alone or with a comma or full stop, need no search."""
    if chunk.isalpha():
        return [" " + chunk]
    if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
        return [" " + chunk[:-1], chunk[-1]]
    return find(" " + chunk)


class ChunkIds(dict):
    """Chunk of text, after its space -> ids as little-endian unsigned 32-bit bytes; unknown ones are encoded batch by batch."""

    def __init__(self, bpe: PrefixBPE, pattern: str):
        self.bpe, self.find, self.pieces = bpe, regex.compile(pattern).findall, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [cut_at_spaces(t) for t in texts]
        wanted = set().union(*(rest for _, rest in split))
        if len(self) + len(wanted) > CHUNKS:
            self.clear()
        if len(self.pieces) > CACHE_ENTRIES:
            self.pieces.clear()
        new = {c: matches(self.find, c) for c in wanted - self.keys()}
        heads = [self.find(head) for head, _ in split]
        pieces = list(set().union(*new.values(), *heads) - self.pieces.keys())
        coded = self.bpe.encode_many([p.encode("utf-8", "surrogatepass") for p in pieces])
        self.pieces.update((p, pack(f"<{len(ids)}I", *ids)) for p, ids in zip(pieces, coded, strict=True))
        self.update((c, b"".join(map(self.pieces.__getitem__, ms))) for c, ms in new.items())
        return [b"".join([*map(self.pieces.__getitem__, head), *map(self.__getitem__, rest)]) for head, (_, rest) in zip(heads, split, strict=True)]


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkIds(_bpe(path), pattern)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                own = known.encode([t or "" for t in batch.column(1)[s : s + 256].to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(o) // 4 for o in own])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(own), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[s : s + 256], ids], ["id", "ids"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Token ids of every whole text: (id, ids array<int>), one row per input row.

    ``ranks`` is a rank file that every executor can open. A null or empty text has no ids. Ids may be null or repeat.
    Other columns are ignored.
    """
    kind = docs.select(id_col).dtypes[0][1]
    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return bare.mapInArrow(_encoded(ranks, pattern), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bpe(path).tokens
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                ids = part.column(1)
                flat, offsets = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                data = [b"".join(map(table.__getitem__, flat[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(data, pa.binary())], ["id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = RANKS) -> DataFrame:
    """Bytes of token ids: (id, ids, decoded binary); null ids decode to no bytes, an unknown id fails."""
    kind = encoded.select(id_col).dtypes[0][1]
    bare = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return bare.mapInArrow(_decoded(ranks), f"id {kind}, ids array<int>, decoded binary").withColumnsRenamed({"id": id_col, "ids": ids_col})
