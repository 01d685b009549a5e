"""Packing documents into fixed token sequences by vector best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.bpe import CHUNKS, cut_at_spaces, matches
from ledgerloom.llm.common import given_back, spare, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Id that ends each document, tokens of a sequence, and pieces that one task packs together.
END, MAX_TOKENS, SHARD = 2, 1024, 8_000


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class ChunkBytes(dict):
    """Chunk of text, after its space -> its ids as little-endian unsigned 32-bit bytes.

    Chunks are split by the byte-level pattern, and each match goes through the library's own model, which takes bytes
    as printable characters.
    """

    def __init__(self, path: str):
        self.whole = _tokenizer(path)
        self.find, self.model, self.pieces = regex.compile(public_tokenizers.PATTERN).findall, self.whole.model, {}
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= CHUNKS:
                self.pieces.clear()
            own = self.model.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown))
            ids = self.pieces[piece] = b"".join([x.id.to_bytes(4, "little") for x in own])
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CHUNKS:
            self.clear()
        out = self[chunk] = b"".join([self._piece(p) for p in matches(self.find, chunk)])
        return out

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.added):  # texts that spell one of the tokenizer's added tokens are few
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, rest = cut_at_spaces(text)
        return b"".join([*map(self._piece, self.find(head)), *map(self.__getitem__, rest)])


def _pieces(path: str, most: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, stop = ChunkBytes(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, t in enumerate(batch.column(1)):
                data = known.encode(t.as_py() or "") + stop
                n = len(data) // 4
                cuts = [0, *range(n % most or min(n, most), n + 1, most)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    at.append(row), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(data[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])
        known.pieces.clear()
        known.clear()
        given_back()

    return run


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, max_tokens: int = MAX_TOKENS, end: int = END) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32) of every document's ids and ``end``.

    Only documents of over ``max_tokens`` ids are cut: into pieces of that size, the first of which may be shorter. A
    null or empty text is the one id ``end``. Ids may be null or repeat; other columns are ignored.
    """
    kind = docs.select(id_col).dtypes[0][1]
    bare = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return bare.mapInArrow(_pieces(tokenizer, max_tokens, end), f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


def best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Bin of each item. Items come in falling size; each goes into the open bin that fits it in every dimension and

    * ``norm``: leaves the smallest weighted norm of residual capacities, or
    * ``dot``: has the largest weighted dot product of its demand with the residuals;

    if none fits, a bin is opened. Full bins leave the search.
    """
    share = demand / capacity
    order = np.lexsort((np.arange(len(share)), -(share * weights).sum(1)))
    smallest = share.min(0) if len(share) else 0
    out = np.empty(len(share), np.int64)
    room, names, used, made = np.empty((len(share) + 1, share.shape[1])), np.empty(len(share) + 1, np.int64), 0, 0
    for i in order:
        d = share[i]
        free = room[:used]
        fits = np.flatnonzero((free >= d - 1e-12).all(1))
        if len(fits):
            left = free[fits]
            score = (weights * (left - d) ** 2).sum(1) if rule == "norm" else -(weights * left * d).sum(1)
            j = fits[score.argmin()]
        else:
            j, room[used], names[used] = used, 1.0, made
            used, made = used + 1, made + 1
        out[i] = names[j]
        room[j] -= d
        if (room[j] < smallest - 1e-12).any():
            used -= 1
            room[j], names[j] = room[used], names[used]
    return out


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, max_documents: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.001, 0.001), rule: str = "norm", shard: int = SHARD) -> DataFrame:
    """``pieces`` (with ``length``) with sequence_id and offset.

    A sequence holds at most ``max_tokens`` tokens, ``max_documents`` pieces and an attention cost (the sum of squared
    lengths) of ``max_cost``; by default the last two can't bind before the first. Pieces of full length are sequences
    of their own; the others are dealt evenly to shards of about ``shard`` pieces and packed within each, which leaves
    at most about one part-filled sequence a shard. Ties go to the earlier piece and bin; rows that repeat are pieces of
    their own; a null length counts as 0 tokens; an empty table has no rows. Extra columns are kept, but for a
    sequence_id or offset, which are replaced. Pieces longer than ``max_tokens`` fail.
    """
    caps = np.array([max_tokens, max_documents or max_tokens, max_cost or float(max_tokens) ** 2], float)
    own = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    number, dealt = spare(pieces, "number"), spare(pieces, "dealt")
    kept = written(pieces.select(*own).withColumn(number, F.monotonically_increasing_id()), "pieces")
    alone = F.coalesce(F.col("length") == max_tokens, F.lit(False)) if max_cost is None else F.lit(False)
    many = kept.where(~alone).count() // shard + 1
    schema = kept.select(*own).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(number, ignore_index=True)
        n = rows["length"].fillna(0).to_numpy(np.int64)
        if len(n) and n.max() > max_tokens:
            raise ValueError("a piece is longer than a sequence")
        bins = best_fit(np.stack([n, np.ones_like(n), n * n], 1).astype(float), caps, np.array(weights), rule)
        rows["sequence_id"] = bins * (1 << 24) + int(key[0])
        rows["offset"] = pd.Series(n).groupby(bins).cumsum() - n
        return rows[schema.names]

    shared = kept.where(~alone).withColumn(dealt, F.pmod(F.xxhash64(number), F.lit(many)))
    packed = shared.groupBy(dealt).applyInPandas(run, schema)
    full = kept.where(alone).select(*own, (-1 - F.col(number)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
