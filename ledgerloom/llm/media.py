"""Media columns: payloads stored as images in zip archives, and a Spark data source that reads them by byte ranges."""

from __future__ import annotations

import os
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ledgerloom.llm.common import fresh_path

#: Samples of an image row; bytes of an archive that one task reads; bytes of a batch; tries of one member.
WIDTH, RANGE_BYTES, BATCH_BYTES, TRIES = 64, 8 << 20, 4 << 20, 3

_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(data: bytes) -> bytes:
    """An 8-bit grey PNG, WIDTH samples a row, of ``data`` and as many zero bytes as fill the last row (one row at least).

    The number of bytes before them stands in a text chunk. Equal data give equal images.
    """
    rows = max(1, -(-len(data) // WIDTH))
    flat = np.zeros(rows * WIDTH, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = flat.reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[int, np.ndarray]:
    """Byte count and samples (rows x WIDTH) of an image by to_png; checks every chunk's sum."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, parts, n, shape = 8, [], 0, (0, 0)
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])[::-1]
        elif kind == b"tEXt":
            n = int(body.split(b"\0")[1])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[0], shape[1] + 1)
    return n, lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy and share of empty samples, as text."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    p = counts[counts > 0] / samples.size
    mean = float((np.arange(256) * counts).sum() / samples.size)
    spread = float((((np.arange(256) - mean) ** 2) * counts).sum() / samples.size) ** 0.5
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} std={spread:.4f} entropy={-(p * np.log2(p)).sum() + 0.0:.4f} zero={counts[0] / samples.size:.4f}"


_ENTRY = struct.Struct("<QQIH")  # offset of a member's header, its size, its sum, length of its name


def _slice_of(members: list[zipfile.ZipInfo]) -> bytes:
    names = [m.filename.encode() for m in members]
    return b"".join(_ENTRY.pack(m.header_offset, m.file_size, m.CRC, len(n)) + n for m, n in zip(members, names, strict=True))


def _members_of(part: bytes) -> Iterator[tuple[int, int, int, str]]:
    at = 0
    while at < len(part):
        offset, size, crc, n = _ENTRY.unpack_from(part, at)
        at += _ENTRY.size + n
        yield offset, size, crc, part[at - n : at].decode()


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", to: str | None = None, range_bytes: int = RANGE_BYTES) -> str:
    """Store every row's text (UTF-8; null: empty) as an image in one zip archive a task; returns the path.

    Beside each archive stands an index of its directory, in slices for byte ranges of about ``range_bytes``; the manifest
    has a row for each range. Files go to a fresh shared folder under names no other attempt uses, and the manifest lists
    those of successful attempts alone, so a lost executor leaves at most files that nobody reads. A member's name holds
    the id, or none for null. Rows may repeat; an empty table has an empty manifest; other columns are ignored.
    """
    to = to or fresh_path(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(to)
        archive, name, n = None, f"{root}/archives/{uuid.uuid4().hex}.zip", 0
        held: list[zipfile.ZipInfo] = []
        slices: list[tuple[int, int, int, int]] = []  # start and end in the archive, start and length in the index

        def close_slice(end: int) -> None:
            part = _slice_of(held)
            index.write(part)
            slices.append((held[0].header_offset, end, sum(x[3] for x in slices), len(part)))
            held.clear()

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    store.create_dir(os.path.dirname(name), recursive=True)
                    out, index = store.open_output_stream(name), store.open_output_stream(f"{name}.index")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                info = zipfile.ZipInfo(f"{n}/{key.as_py()}.png" if key.is_valid else f"{n}.png")
                archive.writestr(info, to_png((text.as_py() or "").encode("utf-8", "surrogatepass")))
                if held and info.header_offset - held[0].header_offset >= range_bytes:
                    close_slice(info.header_offset)
                held.append(info)
                n += 1
        if archive is not None:
            close_slice(archive.start_dir)
            archive.close()
            out.close()
            index.close()
            columns = [pa.array(c, pa.int64()) for c in zip(*slices, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(slices)), *columns], ["archive", "start", "end", "index_start", "index_bytes"])

    bare = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    bare.mapInArrow(run, "archive string, start long, end long, index_start long, index_bytes long").write.parquet(f"{to}/manifest")
    return to


class ByteRange(InputPartition):
    def __init__(self, archive: str, start: int, end: int, index_start: int, index_bytes: int):
        self.archive, self.start, self.end, self.index_start, self.index_bytes = archive, start, end, index_start, index_bytes


def _read(f: pa.NativeFile, offset: int, size: int, crc: int) -> bytes:
    head = f.read_at(30, offset)
    magic, name_len, extra_len = head[:4], *struct.unpack("<HH", head[26:30])
    if magic != b"PK\x03\x04":
        raise ValueError("no member here")
    data = f.read_at(size, offset + 30 + name_len + extra_len)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("damaged member")
    return data


def read_member(store: fs.FileSystem, archive: str, offset: int, size: int, crc: int, tries: int = TRIES, wait_s: float = 0.2, before: int = 0) -> tuple[bytes | None, int, str | None]:
    """The stored member whose local header is at ``offset``: (bytes or None, tries made, last error); each try opens the archive anew."""
    error = None
    for k in range(before + 1, tries + 1):
        if k > 1:
            time.sleep(wait_s * 2 ** (k - 2))
        try:
            with store.open_input_file(archive) as f:
                return _read(f, offset, size, crc), k, None
        except (OSError, ValueError, struct.error) as e:
            error = f"{type(e).__name__}: {e}"
    return None, tries, error


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.permissive = str(options.get("permissive", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """The byte ranges that the manifest lists; what lies in them is read by the tasks."""
        store, root = fs.FileSystem.from_uri(self.root)
        files = [f.path for f in store.get_file_info(fs.FileSelector(f"{root}/manifest")) if f.base_name.startswith("part-")]
        out: list[InputPartition] = []
        for f in files:
            t = pq.read_table(f, filesystem=store)
            out += [ByteRange(*row) for row in zip(*(t[c].to_pylist() for c in ("archive", "start", "end", "index_start", "index_bytes")), strict=True)]
        return out or [ByteRange("", 0, 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """Members of the range, from its slice of the directory, in small batches; the archive is opened once, and anew for each further try of a member."""
        if not partition.archive:
            return
        store, _ = fs.FileSystem.from_uri(self.root)
        with store.open_input_file(f"{partition.archive}.index") as f:
            part = f.read_at(partition.index_bytes, partition.index_start)
        rows, held = [], 0
        with store.open_input_file(partition.archive) as f:
            for offset, size, crc, name in _members_of(part):
                try:
                    data, tries, error = _read(f, offset, size, crc), 1, None
                except (OSError, ValueError, struct.error):
                    data, tries, error = read_member(store, partition.archive, offset, size, crc, before=1)
                if error and not self.permissive:
                    raise OSError(f"{partition.archive} at {offset}: {error}")
                rows.append((partition.archive, offset, name, data, tries, error))
                held += size
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"archive": pa.string(), "offset": pa.int64(), "name": pa.string(), "media": pa.binary(), "tries": pa.int32(), "error": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


class ArchiveSource(DataSource):
    """``spark.read.format("archive_members").load(path)`` on a path that write_archives returned.

    Option: permissive (a member that can't be read after its tries is a row with an error, not a failure).
    """

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary, tries int, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)


def decode_media(members: DataFrame) -> DataFrame:
    """``archive, offset, name, media`` with n_bytes, payload (all samples) and feature.

    Null media (members that couldn't be read) have nulls; damaged images fail; equal images have equal results; an empty
    table has no rows; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 128):
                part = batch.slice(s, 128)
                got = [from_png(m.as_py()) if m.is_valid else (None, None) for m in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([n for n, _ in got], pa.int64()), pa.array([None if x is None else x.tobytes() for _, x in got], pa.binary()), pa.array([None if x is None else feature(x) for _, x in got])], [*part.schema.names, "n_bytes", "payload", "feature"])

    own = members.select("archive", "offset", "name", "media")
    return own.mapInArrow(run, "archive string, offset long, name string, media binary, n_bytes long, payload binary, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text and read it back: (id as string, n_bytes, media, payload, feature), one row per input row.

    Null and empty texts are one row of 64 zero samples. Equal texts have equal media. Extra columns are ignored.
    """
    spark = docs.sparkSession
    spark.dataSource.register(ArchiveSource)
    members = spark.read.format("archive_members").load(write_archives(docs, id_col, text_col))
    name = r"(?s)^\d+/(.*)\.png$"
    return decode_media(members).select(F.when(F.col("name").rlike(name), F.regexp_extract("name", name, 1)).alias(id_col), "n_bytes", "media", "payload", "feature")
