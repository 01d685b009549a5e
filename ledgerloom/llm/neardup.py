"""Near-duplicate documents: one-permutation MinHash, densified, banded, with star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, WordScan, bitmap, chain, components_in, counter_of, flagged, marked, mix, rarity, written

#: Hash values of a signature, and how many make one band: a pair at similarity 0.75 misses all 32 bands with p < 1e-5.
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
WORDS = 5
#: Classes of more copies are dealt to so many places where rows meet their class.
LARGE, SALTS = 1_000, 64

_SHIFT = np.uint64(64 - 7)
_STARTS = np.arange(BINS, dtype=np.uint64) << _SHIFT
#: For each bin the order in which it borrows from others (one universal random permutation per bin).
_BORROW = np.stack([np.random.default_rng(1_000 + i).permutation(BINS) for i in range(BINS)])


def shingle_sets(texts: pa.Array, scan: WordScan, words: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct 64-bit hashes of the word shingles of whole texts, for slices of rows: (first row, sets).

    A-Z is lower-cased and words are runs without ASCII white space. A text with fewer words is one shingle, an empty
    or null one has none.
    """
    for start, end, h, row, _ in scan.parts(texts):
        n = np.bincount(row, minlength=end - start)
        at = np.cumsum(n) - n
        full = chain([h[i : len(h) - words + 1 + i] for i in range(words)]) if len(h) >= words else h[:0]
        yield start, [np.unique(full[a : a + k - words + 1]) if k >= words else chain([h[a + i : a + i + 1] for i in range(k)]) + np.uint64(k) if k else h[:0] for a, k in zip(at, n, strict=True)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest shingle in each of BINS ranges of one permutation; empty bins borrow from the first filled bin of their own random order."""
    at = np.searchsorted(shingles, _STARTS)
    first = shingles[np.minimum(at, len(shingles) - 1)]
    filled = (at < len(shingles)) & ((first >> _SHIFT) == np.arange(BINS, dtype=np.uint64))
    if not filled.all():
        empty = np.flatnonzero(~filled)
        first = first.copy()
        first[empty] = first[_BORROW[empty, filled[_BORROW[empty]].argmax(1)]]
    return first


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS)
    return chain([parts[:, i] for i in range(ROWS)] + [np.arange(BANDS, dtype=np.uint64)]).view(np.int64)


def _listed(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).view(np.int64), pa.int64()))


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, other = WordScan(), np.uint64(0xA5A5A5A5A5A5A5A5)
        for batch in batches:
            for start, sets in shingle_sets(batch.column(1), scan, words):
                x = [int(s.sum().view(np.int64)) for s in sets]
                y = [int(mix(s ^ other).sum().view(np.int64)) for s in sets]
                bands = [band_keys(signature(s)) if len(s) else np.empty(0, np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), _listed(bands)], ["id", "n", "x", "y", "bands"])

    return run


def _sets(shared: Broadcast, words: int):
    """Rows (id, shingles) of documents whose id may be among the wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, bits = WordScan(), shared.value
        for batch in batches:
            own = batch.filter(pa.array(marked(bits, batch.column(2).to_numpy())))
            for start, sets in shingle_sets(own.column(1), scan, words):
                yield pa.RecordBatch.from_arrays([own.column(0).slice(start, len(sets)), _listed([s.view(np.int64) for s in sets])], ["id", "shingles"])

    return run


def _prefixes(shared: Broadcast, percent: int):
    """Rows (key, id, n, place) of the rarest shingles of sets, one of which any two linked sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                size = part.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                h = part.column(1).flatten().to_numpy().view(np.uint64)
                row = np.repeat(np.arange(len(size)), size)
                level = levels[counter_of(h)]
                order = np.lexsort((h, level, row))
                h, level = h[order], level[order]
                place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                at = np.flatnonzero((place < (size - -(-percent * size // 100) + 1)[row]) & (level > 1))
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), part.column(0).take(pa.array(row[at])), pa.array(size[row[at]]), pa.array(place[at])], ["key", "id", "n", "place"])

    return run


def _close(na: str, nb: str, percent: int):
    """Jaccard is at most the smaller size over the larger."""
    return F.expr(f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb})")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id).

    Rows with equal shingle sets are one class. Classes share a bucket when a band of their signatures is equal. Each
    bucket links its smallest class to the rest (a star). What is left, the members of buckets that then lie in several
    components, meet by an exact set-similarity join: linked sets share one of their rarest shingles (prefix filter) and
    enough after it (positional filter). Of a shingle's members, those of its most frequent component meet only others.
    So no group of copies is expanded into all pairs, and no link between a bucket's members is lost. All links are
    confirmed on full shingle sets: 100 * intersection >= percent * union.

    Ids are whole numbers, or texts of such; others fail under ANSI rules. Null or empty texts have no shingles and
    stand alone; a row with a null id is returned with n_shingles and a null component and links nothing. Rows that
    repeat an id are one node. An empty table has no rows; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as tables:
        return written(_classes(docs, id_col, text_col, words, percent, tables), "near-duplicates").withColumnRenamed("id", id_col)


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, tables: Scratch) -> DataFrame:
    bare = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = tables.written(bare.mapInArrow(_signed(words), "id long, n long, x long, y long, bands array<long>"), "signed")
    classed = signed.where("n > 0 AND id IS NOT NULL")
    reps = tables.written(classed.groupBy("x", "y", "n").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "classes")
    rows = reps.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("top")).where("least <> top").select("bucket", "least")
    rows = tables.written(rows.join(shared, "bucket"), "buckets")

    def sets_of(ids: DataFrame) -> DataFrame:
        # a bitmap of fixed size keeps most other texts from being scanned or shuffled; a few more sets do no harm
        bits = tables.broadcast(bitmap(ids.select(F.xxhash64("id").alias("name"))))
        own = bare.where("id IS NOT NULL").withColumn("h", F.xxhash64("id")).mapInArrow(_sets(bits, words), "id long, shingles array<long>")
        return tables.written(own.dropDuplicates(["id"]), "sets")

    def confirmed(pairs: DataFrame, own: DataFrame) -> DataFrame:
        met = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return met.withColumn("i", both).where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).drop("i", "sa", "sb")

    sizes = rows.groupBy("least").agg(F.min(F.when(F.col("id") == F.col("least"), F.col("n"))).alias("m"))
    stars = rows.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"), "n").distinct().join(sizes.withColumnRenamed("least", "a"), "a").where(_close("n", "m", percent))
    stars = tables.written(stars.select("a", "b"), "pairs")
    links = tables.written(confirmed(stars, sets_of(stars.select(F.col("a").alias("id")).union(stars.select("b")))), "links")
    component = components_in(links, tables)

    now = rows.select("bucket", "id", "n").join(component.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = now.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("bucket")
    left, seen = tables.counted(now.join(mixed, "bucket", "left_semi").select("id", "component").distinct(), "mixed", rows=F.count("*"))
    if seen["rows"]:
        own = sets_of(left.select("id"))
        levels = tables.broadcast(rarity(own.select("shingles"), lambda: lambda batch: [batch.column(0).flatten().to_numpy().view(np.uint64)]))
        posts = tables.written(own.mapInArrow(_prefixes(levels, percent), "key long, id long, n long, place long").join(left, "id"), "prefixes")
        counts = posts.groupBy("key", "component").agg(F.count("*").alias("members"))
        used = counts.groupBy("key").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
        posts = posts.join(used, "key")
        one = posts.where("component <> main").select("key", *[F.col(c).alias(f"{c}1") for c in ("id", "n", "place", "component")])
        # two sets outside the key's main component meet from one side only
        pairs = one.join(posts, "key").where("component1 <> component AND (component = main OR component1 < component)").where(F.least(F.col("n") - F.col("place"), F.col("n1") - F.col("place1")) >= F.ceil(percent * (F.col("n") + F.col("n1")) / (100 + percent)))
        ends = [F.when(F.col("id") < F.col("id1"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("id", "id1", "a"), ("id1", "id", "b"), ("component", "component1", "p"), ("component1", "component", "q"))]
        pairs = pairs.where(_close("n", "n1", percent)).select(*ends).distinct().join(stars, ["a", "b"], "left_anti")
        found, more = tables.counted(confirmed(tables.written(pairs, "pairs"), own).select("p", "q"), "links", rows=F.count("*"))
        if more["rows"]:  # components that are one after all
            merged = components_in(found, tables, "p", "q").toDF("component", "lower")
            component = left.union(component.toDF("id", "component")).distinct().join(merged, "component", "left").select(F.col("id").alias("node"), F.coalesce("lower", "component").alias("component"))

    # copies of one text may be many: they meet their class in SALTS places
    large = bitmap(reps.where(F.col("copies") > LARGE).select(F.xxhash64("x").alias("name")))
    own = flagged(classed.select("id", "x", "y", "n").withColumn("h", F.xxhash64("x")), "h", large, "large")
    own = own.withColumn("salt", F.when(F.col("large"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    each = flagged(reps.select("x", "y", "n", "rep").withColumn("h", F.xxhash64("x")), "h", large, "large")
    each = each.withColumn("salt", F.explode(F.when(F.col("large"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    by_class = own.join(each.select("x", "y", "n", "salt", "rep"), ["x", "y", "n", "salt"]).select("id", "rep")
    by_class = by_class.join(component, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("component_id"))
    by_class = by_class.groupBy("id").agg(F.min("component_id").alias("component_id"))
    return signed.select("id", F.col("n").alias("n_shingles")).join(by_class, "id", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
