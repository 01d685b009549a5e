"""Histories in versioned files under a manifest that is swapped by one rename: readers see the old rows or the new, never a mixture."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "MANIFEST.json"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The folders of the history by year, and those of the version before; empty without one."""
    fs, at = _fs(spark, path), _path(spark, f"{path}/{MANIFEST}")
    if not fs.exists(at):
        return {"years": {}, "before": []}
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def _swap(spark: SparkSession, path: str, content: dict) -> None:
    """Write a manifest beside the one in place and rename it over that: the one step that makes a version visible."""
    new, at = _path(spark, f"{path}/{MANIFEST}.{uuid.uuid4().hex}"), _path(spark, f"{path}/{MANIFEST}")
    stream = _fs(spark, path).create(new, True)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, path).makeQualified(at).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(_fs(spark, path).makeQualified(new), _fs(spark, path).makeQualified(at), how)


def replace_history(rows: DataFrame, path: str, date: str = "trade_date", from_date: str | None = None) -> None:
    """Make ``rows`` the history under ``path``; with ``from_date``, its rows from that day on, while those before stay.

    New files go to folders of their own by year; years before the boundary keep theirs, the boundary's year is written
    anew with what it keeps. A crash before the rename leaves the old history, one after it the new. Folders that
    neither this version nor the one before names are removed at the end, so a reader of the old manifest finishes. One
    writer at a time. Rows with a null date take no part.
    """
    spark = rows.sparkSession
    now = manifest(spark, path)
    new = rows.where(F.col(date).isNotNull())
    kept = {}
    if from_date is not None:
        boundary = int(from_date[:4])
        kept = {y: f for y, f in now["years"].items() if int(y) < boundary}
        new = new.where(F.col(date) >= F.lit(from_date))
        if str(boundary) in now["years"]:
            new = new.unionByName(spark.read.parquet(f"{path}/{now['years'][str(boundary)]}").where(F.col(date) < F.lit(from_date)), allowMissingColumns=True)
    version, year = uuid.uuid4().hex, "__year"
    new.withColumn(year, F.year(date)).write.partitionBy(year).parquet(f"{path}/data/{version}")
    fs = _fs(spark, path)
    made = [s.getPath().getName() for s in fs.listStatus(_path(spark, f"{path}/data/{version}")) if s.isDirectory()]
    years = kept | {n.split("=")[1]: f"data/{version}/{n}" for n in made if n.startswith(f"{year}=")}
    _swap(spark, path, {"years": years, "before": sorted(now["years"].values())})
    used = {f.split("/")[1] for f in [*years.values(), *now["years"].values()]}
    for folder in fs.listStatus(_path(spark, f"{path}/data")):
        if folder.getPath().getName() not in used:
            fs.delete(folder.getPath(), True)


def read_history(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The history as its manifest has it now; an empty table of ``schema`` where there is none."""
    folders = sorted(manifest(spark, path)["years"].values())
    if not folders:
        if schema is None:
            raise FileNotFoundError(f"no history under {path}")
        return spark.createDataFrame([], schema)
    return spark.read.option("mergeSchema", True).parquet(*[f"{path}/{f}" for f in folders])
