"""Idempotent staging of canonical events, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stage(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Arrived events (event_id, slot, ...) with status: UNCHANGED (id known), SOURCE_CHANGED (slot known under another id) or ADDED.

    Of several arrived rows of one id, the one with the least hash counts.
    """
    w = W.partitionBy("event_id").orderBy(F.xxhash64(*arrived.columns))
    once = arrived.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    ids, slots = stored.select("event_id").distinct().withColumn("__id", F.lit(True)), stored.select("slot").distinct().withColumn("__slot", F.lit(True))
    own = once.join(ids, "event_id", "left").join(slots, "slot", "left")
    return own.withColumn("status", F.when(F.col("__id"), "UNCHANGED").when(F.col("__slot"), "SOURCE_CHANGED").otherwise("ADDED")).drop("__id", "__slot")


def rebuild_boundary(stored: DataFrame, arrived: DataFrame, date: str = "trade_date") -> DataFrame:
    """By account, the earliest date of events that aren't stored yet, from which its history is to be built anew, and how many they are."""
    new = arrived.join(stored.select("event_id").distinct(), "event_id", "left_anti")
    return new.groupBy("account_id").agg(F.min(date).alias("rebuild_from"), F.count("*").alias("late"))


def current(store: DataFrame) -> DataFrame:
    """What counts of a store of stream_events: of each slot the events of its latest batch, since a changed source replaces what it said before."""
    latest = F.max("batch").over(W.partitionBy("slot"))
    return store.withColumn("__latest", latest).where("batch = __latest").drop("__latest")


def stream_events(spark: SparkSession, path: str, schema, store: str, checkpoint: str) -> None:
    """Stage every file that arrives under ``path`` into the Parquet table ``store``; late rows are never dropped.

    Each micro-batch is staged against the batches before it and written, with its status, to a partition of its own
    number, which is replaced if the batch runs again, so a restart neither loses nor doubles events.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(store)

    def batch(df: DataFrame, number: int) -> None:
        known = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
        full = df.withColumns({"status": F.lit(""), "batch": F.lit(0).cast("long")})
        stored = spark.read.schema(full.schema).parquet(store).where(F.col("batch") < number) if known else full.limit(0)
        stage(stored, df).where("status <> 'UNCHANGED'").select(*df.columns, "status").write.mode("overwrite").parquet(f"{store}/batch={number}")

    source = spark.readStream.schema(schema).parquet(path)
    source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
