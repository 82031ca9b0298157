"""Samples: key STRING, seq LONG (arrival order within a key), ts_ms LONG, value DOUBLE; readers and writers of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "key string, seq long, ts_ms long, value double"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def millis(ts: str) -> Column:
    """Floor of a zone-free timestamp to epoch milliseconds, whatever the session's time zone."""
    return F.expr(f"(timestampdiff(MICROSECOND, {EPOCH}, {ts}) - pmod(timestampdiff(MICROSECOND, {EPOCH}, {ts}), 1000)) div 1000")


def bound(ms: int) -> Column:
    """The timestamp of epoch milliseconds: bounds are converted, not the column, so that they reach the Parquet scan."""
    return F.expr(f"timestampadd(MILLISECOND, {int(ms)}L, {EPOCH})")


def _between(df: DataFrame, ts: str, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(ts) >= bound(start))
    return df if end is None else df.filter(F.col(ts) < bound(end + 1))


def samples_from_events(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None, key: str = "event_type") -> DataFrame:
    """Events as samples; start and end (inclusive, ms) are pushed down to the scan."""
    e = _between(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", start, end)
    return e.select(F.col(key).cast("string").alias("key"), F.col("event_id").alias("seq"), millis("ts").alias("ts_ms"), "value")


def samples_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples, far out of time order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("seq"), millis("o_orderdate").alias("ts_ms"), F.col("o_totalprice").alias("value"))


def explode_series(batches: DataFrame) -> DataFrame:
    """Nested batches (key, samples ARRAY<STRUCT<ts_ms, value>>, batch LONG) as samples; seq follows batch and place."""
    return batches.select("key", "batch", F.posexplode("samples").alias("at", "s")).select("key", (F.shiftleft("batch", 32) + F.col("at")).alias("seq"), "s.ts_ms", "s.value")


def write_samples(samples: DataFrame, path: str, buckets: int = 64) -> None:
    """Append. Files are dealt by a hash of the key and sorted by key and time, so that key and time ranges prune."""
    dealt = samples.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    # A second, time-based salt keeps one key with a third of the rows from landing in one task.
    dealt = dealt.repartition("bucket", F.expr("ts_ms div 86400000"))
    dealt.sortWithinPartitions("bucket", "key", "ts_ms").write.mode("append").partitionBy("bucket").parquet(path)


def read_samples(spark: SparkSession, path: str, key: str | None = None, start: int | None = None, end: int | None = None, buckets: int = 64) -> DataFrame:
    """Q1, Q2 on the stored layout: the key prunes folders, key and time prune row groups."""
    df = spark.read.schema(f"{SAMPLES}, bucket int").parquet(path)
    if key is not None:
        df = df.filter((F.col("bucket") == F.pmod(F.xxhash64(F.lit(key)), F.lit(buckets))) & (F.col("key") == key))
    if start is not None:
        df = df.filter(F.col("ts_ms") >= start)
    if end is not None:
        df = df.filter(F.col("ts_ms") <= end)
    return df.select("key", "seq", "ts_ms", "value")


def write_replicated(samples: DataFrame, path: str, nodes: list[str], replicas: int) -> None:
    """Every sample once for each node of its key's replica set, a folder a node."""
    from tidewake.operators.cluster import fan_out

    dealt = fan_out(samples, nodes, replicas)
    dealt.repartition("node", F.pmod(F.xxhash64("key", "seq"), F.lit(16))).write.mode("append").partitionBy("node").parquet(path)
