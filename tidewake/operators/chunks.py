"""Chunks of 1,024 samples in arrival order, their metadata, pruning, and bit accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.hashing import double_bits

CHUNK = 1024
#: Arrival numbers that are counted together; a longer series is numbered by several tasks.
SPAN = 1 << 20


def number(samples: DataFrame, span: int = SPAN) -> DataFrame:
    """Samples with rn, from 1 in each key by seq.

    Spans of seq are counted first; a row's number is its place in its span after the rows of the spans before. No
    task sorts a whole series, however long it is."""
    part = F.floor(F.col("seq") / span)
    spans = samples.groupBy("key", part.alias("span")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    offsets = spans.select("key", "span", F.coalesce(before, F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("key", "span").orderBy("seq"))
    return samples.withColumn("span", part).join(offsets, ["key", "span"]).withColumn("rn", own + F.col("offset")).drop("span", "offset")


def assign_chunks(samples: DataFrame, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """Samples with chunk_id LONG."""
    return number(samples, span).withColumn("chunk_id", F.floor((F.col("rn") - 1) / chunk).cast("long")).drop("rn")


def chunk_meta(chunked: DataFrame) -> DataFrame:
    """First and last by arrival, least and greatest by time."""
    return chunked.groupBy("key", "chunk_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("ts_ms", "seq").alias("first_ts"), F.max_by("ts_ms", "seq").alias("last_ts"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts")
    )


def kept(meta: DataFrame, start: int, end: int, arrival: bool = False) -> DataFrame:
    """Q3: the chunks that may hold samples of the range. arrival: by first and last sample, which loses rows of
    chunks out of time order, as the store described does; the default is by least and greatest time, which is right."""
    low, high = ("first_ts", "last_ts") if arrival else ("min_ts", "max_ts")
    return meta.filter((F.col(high) >= start) & (F.col(low) <= end))


def pruned_range(chunked: DataFrame, start: int, end: int, arrival: bool = False) -> DataFrame:
    """Rows of the range in the chunks kept."""
    own = kept(chunk_meta(chunked), start, end, arrival).select("key", "chunk_id")
    return chunked.filter(F.col("ts_ms").between(start, end)).join(own, ["key", "chunk_id"], "left_semi")


def deltas(chunked: DataFrame) -> DataFrame:
    """T4, T5: delta to the sample before in the chunk (null for the first), and its change (the first delta counts whole)."""
    own = Window.partitionBy("key", "chunk_id").orderBy("seq")
    d = chunked.withColumn("delta", F.col("ts_ms") - F.lag("ts_ms").over(own))
    return d.withColumn("dod", F.col("delta") - F.coalesce(F.lag("delta").over(own), F.lit(0)))


def dod_bits(dod: Column) -> Column:
    """The bits of a timestamp; null is the first of a chunk."""
    return F.when(dod.isNull(), 64).when(dod == 0, 1).when(dod.between(-63, 64), 9).when(dod.between(-255, 256), 12).when(dod.between(-2047, 2048), 16).otherwise(68)


def timestamp_bits(chunked: DataFrame) -> DataFrame:
    return deltas(chunked).groupBy("key", "chunk_id").agg(F.sum(dod_bits(F.col("dod"))).cast("long").alias("ts_bits"))


def xor_values(chunked: DataFrame) -> DataFrame:
    """X, the change of the bit pattern in the chunk (null for the first), with its leading zeros (31 at most)
    and trailing zeros where it is not zero."""
    own = Window.partitionBy("key", "chunk_id").orderBy("seq")
    bits = chunked.withColumn("bits", double_bits("value"))
    x = bits.withColumn("x", F.col("bits").bitwiseXOR(F.lag("bits").over(own)))
    lead = F.least(F.lit(64) - F.length(F.bin("x")), F.lit(31))
    trail = F.bit_count((F.col("x") - F.lit(1)).bitwiseAND(F.bitwise_not("x")))
    return x.withColumn("lead", F.when(F.col("x") != 0, lead)).withColumn("trail", F.when(F.col("x") == F.lit(-(1 << 63)), 63).when(F.col("x") != 0, trail))
