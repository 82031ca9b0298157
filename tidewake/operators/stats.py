"""Compression report, nearest-rank percentiles, threshold shares, lossless check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators import codec


def percentiles(df: DataFrame, x: str, points: list[float]) -> DataFrame:
    """P, value: the sorted element at the 0-based place min(n - 1, floor(p / 100 * n)).

    Equal values are counted first, then a running count over distinct values finds the places; no list is gathered.
    The running count is made per range of values, so that no task sorts them all. NaN sorts after all numbers."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    # Ranges by the exponent and top bits of the double; their totals are a small table.
    part = F.when(F.isnan("x"), F.lit((1 << 62))).when(F.abs("x") == float("inf"), F.signum("x") * (1 << 30)).otherwise(F.floor(F.signum("x") * F.log2(F.abs("x") + 1) * 16)).cast("long")
    counts = counts.withColumn("part", part)
    parts = counts.groupBy("part").agg(F.sum("n").alias("pn"))
    before = F.coalesce(F.sum("pn").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("offset"), F.sum("pn").over(Window.partitionBy(F.lit(0))).alias("total"))
    upto = counts.join(offsets, "part").select("x", "n", "total", (F.col("offset") + F.sum("n").over(Window.partitionBy("part").orderBy("x"))).alias("upto"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("p")
    at = F.least(F.col("total") - 1, F.floor(F.col("p") * F.col("total") / 100))
    return upto.select("x", "n", "total", "upto", wanted).filter((at < F.col("upto")) & (at >= F.col("upto") - F.col("n"))).select("p", F.col("x").alias("value"))


def threshold(df: DataFrame, x: str, limit: float) -> DataFrame:
    """The largest, the share at most the limit, the mean."""
    return df.agg(F.max(x).alias("largest"), F.avg(F.when(F.col(x) <= limit, 1.0).otherwise(0.0)).alias("share"), F.avg(x).alias("mean"))


def compression_report(chunks: DataFrame, kind: str = "kind") -> DataFrame:
    """Per kind and over all (kind null): points, raw bytes (16 a point), bytes, ratio, bytes a point."""
    own = chunks.rollup(kind).agg(F.sum("n").alias("points"), F.sum(F.length("payload")).alias("bytes"))
    return own.select(kind, "points", (F.col("points") * 16).alias("raw"), "bytes", (F.col("points") * 16 / F.col("bytes")).alias("ratio"), (F.col("bytes") / F.col("points")).alias("bytes_per_point"))


def roundtrip_mismatches(chunked: DataFrame) -> DataFrame:
    """Per key, samples that differ after encoding and decoding; both happen where the chunk is."""
    return codec.mismatches(chunked).groupBy("key").agg(F.sum("mismatches").alias("mismatches"))
