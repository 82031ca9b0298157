"""A load generator: series written in batches, then one raw and two averaging queries."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import ranges
from tidewake.sources import tables, workload


def write_batches(spark: SparkSession, path: str, series: int = 500, samples: int = 1000, batch: int = 50, buckets: int = 64) -> dict[str, float]:
    """Write the workload, ``batch`` series at a time. Returns batches, accepted (samples), seconds, points_per_s."""
    start = time.perf_counter()
    for first in range(0, series, batch):
        own = workload.generate(spark, min(batch, series - first), samples, first=first)
        tables.write_samples(own.select("key", "seq", "ts_ms", "value"), path, buckets)
    seconds = time.perf_counter() - start
    accepted = tables.read_samples(spark, path).count()
    return {"batches": -(-series // batch), "accepted": accepted, "seconds": seconds, "points_per_s": accepted / seconds}


def queries(spark: SparkSession, path: str, samples: int, buckets: int = 64) -> DataFrame:
    """key, agg, scalar, scanned of the first three series over the span of the samples: raw, then the average twice.

    scanned is the number of samples that match; scalar is 0.0 for the raw one."""
    end = workload.START_MS + samples * workload.STEP_MS
    out = None
    for n, agg in enumerate(("none", "avg", "avg")):
        key = spark.range(n, n + 1).select(workload.series_key(F.col("id")).alias("key")).first()["key"]
        own = tables.read_samples(spark, path, key, workload.START_MS, end, buckets)
        scalar = ranges.aggregates()["avg"] if agg == "avg" else F.lit(0.0)
        row = own.agg(scalar.alias("scalar"), F.count(F.lit(1)).alias("scanned")).select(F.lit(key).alias("key"), F.lit(agg).alias("agg"), "scalar", "scanned")
        out = row if out is None else out.unionByName(row)
    return out
