"""S5, F-1 to F-6: synthetic monitoring series.

Drawn per (seed, series, step) from a hash instead of one shared random sequence, so any part can be made on any
executor: the shares and shapes are those of the described workload, the draws are not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of the metrics, in order of their number.
METRICS = ["cpu.usage", "mem.used", "net.rx", "disk.io", "http.reqs"]
STEP_MS, START_MS, SEED = 15_000, 1_700_000_000_000, 1234


def series_key(i: Column) -> Column:
    """F-1."""
    metric = F.element_at(F.array(*map(F.lit, METRICS)), (i % 5 + 1).cast("int"))
    return F.concat(metric, F.lit("{host=h"), (F.floor(i / 5) % 256).cast("string"), F.lit(",inst="), i.cast("string"), F.lit("}"))


def metric_kind(i: Column) -> Column:
    """F-2: 50, 30 and 20 of each hundred series."""
    r = i % 100
    return F.when(r < 50, "flat").when(r < 80, "counter").otherwise("wander")


def draw(*parts: Column | int) -> Column:
    """Uniform in [0, 1), decided by the parts."""
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), F.lit(1 << 30)) / float(1 << 30)


def _wander(pdf: pd.DataFrame) -> pd.DataFrame:
    """F-6: a clamped walk cannot be a running sum."""
    pdf = pdf.sort_values("seq")
    value, out = 0.75, np.empty(len(pdf))
    for n, step in enumerate(np.where(pdf["u"] < 1 / 3, -0.01, np.where(pdf["u"] < 2 / 3, 0.0, 0.01))):
        value = max(0.0, round(value + step, 2))
        out[n] = value
    return pdf.assign(value=out)[["key", "kind", "seq", "ts_ms", "value"]]


def generate(spark: SparkSession, series: int, samples: int, seed: int = SEED, first: int = 0) -> DataFrame:
    """key, kind, seq, ts_ms, value of series x samples points, of the series from number first on."""
    i, s = F.col("i"), F.col("seq")
    grid = spark.range(first, first + series).withColumnRenamed("id", "i").select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))).alias("seq"))
    own = Window.partitionBy("i").orderBy("seq")
    jitter = F.when(draw(seed, 1, i, s) < 1 / 200, F.floor(draw(seed, 2, i, s) * 3) - 1).otherwise(0)
    base = grid.select("i", "seq", series_key(i).alias("key"), metric_kind(i).alias("kind"), (F.lit(START_MS) + F.sum(F.lit(STEP_MS) + jitter).over(own)).cast("long").alias("ts_ms"))
    redraw = F.when((s == 0) | (draw(seed, 3, i, s) >= 0.85), F.floor(draw(seed, 4, i, s) * 100).cast("double"))
    flat = base.filter("kind = 'flat'").withColumn("value", F.last(redraw, ignorenulls=True).over(own))
    counter = base.filter("kind = 'counter'").withColumn("value", counter_value(s))
    walk = base.filter("kind = 'wander'").withColumn("u", draw(seed, 5, i, s)).groupBy("key").applyInPandas(_wander, "key string, kind string, seq long, ts_ms long, value double")
    columns = ["key", "kind", "seq", "ts_ms", "value"]
    return flat.select(columns).unionByName(counter.select(columns)).unionByName(walk)


def counter_value(s: Column) -> Column:
    """F-5."""
    return (F.lit(1000) + 2 * (s + 1)).cast("double")
