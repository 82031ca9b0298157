"""Inclusive time-range queries over one series or many windows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATIONS = ("none", "sum", "avg", "min", "max", "count")


def select_range(samples: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Q1, Q2: one key, start <= ts_ms <= end; an unknown key or start > end gives no rows."""
    return samples.filter((F.col("key") == key) & F.col("ts_ms").between(start, end))


def lowest(v: Column) -> Column:
    """A3: NaN never wins, as it sorts after all numbers; all NaN gives +inf; no rows give 0.0."""
    least = F.min(v)
    return F.when(F.count(v) == 0, 0.0).when(F.isnan(least), float("inf")).otherwise(least)


def highest(v: Column) -> Column:
    """A4: as lowest, with -inf; of the values' negatives, so that NaN sorts last here too."""
    return -F.when(F.count(v) == 0, 0.0).when(F.isnan(F.min(-v)), float("inf")).otherwise(F.min(-v))


def aggregates(value: str = "value") -> dict[str, Column]:
    """One partial and one final hash aggregate, whose buffer holds a sum, a count and two minima."""
    v = F.col(value)
    zero = F.lit(0.0)
    return {"sum": F.coalesce(F.sum(v), zero), "avg": F.when(F.count(v) > 0, F.sum(v) / F.count(v)).otherwise(zero), "min": lowest(v), "max": highest(v) + zero, "count": F.count(v).cast("double")}


def range_raw(samples: DataFrame, key: str, start: int, end: int, ordered: bool = False) -> DataFrame:
    """Q7, Q9: ts_ms, value; in arrival order if asked for."""
    rows = select_range(samples, key, start, end)
    return (rows.orderBy("seq") if ordered else rows).select("ts_ms", "value")


def range_query(samples: DataFrame, key: str, start: int, end: int, agg: str) -> DataFrame:
    """One row with scalar and scanned (the samples that match)."""
    if agg not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {agg}")
    if agg == "none":
        return range_raw(samples, key, start, end)
    return select_range(samples, key, start, end).agg(aggregates()[agg].alias("scalar"), F.count(F.lit(1)).alias("scanned"))


def range_by_code(samples: DataFrame, key: str, start: int, end: int, code: int) -> DataFrame:
    """The aggregation by its number (1 sum, 2 avg, 3 min, 4 max, 5 count); an unknown number gives 0.0."""
    rows = select_range(samples, key, start, end)
    if not 1 <= code <= 5:
        return rows.agg(F.count(F.lit(1)).alias("scanned")).select(F.lit(0.0).alias("scalar"), "scanned")
    return rows.agg(aggregates()[AGGREGATIONS[code]].alias("scalar"), F.count(F.lit(1)).alias("scanned"))


def batch_query(samples: DataFrame, windows: DataFrame, bin_ms: int = 6 * 3_600_000) -> DataFrame:
    """qid and the five aggregates for each window (qid, key, start, end) in one job.

    A range join by bins: windows are cut at multiples of bin_ms and meet the samples on key and bin, an equi-join that
    AQE can split when a series is hot. Windows without samples give zeros."""
    at = lambda c: F.floor(F.col(c) / bin_ms)
    cut = windows.filter("start <= end").select("qid", "key", "start", "end", F.explode(F.sequence(at("start"), at("end"))).alias("bin"))
    found = samples.select("key", "ts_ms", "value", at("ts_ms").alias("bin")).join(cut, ["key", "bin"]).filter(F.col("ts_ms").between(F.col("start"), F.col("end")))
    per = found.groupBy("qid").agg(*[c.alias(n) for n, c in aggregates().items()])
    return windows.select("qid").join(per, "qid", "left").select("qid", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in aggregates()])


def index_bounds(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Q8: per key, how many samples lie before start, and up to end."""
    t = F.col("ts_ms")
    return samples.groupBy("key").agg(F.count(F.when(t < start, 1)).alias("lower"), F.count(F.when(t <= end, 1)).alias("upper"))


def series_count(samples: DataFrame) -> DataFrame:
    """A11."""
    return samples.agg(F.count_distinct("key").alias("series"))


def samples_per_series(samples: DataFrame) -> DataFrame:
    """A12."""
    return samples.groupBy("key").agg(F.count(F.lit(1)).alias("samples"))
