"""Shared helpers: tables in the shared folder, and Arrow maps in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.sources.shared import delete, shared_path

#: Text handed to a Python function at once, so that a worker's memory does not depend on the length of the rows.
SLICE_BYTES = 4 << 20


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: later failures restart from the files, not from the sources.
    The files go with the session, or with delete_cut()."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_cut(df: DataFrame) -> None:
    """Delete the files of a table from cut() that nothing reads any more."""
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        delete(df.sparkSession, folder)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    lead = "__"
    while any(c.lower().startswith(lead) for c in df.columns):
        lead += "_"
    return [lead + n for n in names]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of about SLICE_BYTES in the column (one row at least)."""
    sizes = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= SLICE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, column: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over bounded slices; make() runs once a task and returns the function of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, column):
                yield work(part)

    return df.mapInArrow(run, schema)


#: look_up() broadcasts the keys that hold more than 1/HOT_SHARE of the rows: fewer than HOT_SHARE, whatever the table.
HOT_SHARE = 1000


def look_up(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left.join(right, key, "left") where right has one row a key and any key may hold a large part of left's rows.

    Rows of hot keys stay where they are and meet a broadcast; all others are shuffled. Both sides are read more than
    once: tables or cheap to compute. Hot keys are found by counts that are combined before the shuffle."""
    limit = left.count() / HOT_SHARE
    hot = F.broadcast(cut(left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(key), "hot-keys"))
    own = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, "left")
    return own.unionByName(left.join(hot, key, "left_anti").join(right, key, "left"))
