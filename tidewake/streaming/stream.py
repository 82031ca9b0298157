"""Structured Streaming: ingest, sealing of chunks, failure detection.

State is per key: the open samples of a series (fewer than a chunk), or the misses of a node. Rows of a key within a
micro-batch are put in order of seq, as columns of numbers; across batches the source's order counts. Micro-batches are
bounded by the files a trigger takes, so what a task holds does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewake.operators.chunks import CHUNK
from tidewake.sources.tables import millis

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Files of a micro-batch.
FILES_PER_TRIGGER = 64
META = "key string, chunk_id long, n long, first_ts long, last_ts long, min_ts long, max_ts long"


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Samples of event files as they arrive."""
    reader = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), millis("ts").alias("ts_ms"), "value")


def ingest(samples: DataFrame, path: str, checkpoint: str):
    """Append to Parquet, each file once whatever fails; ends when all that is there has been read."""
    query = samples.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return query


def ordered(rows: Iterator[pd.DataFrame], *names: str) -> tuple[np.ndarray, ...]:
    """Columns of the rows of a key in order of seq; nothing else of the batches is held."""
    parts = [[f[c].to_numpy() for c in ("seq", *names)] for f in rows]
    seq, *columns = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(seq, kind="stable")
    return tuple(c[order] for c in columns)


class Seal(StatefulProcessor):
    """Keeps the open samples of a key; emits the metadata of a chunk when it is full."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk = chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "ts_ms long")
        self.sealed = handle.getValueState("sealed", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = ordered(rows, "ts_ms")[0].tolist()
        ts = [r[0] for r in self.open.get()] + new if self.open.exists() else new
        done = self.sealed.get()[0] if self.sealed.exists() else 0
        out = []
        while len(ts) >= self.chunk:
            own, ts = ts[: self.chunk], ts[self.chunk :]
            out.append((key[0], done, self.chunk, own[0], own[-1], min(own), max(own)))
            done += 1
        self.open.put([(t,) for t in ts]) if ts else self.open.clear()
        self.sealed.update((done,))
        yield pd.DataFrame(out, columns=["key", "chunk_id", "n", "first_ts", "last_ts", "min_ts", "max_ts"])

    def close(self) -> None:
        pass


class Detect(StatefulProcessor):
    """H13 as a stream: misses in a row of a node, and whether it is live."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "misses long, live boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        misses, live = self.state.get() if self.state.exists() else (0, True)
        out = []
        for seq, ok in zip(*(c.tolist() for c in ordered(rows, "seq", "ok"))):
            misses = 0 if ok else misses + 1
            if ok and not live:
                live = True
                out.append((key[0], int(seq), "recover"))
            elif misses == 2 and live:
                live = False
                out.append((key[0], int(seq), "evict"))
        self.state.update((misses, live))
        yield pd.DataFrame(out, columns=["node", "seq", "event"]).astype({"node": "int64", "seq": "int64", "event": "object"})

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "None")


def seal_chunks(samples: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return stateful(samples, "key", Seal(chunk), META)


def detect_failures(log: DataFrame) -> DataFrame:
    """log: node LONG, seq LONG, ok BOOLEAN."""
    return stateful(log, "node", Detect(), "node long, seq long, event string")
