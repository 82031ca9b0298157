"""Lossless chunks of delta-of-delta timestamps and XORed doubles.

A chunk is [count u32][bytes of the time stream u32][time stream][value stream], little-endian lengths, streams written
from the highest bit down. The value stream depends on the order of the samples, so a chunk of up to 1,024 samples is
the unit of work: its arrays are gathered by Spark, and Arrow batches of chunks go to Python. Fields are found and packed
by array arithmetic; only whether a window is used again is decided sample by sample.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (bits of the field, prefix) by size of the delta-of-delta.
FIELDS = [(7, "10"), (9, "110"), (12, "1110"), (64, "1111")]
U = np.uint64


def pack(codes: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int]:
    """Fields of 0 to 64 bits one after the other, from the highest bit down, and how many bits they are in all."""
    codes, sizes = codes[sizes > 0], sizes[sizes > 0].astype(np.int64)
    if not len(codes):
        return b"", 0
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    word, room = (ends - sizes) >> 6, 64 - ((ends - sizes) & 63)
    over = sizes - room  # bits that go into the next word
    inside = over <= 0
    high = np.where(inside, codes << np.where(inside, -over, 0).astype(U), codes >> np.where(inside, 0, over).astype(U))
    out = np.zeros((total >> 6) + 2, dtype=U)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(high, first)
    out[word[~inside] + 1] |= codes[~inside] << (64 - over[~inside]).astype(U)
    return out.astype(">u8").tobytes()[: (total + 7) // 8], total


def time_fields(ts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and sizes of a chunk's timestamps; two fields each, the second empty unless the first is only a prefix."""
    steps = np.diff(ts.view(U), prepend=ts[:1].view(U))
    steps[0] = 0
    dod = np.diff(steps, prepend=steps[:1]).view(np.int64)
    codes, sizes = np.zeros((len(ts), 2), dtype=U), np.zeros((len(ts), 2), dtype=np.int64)
    sizes[:, 0] = 1
    todo = dod != 0
    for size, prefix in FIELDS[:-1]:
        own = todo & (dod > -(1 << size - 1)) & (dod <= 1 << size - 1)
        codes[own, 0] = U(int(prefix, 2) << size) | (dod[own].view(U) & U((1 << size) - 1))
        sizes[own, 0] = size + len(prefix)
        todo &= ~own
    size, prefix = FIELDS[-1]
    codes[todo], sizes[todo] = np.stack([np.full(todo.sum(), int(prefix, 2), dtype=U), dod[todo].view(U)], axis=1), (len(prefix), size)
    codes[0], sizes[0] = (ts[:1].view(U)[0], 0), (64, 0)
    return codes.ravel(), sizes.ravel()


def bit_length(x: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        x = x | x >> U(k)
    return np.bitwise_count(x).astype(np.int64)


def value_fields(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and sizes of a chunk's values: control bits with a new window, and the changed bits."""
    raw = values.view(U)
    x = raw.copy()
    x[1:] ^= raw[:-1]
    codes, sizes = np.zeros((len(x), 2), dtype=U), np.zeros((len(x), 2), dtype=np.int64)
    codes[0], sizes[0] = (x[0], 0), (64, 0)
    sizes[1:, 0] = 1
    at = np.flatnonzero(x[1:]) + 1
    if len(at):
        own = x[at]
        lead = np.minimum(64 - bit_length(own), 31)
        trail = np.bitwise_count((own & (~own + U(1))) - U(1)).astype(np.int64)
        windows, fresh, low, end = [], [], -1, -1
        for window in zip(lead.tolist(), trail.tolist()):
            new = low < 0 or window[0] < low or window[1] < end
            if new:
                low, end = window
            windows.append((low, end))
            fresh.append(new)
        lead, trail = np.array(windows).T
        new, width = np.array(fresh), 64 - lead - trail
        codes[at, 0] = np.where(new, 3 << 11 | lead << 6 | width & 63, 2)
        sizes[at, 0] = np.where(new, 13, 2)
        codes[at, 1], sizes[at, 1] = own >> trail.astype(U), width
    return codes.ravel(), sizes.ravel()


def encode_streams(ts: list[int] | np.ndarray, values: np.ndarray) -> tuple[tuple[bytes, int], tuple[bytes, int]]:
    """Both streams, each with its number of bits."""
    if not len(ts):
        return (b"", 0), (b"", 0)
    return pack(*time_fields(np.asarray(ts, dtype=np.int64))), pack(*value_fields(np.ascontiguousarray(values, dtype=np.float64)))


def encode(ts: list[int] | np.ndarray, values: np.ndarray) -> bytes:
    (times, _), (own, _) = encode_streams(ts, values)
    return struct.pack("<II", len(ts), len(times)) + times + own


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = format(int.from_bytes(data, "big"), f"0{8 * len(data)}b") if data else "", 0

    def read(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise ValueError("chunk is truncated")
        self.at += n
        return int(self.bits[self.at - n : self.at], 2)


def decode(chunk: bytes) -> tuple[list[int], np.ndarray]:
    """Timestamps and values; ValueError where the chunk is cut short."""
    if len(chunk) < 8:
        raise ValueError("chunk has no header")
    n, size = struct.unpack("<II", chunk[:8])
    if 8 + size > len(chunk):
        raise ValueError("chunk is truncated")
    times, own = _Bits(chunk[8 : 8 + size]), _Bits(chunk[8 + size :])
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    ts, raw, step, lead, trail = [], [], 0, 0, 0
    for i in range(n):
        if i == 0:
            ts.append(wrap(times.read(64)))
            raw.append(own.read(64))
            continue
        ones = 0
        while ones < 4 and times.read(1):
            ones += 1
        if ones:
            width = FIELDS[ones - 1][0]
            dod = times.read(width)
            step += dod - (1 << width) if dod > 1 << width - 1 else dod
        ts.append(wrap(ts[-1] + step))
        x = 0
        if own.read(1):
            if own.read(1):
                lead = own.read(5)
                width = own.read(6) or 64
                trail = 64 - lead - width
            x = own.read(64 - lead - trail) << trail
        raw.append(raw[-1] ^ x)
    return ts, np.array(raw, dtype=np.uint64).view(np.float64)


def chunk_lists(chunked: DataFrame) -> DataFrame:
    """key, chunk_id, n, first_ts, last_ts, min_ts, max_ts, ts and vs: a chunk's samples as lists, no longer than a chunk."""
    lists = chunked.groupBy("key", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("seq", "ts_ms", "value"))).alias("s"))
    t = F.col("s.ts_ms")
    return lists.select("key", "chunk_id", F.size("s").cast("long").alias("n"), t[0].alias("first_ts"), F.element_at(t, -1).alias("last_ts"), F.array_min(t).alias("min_ts"), F.array_max(t).alias("max_ts"), t.alias("ts"), F.col("s.value").alias("vs"))


def samples_of(batch: pa.RecordBatch):
    """(timestamps, values) of each chunk of a batch of chunk_lists()."""
    ts, vs = batch.column("ts"), batch.column("vs")
    times, values = ts.values.to_numpy(zero_copy_only=False), vs.values.to_numpy(zero_copy_only=False)
    for a, b in zip(ts.offsets.to_pylist(), ts.offsets.to_pylist()[1:]):
        yield times[a:b], values[a:b]


def encode_chunks(chunked: DataFrame) -> DataFrame:
    """Key, chunk_id, n, first_ts, last_ts, min_ts, max_ts, payload of samples with chunk_id."""
    return encode_lists(chunk_lists(chunked))


def encode_lists(lists: DataFrame) -> DataFrame:
    """encode_chunks() of what chunk_lists() gives."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array([encode(*own) for own in samples_of(b)], pa.binary())], names=[*b.schema.names[:7], "payload"])

    return lists.mapInArrow(run, "key string, chunk_id long, n long, first_ts long, last_ts long, min_ts long, max_ts long, payload binary")


def mismatches(chunked: DataFrame) -> DataFrame:
    """Key, chunk_id, mismatches: samples whose timestamp or value bits differ after encoding and decoding, or are missing."""

    def differing(ts: np.ndarray, vs: np.ndarray) -> int:
        back, values = decode(encode(ts, vs))
        n = min(len(ts), len(back))
        same = (ts[:n] == np.array(back[:n], dtype=np.int64)) & (vs[:n].view(U) == values[:n].view(U))
        return max(len(ts), len(back)) - int(same.sum())

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([differing(*own) for own in samples_of(b)], pa.int64())], names=["key", "chunk_id", "mismatches"])

    return chunk_lists(chunked).mapInArrow(run, "key string, chunk_id long, mismatches long")


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """Key, chunk_id, place (from 0 in the chunk), ts_ms, value."""

    def run(batches):
        for b in batches:
            for key, chunk_id, payload in zip(*[c.to_pylist() for c in b.columns]):
                ts, vs = decode(payload)
                n = len(ts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.string()), pa.array([chunk_id] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(ts, pa.int64()), pa.array(vs, pa.float64())],
                    names=["key", "chunk_id", "place", "ts_ms", "value"],
                )

    return chunks.select("key", "chunk_id", "payload").mapInArrow(run, "key string, chunk_id long, place long, ts_ms long, value double")


def decode_range(chunks: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Q4: chunks are pruned by their metadata before any is decoded."""
    own = chunks.filter((F.col("key") == key) & (F.col("max_ts") >= start) & (F.col("min_ts") <= end))
    return decode_chunks(own).filter(F.col("ts_ms").between(start, end)).select("ts_ms", "value")
