"""H1 to H3: ring positions, vectorised in numpy over Arrow batches. Spark has no unsigned type: positions are DECIMAL(20,0)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Offset basis, prime and mixing constants of the ring hash.
BASIS, PRIME = 1469598103934665603, 1099511628211
GOLDEN, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def fnv1a(strings: list[str]) -> np.ndarray:
    raw = [s.encode() for s in strings]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(raw) + b"\0", dtype=np.uint8)
    h = np.full(len(raw), BASIS, dtype=np.uint64)
    for i in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > i)
        h[live] = (h[live] ^ data[start[live] + i]) * np.uint64(PRIME)
    return h


def mix64(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def ring_positions(strings: list[str]) -> np.ndarray:
    return mix64(fnv1a(strings))


@F.pandas_udf(T.LongType())
def signed_position(keys: pd.Series) -> pd.Series:
    """The bits of a ring position as a signed integer."""
    own = keys[keys.notna()]
    return pd.Series(ring_positions(own.tolist()).view(np.int64), index=own.index, dtype="Int64").reindex(keys.index)


def ring_hash(keys: Column | str) -> Column:
    """The ring position as DECIMAL(20,0); Spark makes it unsigned."""
    signed = signed_position(keys)
    wide = signed.cast("decimal(20,0)")
    return F.when(signed < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


@F.pandas_udf(T.LongType())
def double_bits(values: pd.Series) -> pd.Series:
    """The bit pattern of a double as a signed integer."""
    return pd.Series(values.to_numpy(dtype=np.float64).view(np.int64))
