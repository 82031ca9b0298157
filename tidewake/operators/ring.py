"""A consistent-hash ring with virtual nodes.

A ring is nodes x virtual nodes positions: it is a parameter, small whatever the number of keys, and goes to the
executors inside the functions. Keys are hashed once each: callers with repeated keys pass distinct ones and join back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.hashing import ring_positions

VNODES = 256


class Ring:
    """Positions in ascending order with their nodes; where two collide, the later node added wins."""

    def __init__(self, nodes: list[str], vnodes: int = VNODES):
        self.nodes, self.vnodes = list(dict.fromkeys(nodes)), vnodes
        at: dict[int, int] = {}
        for k, node in enumerate(self.nodes):
            at.update(dict.fromkeys(ring_positions([f"{node}#{i}" for i in range(vnodes)]).tolist(), k))
        self.pos = np.array(sorted(at), dtype=np.uint64)
        self.owner_of = np.array([at[p] for p in sorted(at)], dtype=np.int64)
        # next_nodes[i]: all nodes in the order they are met clockwise from position i
        self.next_nodes: dict[int, list[int]] = {}

    def add(self, node: str) -> Ring:
        """H4: idempotent."""
        return Ring([*self.nodes, node], self.vnodes)

    def remove(self, node: str) -> Ring:
        """H5: idempotent."""
        return Ring([n for n in self.nodes if n != node], self.vnodes)

    def place(self, keys: list[str]) -> np.ndarray:
        return np.searchsorted(self.pos, ring_positions(keys), side="left") % len(self.pos)

    def owners(self, keys: list[str]) -> list[str]:
        """H6: the first position at or after the key's, from the end on to the smallest; "" on an empty ring."""
        if not len(self.pos):
            return [""] * len(keys)
        return [self.nodes[k] for k in self.owner_of[self.place(keys)]]

    def replicas(self, keys: list[str], n: int) -> list[list[str]]:
        """H7: the first n different nodes clockwise."""
        if not len(self.pos) or n <= 0:
            return [[] for _ in keys]
        out = []
        for i in self.place(keys).tolist():
            if i not in self.next_nodes:
                turn = np.concatenate([self.owner_of[i:], self.owner_of[:i]])
                _, first = np.unique(turn, return_index=True)
                self.next_nodes[i] = turn[np.sort(first)].tolist()
            out.append([self.nodes[k] for k in self.next_nodes[i][:n]])
        return out


def ring_counts(spark: SparkSession, ring: Ring) -> DataFrame:
    """H8: nodes, vnodes: how many nodes and positions the ring has; positions that collide are one."""
    return spark.range(1).select(F.lit(len(ring.nodes)).cast("long").alias("nodes"), F.lit(len(ring.pos)).cast("long").alias("vnodes"))


def with_owner(keys: DataFrame, ring: Ring, name: str = "node", key: str = "key") -> DataFrame:
    @F.pandas_udf("string")
    def owner(k: pd.Series) -> pd.Series:
        return pd.Series(ring.owners(k.tolist()))

    return keys.withColumn(name, owner(key))


def with_replicas(keys: DataFrame, ring: Ring, n: int, name: str = "replicas", key: str = "key") -> DataFrame:
    @F.pandas_udf("array<string>")
    def replicas(k: pd.Series) -> pd.Series:
        return pd.Series(ring.replicas(k.tolist(), n))

    return keys.withColumn(name, replicas(key))


def load_share(owned: DataFrame) -> DataFrame:
    """Node, keys, share of all keys."""
    counts = owned.groupBy("node").agg(F.count(F.lit(1)).alias("keys"))
    return counts.crossJoin(counts.agg(F.sum("keys").alias("total"))).select("node", "keys", (F.col("keys") / F.col("total")).alias("share"))


def remap(keys: DataFrame, before: Ring, after: Ring) -> DataFrame:
    """H9: keys, moved, and how many moved keys had their old or new owner outside what the two rings share."""
    both = with_owner(with_owner(keys, before, "old"), after, "new")
    changed = [n for n in {*before.nodes} ^ {*after.nodes}]
    moved = F.col("old") != F.col("new")
    other = moved & ~F.col("old").isin(changed) & ~F.col("new").isin(changed)
    return both.agg(F.count(F.lit(1)).alias("keys"), F.count(F.when(moved, 1)).alias("moved"), F.count(F.when(other, 1)).alias("moved_elsewhere"))


def scaling_model(keys: DataFrame, sizes: range, rate: float = 1.6e6, overhead: float = 0.03, vnodes: int = VNODES) -> DataFrame:
    """Nodes, max_share, efficiency, points_per_s; factor, by which it grew from the smallest size; against_linear,
    the factor as a part of what the number of nodes grew by."""
    out = None
    for n in sizes:
        share = load_share(with_owner(keys, Ring([f"n{i}" for i in range(n)], vnodes))).agg(F.max("share").alias("max_share"))
        row = share.select(F.lit(n).cast("long").alias("nodes"), "max_share", ((1 / F.lit(float(n))) / F.col("max_share") * (1 - overhead)).alias("efficiency"))
        out = row if out is None else out.unionByName(row)
    made = out.withColumn("points_per_s", F.col("nodes") * rate * F.col("efficiency"))
    first = made.filter(F.col("nodes") == min(sizes)).select(F.col("points_per_s").alias("base"))  # one row
    factor = F.col("points_per_s") / F.col("base")
    return made.crossJoin(F.broadcast(first)).select(*made.columns, factor.alias("factor"), (factor / (F.col("nodes") / min(sizes))).alias("against_linear"))
