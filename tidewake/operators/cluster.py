"""Replicated writes, failover reads, cluster totals, failure detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions.text import conf_or
from tidewake.operators.chunks import SPAN
from tidewake.operators.ring import Ring, with_replicas


def replication(spark: SparkSession) -> int:
    """Tidewake.replicas of the session, 2 where it is unset or empty."""
    return int(conf_or(spark, "tidewake.replicas", "2"))


def fan_out(samples: DataFrame, nodes: list[str], replicas: int) -> DataFrame:
    """Samples once for each replica, with node and copy (0 is the primary). Distinct keys are hashed once."""
    sets = with_replicas(samples.select("key").distinct(), Ring(nodes), replicas)
    return samples.join(sets, "key").select(*samples.columns, F.posexplode("replicas").alias("copy", "node"))


def cluster_totals(copies: DataFrame, live: list[str] | None = None) -> DataFrame:
    """Per live node (all, if none are named), series and samples; their sums count every replica, as the store
    described does."""
    own = copies if live is None else copies.filter(F.col("node").isin(live)) if live else copies.filter(F.lit(False))
    return own.groupBy("node").agg(F.count_distinct("key").alias("series"), F.count(F.lit(1)).alias("samples"))


def cluster_health(copies: DataFrame, live: list[str]) -> DataFrame:
    """One row with live, the number of live nodes, and the sums over them; live nodes without samples count."""
    sums = cluster_totals(copies, live).agg(F.coalesce(F.sum("series"), F.lit(0)).alias("series"), F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"))
    return sums.select(F.lit(len(set(live))).cast("long").alias("live"), "series", "samples")


def failover(keys: DataFrame, nodes: list[str], replicas: int, live: list[str]) -> DataFrame:
    """Key and the first live node of its replica set, null where none lives."""
    sets = with_replicas(keys, Ring(nodes), replicas)
    return sets.select("key", F.element_at(F.filter("replicas", lambda n: n.isin(live) if live else F.lit(False)), 1).alias("node") if live else F.lit(None).cast("string").alias("node"))


def require_live(read: DataFrame) -> DataFrame:
    """Fails where a key has no live replica."""
    return read.withColumn("node", F.coalesce("node", F.raise_error(F.concat(F.lit("UNAVAILABLE: "), "key")).cast("string")))


def transitions(log: DataFrame, span: int = SPAN) -> DataFrame:
    """Evictions (the second miss in a row of a live node) and recoveries (the first answer after one), from a
    log of probes (node, seq, ok BOOLEAN).

    Spans of seq are summed up first: whether a node answered in the span, and its misses after the last answer. The
    sums, one row a span, tell how many misses in a row lie before each span; inside a span, an answer opens a run, and
    the misses after it belong to it. No task sorts the whole log of a node, however long it is."""
    part = F.floor(F.col("seq") / span)
    last_ok = F.max(F.when(F.col("ok"), F.col("seq")))
    per = log.groupBy("node", part.alias("span")).agg(last_ok.alias("last_ok"))
    tails = log.withColumn("span", part).join(per, ["node", "span"]).groupBy("node", "span").agg(
        F.max(F.col("last_ok").isNotNull().cast("int")).alias("answered"), F.count(F.when(F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok")), 1)).alias("tail")
    )
    by_span = Window.partitionBy("node").orderBy("span")
    since = Window.partitionBy("node", "group").orderBy("span")
    summed = tails.withColumn("group", F.sum("answered").over(by_span)).withColumn("misses", F.sum("tail").over(since))
    carried = summed.select("node", "span", F.coalesce(F.lag("misses").over(by_span), F.lit(0)).alias("carried"))
    by = Window.partitionBy("node", "span").orderBy("seq")
    runs = log.withColumn("span", part).join(carried, ["node", "span"]).withColumn("run", F.sum(F.col("ok").cast("int")).over(by))
    place = F.row_number().over(Window.partitionBy("node", "span", "run").orderBy("seq"))
    misses = F.when(F.col("ok"), 0).otherwise(F.when(F.col("run") > 0, place - 1).otherwise(place + F.col("carried")))
    counted = runs.withColumn("misses", misses).withColumn("before", F.coalesce(F.lag("misses").over(by), F.col("carried")))
    event = F.when(~F.col("ok") & (F.col("misses") == 2), "evict").when(F.col("ok") & (F.col("before") >= 2), "recover")
    return counted.select("node", "seq", event.alias("event")).filter("event IS NOT NULL")
