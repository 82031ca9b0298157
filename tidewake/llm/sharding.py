"""Operator 1, sharding: a two-pass external shuffle.

Pass one scatters the records uniformly into buckets of about ``bucket_bytes`` by a seeded hash; pass two shuffles each
bucket by Fisher-Yates and writes it. Records are dealt to the shards in that order, so shard sizes differ by one row at
most (law ``rows``). Only one bucket is ever held in memory. Rows equal in id and text that together fill a large part
of a bucket are counted before the shuffle and scattered one by one, by their number among equals.

Defined results: a null text counts as no bytes; a null id is scattered by the text, and rows of one id by their texts;
repeated rows and ties are dealt as separate rows (they are interchangeable, so the result as a set of rows is the same
in every run); ids may be of any type that can be hashed; a row longer than a bucket has a bucket nearly of its own, and
long texts are never cut; an empty table gives an empty result; input columns named shard or slot are replaced, all
others are kept, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.llm.common import cut, own_names
from tidewake.sources.shared import shared_path

BUCKET_BYTES = 24 << 20
SEED = 20
#: Up to so many buckets (24 TB of text at the default size) what is known of each is broadcast, 16 bytes; beyond it is joined.
BROADCAST_BUCKETS = 1_000_000
#: Tasks of pass two: one a bucket up to so many; beyond, a task takes its buckets one after the other.
MAX_TASKS = 32_768
#: Equal rows are made again in spans of so many.
SPAN = 100_000


def row_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def row_weight(df: DataFrame) -> Column:
    """About the bytes of a row: texts and binaries as they are, lists and maps by their entries, eight for all else."""
    total = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            total = total + F.greatest(F.size(c), F.lit(0)) * 16
    return total


def scatter_hash(key: str, text: str, seed: int) -> Column:
    """Uniform though one id or one text may be that of many rows: both decide."""
    return F.xxhash64(F.lit(seed), F.col(key), F.col(text))


def scatter_equals(hashed: DataFrame, hot: DataFrame, h: str, seed: int) -> DataFrame:
    """hashed with a hash of its own for each row of a hot hash: equal rows are counted where they are and made again."""
    names, (n, span, i) = hashed.columns, own_names(hashed, "n", "span", "i")
    counted = hashed.join(hot, h, "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias(n))
    spans = counted.withColumn(span, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / SPAN)))).repartition(h, span)
    one = spans.withColumn(i, F.explode(F.sequence(F.col(span) * SPAN, F.least((F.col(span) + 1) * SPAN, F.col(n)) - 1)))
    own = one.withColumn(h, F.xxhash64(F.lit(seed), h, i)).select(*names)
    return hashed.join(hot, h, "left_anti").unionByName(own)


def shuffle_shards(df: DataFrame, n_shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with shard INT (0 to n_shards - 1) and slot LONG (from 0 without gaps in each shard)."""
    if n_shards < 1 or bucket_bytes < 1:
        raise ValueError("n_shards and bucket_bytes must be positive")
    df = df.drop("shard", "slot")
    h, bucket, place, n, before, size = own_names(df, "hash", "bucket", "place", "n", "before", "size")
    weight = row_weight(df)
    total = df.agg(F.sum(weight)).first()[0] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    few = F.broadcast if n_buckets <= BROADCAST_BUCKETS else lambda x: x
    hashed = df.withColumn(h, scatter_hash(key, text, seed))
    # Rows of such a hash fill a quarter of a bucket at least, so there are fewer than four of them a bucket.
    hot = hashed.groupBy(h).agg(F.sum(weight).alias(size), F.count(F.lit(1)).alias(n)).filter((F.col(size) > bucket_bytes / 4) & (F.col(n) > 1))
    hot = cut(hot.select(h), "hot-rows")
    if not hot.isEmpty():
        hashed = scatter_equals(hashed, few(hot), h, seed)
    hashed = hashed.withColumn(bucket, F.pmod(h, F.lit(n_buckets)).cast("int"))
    out = T.StructType([*hashed.schema.fields, T.StructField(place, T.LongType())])

    def fisher_yates(rows: pa.Table) -> pa.Table:
        plain = [(c, "ascending") for c in (h, key) if pa.types.is_primitive(rows.schema.field(c).type)]
        order = pc.sort_indices(rows, sort_keys=plain).to_numpy().copy()  # the same start in every attempt
        rng = np.random.Generator(np.random.PCG64([seed, rows.column(bucket)[0].as_py()]))
        rng.shuffle(order)
        return rows.take(pa.array(order)).append_column(place, pa.array(np.arange(len(order), dtype=np.int64)))

    # A partition a bucket, which adaptive execution leaves as they are; beyond MAX_TASKS several by their hash.
    dealt = hashed.repartitionById(n_buckets, F.col(bucket)) if n_buckets <= MAX_TASKS else hashed.repartition(MAX_TASKS, bucket)
    shuffled = dealt.groupBy(bucket).applyInArrow(fisher_yates, out)
    sizes = hashed.groupBy(bucket).agg(F.count(F.lit(1)).alias(n))
    offsets = sizes.select(bucket, (F.sum(n).over(Window.orderBy(bucket)) - F.col(n)).alias(before))
    at = F.col(before) + F.col(place)
    return (
        shuffled.join(few(offsets), bucket)
        .withColumns({"shard": (at % n_shards).cast("int"), "slot": F.floor(at / n_shards).cast("long")})
        .select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")
    )


def write_shards(df: DataFrame, path: str) -> DataFrame:
    """Write the result of shuffle_shards(), a folder a shard, and read it: a task writes a file for each shard, in order of slot."""
    df.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are taken from the shards as they were written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return write_shards(shuffle_shards(docs, 8), shared_path(spark, "shards")).select(
        "doc_id",
        row_size().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
