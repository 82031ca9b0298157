"""Operator 4, token counts: a digest cache.

The digest of a text's normalised content (null is the empty text; nothing else may be changed, as every character
counts) and the digest of the tokenizer file are joined to stored counts. Only distinct misses are encoded; their
counts are appended to the cache.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are each returned with the same count;
long texts are encoded whole; an empty table gives an empty result and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.bpe import CHUNK
from tidewake.llm.common import cut, look_up, map_texts, text_or_empty
from tidewake.sources.shared import shared_path

CACHE = "version string, digest binary, n_tokens long"
LIMIT = 1024
MEMO_CHUNKS = 300_000


def tokenizer_path(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.json")


def version(path: str | None) -> str:
    with open(tokenizer_path(path), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256))


class Counter:
    """Token counts of whole texts by a byte-level tokenizers file. The library encodes each distinct chunk once; the
    chunks end where its pre-tokenizer and its special strings always end a piece, so their counts add up."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(path))
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        # A text that holds a special string goes to the library as a whole.
        chunks = [[t] if any(x in t for x in self.special) else CHUNK.findall(t) for t in texts]
        all_chunks = set().union(*chunks)
        new = list(all_chunks.difference(self.memo))
        if len(self.memo) + len(new) > MEMO_CHUNKS:
            self.memo = {k: self.memo[k] for k in all_chunks if k in self.memo}
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            self.memo.update(zip(part, map(len, self.library.encode_batch_fast(part, add_special_tokens=False))))
        out = [sum(map(self.memo.__getitem__, own)) for own in chunks]
        for c in [c for c in new if len(c) > 200]:
            del self.memo[c]
        return out


_loaded: dict[str | None, Counter] = {}


def encode_misses(misses: DataFrame, path: str | None) -> DataFrame:
    """digest, n_tokens of rows (digest, text)."""

    def make():
        if path not in _loaded:
            _loaded[path] = Counter(path)
        counter = _loaded[path]
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.count(batch.column(1).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return map_texts(misses, "text", "digest binary, n_tokens long", make)


def read_cache(spark: SparkSession, cache: str, of: str) -> DataFrame:
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.filter(F.col("version") == of).select("digest", "n_tokens")


def count_tokens(df: DataFrame, cache: str, path: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: key, n_bytes, n_tokens, over_limit. cache: a Parquet folder all executors see, made if absent."""
    spark, of = df.sparkSession, version(path)
    with_digest = df.select(key, text_or_empty(text).alias("text")).withColumn("digest", content_digest())
    distinct = with_digest.select("digest", "text").dropDuplicates(["digest"])
    misses = distinct.join(read_cache(spark, cache, of), "digest", "left_anti")
    encode_misses(misses, path).select(F.lit(of).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # Two runs at a time may both append a digest: one row of it is enough.
    counts = read_cache(spark, cache, of).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    sized = cut(with_digest.select(key, "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    return look_up(sized, counts, "digest").select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own each time, so that every distinct text of the table is encoded."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_path(spark, "token-cache"))
