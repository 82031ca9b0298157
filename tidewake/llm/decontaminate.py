"""Operator 10, benchmark decontamination: a broadcast hash set of the normalised n-grams of the benchmark.

All on DataFrame functions. Document windows are reduced to a 64-bit hash each and looked up in the set; hits are then
compared word by word. The documents are scanned once, whatever the lengths of the windows. The set is broadcast while
its rows take at most ``BROADCAST_BYTES``; a larger one is joined by a shuffle on the hash. Hits are gathered by the text's digest, so a text that many rows share
is counted once, and null or repeated ids do no harm; rows meet the hits of their text by a lookup that spreads hot texts.

Defined results: null, empty and wordless texts have no words, no hits and the digest of the empty string; an item of
fewer than ten words is one window; equal windows of several items count for each; empty tables give empty or clean
results; long texts are scanned whole; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import cut, look_up, text_or_empty

WINDOW = 10
BROADCAST_BYTES = 64 << 20
#: Digests of texts with hits, 100 bytes each, that are broadcast.
BROADCAST_DIGESTS = 500_000
#: Everything but digits, small letters and what is not ASCII, once A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """Words of a text. lower() would also change letters outside A-Z, so it is kept to texts of ASCII alone."""
    t = text_or_empty(text)
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def n_words(text: str) -> Column:
    """Their number, without lowering anything: A-Z count as letters."""
    return F.size(F.array_remove(F.split(text_or_empty(text), BETWEEN_CASED), "")).cast("long")


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """h, n, gram, items: each distinct window with its hash, its length and the items (as strings) that hold it."""
    tokens = benchmark.select(F.col(item).cast("string").alias("item"), words(text).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    grams = tokens.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("gram"))
    return grams.groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.xxhash64("gram").alias("h"), F.size("gram").alias("n"), "gram", "items")


def covered() -> Column:
    """Positions inside any of the intervals in hits, a sorted array of structs (at, n)."""
    start = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("upto"))  # upto: the last position counted so far
    step = lambda s, x: F.struct(
        (s["total"] + F.greatest(x["at"] + x["n"] - 1 - F.greatest(s["upto"], x["at"] - 1), F.lit(0))).alias("total"),
        F.greatest(s["upto"], x["at"] + x["n"] - 1).alias("upto"),
    )
    return F.aggregate("hits", start, step, lambda s: s["total"]).cast("long")


def text_digest(text: str = "text") -> Column:
    return F.sha2(text_or_empty(text).cast("binary"), 256)


def set_bytes() -> Column:
    """Bytes of a row of benchmark_windows(), with what a hash table adds."""
    texts = lambda c: F.octet_length(F.concat_ws("", c)) + 16 * F.size(c)
    return F.sum(texts(F.col("gram")) + texts(F.col("items")) + 64)


def hits(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """digest, n_hit, n_items, items_sha256 of each distinct text that holds a window of the benchmark."""
    windows = cut(benchmark_windows(benchmark), "windows")
    by_length = {r["n"]: r["b"] for r in windows.groupBy("n").agg(set_bytes().alias("b")).collect()}  # at most ten rows
    small = sum(by_length.values()) <= BROADCAST_BYTES
    lengths = sorted(by_length) or [WINDOW]
    tokens = documents.select(text_digest(text).alias("digest"), words(text).alias("w"))
    # One row a window, hashed, looked up and compared in one generated loop; the array of words is only passed along.
    at, size = F.col("at"), F.size("w")
    own = tokens.select("digest", "w", F.posexplode("w").alias("at", "word")).filter(at <= size - lengths[0])
    if len(lengths) == 1:
        own = own.select("digest", "w", "at", F.lit(lengths[0]).alias("n"), F.xxhash64(F.slice("w", at + 1, lengths[0])).alias("h"))
    else:
        each = [F.struct(F.lit(n).alias("n"), F.when(at <= size - n, F.xxhash64(F.slice("w", at + 1, n))).alias("h")) for n in lengths]
        own = own.select("digest", "w", "at", F.explode(F.array(*each)).alias("e")).filter("e.h IS NOT NULL").select("digest", "w", "at", "e.n", "e.h")
    here = F.slice("w", at + 1, F.col("n"))
    if not small:  # the rows are shuffled then, and must not carry a whole document each
        own, here = own.select("digest", "at", "n", "h", here.alias("here")), F.col("here")
    wanted = windows.drop("n")
    # Two inequalities: an equality would become a join key and be built for every window, not for hits alone.
    found = own.join(F.broadcast(wanted) if small else wanted, "h").filter((here <= F.col("gram")) & (here >= F.col("gram"))).select("digest", "at", "n", "items")
    # A text's hits are no more than its words.
    return (
        found.groupBy("digest")
        .agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("hits"), F.collect_set("items").alias("sets"))
        .select("digest", "hits", F.sort_array(F.array_distinct(F.flatten("sets"))).alias("items"))
        .select("digest", covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    )


def scan(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    by_text = hits(documents, benchmark, text)
    counted = cut(documents.select(F.col(key), text_digest(text).alias("digest"), n_words(text).alias("n_words")), "digests")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return look_up(counted, cut(by_text, "hits"), "digest").select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of the benchmark. Rows are matched by the digest of their text; up to
    BROADCAST_DIGESTS digests of texts with hits are broadcast, so that no document is shuffled, and more are joined."""
    bad = cut(hits(documents, benchmark).select("digest"), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_DIGESTS else bad
    return documents.join(bad, text_digest() == bad["digest"], "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return scan(read("documents"), read("benchmark"))


OP10_SQL = r"""
WITH bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'p': i, 'g': array_to_string(w[i:i + n - 1], ' ')})) AS x FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n),
hit AS (SELECT dg.r, x['p'] AS p, bg.n, item FROM dg JOIN bg ON x['g'] = bg.g AND dg.n = bg.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS p FROM (SELECT DISTINCT r, p, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
