"""Operator 8, SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets a nonzero vector of four bits; table v (1 to 15) compares the bits whose vector has an odd
product with v. Three differing bits span at most three dimensions, so some v is orthogonal to all of them, and that
table holds the pair in one bucket: no pair within the radius is missed. Buckets of more than ``HOT`` fingerprints are
split again by the same construction on the bits they have not compared, and a third time; then at most 2**10
fingerprints share a bucket. Inside a bucket only a spanning set of the links is kept, never all pairs.

``one_of_similar`` finds near copies by a similarity instead: the fingerprint has 128 bits, over the
distinct five-word shingles, and links at 19 or fewer differing bits, which is where it estimates a Jaccard similarity of 0.8
(bits differ at the angle whose cosine is 2J / (1 + J), over pi). One of its four quarters then differs in at most four
bits, and 31 masks of each quarter miss none of these: 124 tables. A bucket of up to ``WIDE_HOT``
fingerprints (rows of 32 bytes) is compared in one task; larger ones are split once more as above, and what then still shares a
bucket agrees on most of a quarter: copies of one text mostly, whose comparison is linear, since each linked one leaves.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; repeated rows share a
fingerprint and a component; component_id is the smallest id of the component that is not null, or null; an empty
table gives an empty result; long texts are hashed whole; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import cut, look_up, map_texts, own_names, text_or_empty
from tidewake.llm.graph import components

RADIUS, WORDS, HOT = 3, 3, 1024


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()  # of bytes: A-Z, and space with \t to \r, only
    if not words:
        return 0
    parts = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= WORDS else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp, the fingerprint as a signed LONG."""
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    return map_texts(df.select(key, text_or_empty(text).alias("text")), "text", f"{key} {kind}, fp long", lambda: work)


def covering(bits: list[int], radius: int = RADIUS) -> list[int]:
    """2**(radius + 1) - 1 masks over the given bit positions; bits that differ in at most radius of these are outside some mask."""
    n = (2 << radius) - 1
    vector = {b: 1 + i % n for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, n + 1)]


def masks(level: int) -> list[tuple[int, int, int]]:
    """(parent table, table, all bits compared) of a level; the parent of level 1 is 0."""
    rows, parents = [], [(0, 0)]
    for _ in range(level):
        rows = [(p, p * 16 + i + 1, done | m) for p, done in parents for i, m in enumerate(covering([b for b in range(64) if not done >> b & 1]))]
        parents = [(t, done) for _, t, done in rows]
    return rows


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For each bucket's list of fingerprints: links that connect exactly what is connected within the radius."""
    left, right = [], []
    for own in batch.column(0):
        x = own.values.to_numpy(zero_copy_only=False).view(np.uint64)
        todo = np.ones(len(x), dtype=bool)
        while todo.any():
            root = int(np.argmax(todo))
            todo[root] = False
            wave = [root]
            while wave and todo.any():
                at = wave.pop()
                near = np.flatnonzero(todo & (np.bitwise_count(x ^ x[at]) <= RADIUS))
                todo[near] = False
                wave += near.tolist()
                left.append(np.full(len(near), x[at]))
                right.append(x[near])
    join = lambda parts: pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([join(left), join(right)], names=["a", "b"])


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: links that connect the distinct fingerprints (column fp) exactly as all pairs within the radius do."""
    spark = distinct.sparkSession
    level1 = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for _, t, m in masks(1)])).alias("e")
    rows, out = distinct.select("fp", level1).select("fp", "e.t", "e.k"), None
    for level in (1, 2, 3):
        counted = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        counted = cut(counted.filter("n > 1"), "buckets")
        pairs = counted.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
        members = rows.join(counted.filter("n > 2").select("t", "k", "n"), ["t", "k"])
        small = members if level == 3 else members.filter(F.col("n") <= hot)
        lists = small.groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("fps")
        found = pairs.unionByName(lists.mapInArrow(lambda batches: map(spanning_links, batches), "a long, b long"))
        out = found if out is None else out.unionByName(found)
        if level == 3 or counted.filter(F.col("n") > hot).isEmpty():
            return out
        # The masks are a fixed table: 225 rows, then 3,375.
        finer = spark.createDataFrame([(p, t, signed(m)) for p, t, m in masks(level + 1)], "p int, t int, m long")
        rows = members.filter(F.col("n") > hot).select("fp", F.col("t").alias("p")).distinct().join(F.broadcast(finer), "p").select("fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("k"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, fingerprint (16 hex digits), component_id."""
    docs = cut(fingerprints(df, key, text), "fingerprints")
    distinct = cut(docs.groupBy("fp").agg(F.min(key).alias("least")), "fingerprint-ids")
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return docs.join(named, "fp", "left").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest id, and of equal ids the first row.

    Rows are told apart by numbers that are written with them once, so that null and repeated ids do no harm."""
    (row,) = own_names(docs, "row")
    keyed = cut(docs.withColumn(row, F.struct(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"))), "numbered-rows")
    best = near_duplicates(keyed.select(row, "text"), row).select("component_id").distinct()
    return keyed.join(best, F.col(f"{row}.row") == F.col("component_id.row"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


#: Near copies: words of a shingle, differing bits of 128 that link, bits of a quarter that may differ.
SIMILAR_WORDS, SIMILAR_RADIUS, QUARTER_RADIUS, WIDE_HOT = 5, 19, 4, 1 << 16


def wide_fingerprint(text: str) -> bytes:
    words = text.encode().lower().split()
    if not words:
        return bytes(16)
    shingles = list(set(map(b" ".join, zip(*(words[i:] for i in range(SIMILAR_WORDS)))))) or [b" ".join(words)]
    ones = np.zeros(128, dtype=np.int64)
    for i in range(0, len(shingles), 8192):
        digests = b"".join(map(xxhash.xxh128_digest, shingles[i : i + 8192]))
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(shingles)).tobytes()


def wide_fingerprints(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, f1, f2: the halves of the wide fingerprint as signed LONGs."""
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        halves = np.frombuffer(b"".join(map(wide_fingerprint, batch.column(1).to_pylist())), ">i8").astype(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=[key, "f1", "f2"])

    return map_texts(df.select(key, text_or_empty(text).alias("text")), "text", f"{key} {kind}, f1 long, f2 long", lambda: work)


def quarter_masks(level: int) -> list[tuple[int, int, int, int]]:
    """(parent table, table, quarter, bits of the quarter that are compared) of a level; the parents of level 1 are the quarters."""
    tables = [(0, q, q, 0) for q in range(4)]
    for _ in range(level):
        tables = [(t, t * 31 + i, q, done | m) for _, t, q, done in tables for i, m in enumerate(covering([b for b in range(32) if not done >> b & 1], QUARTER_RADIUS))]
    return tables


def similar_pairs(f: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f[0][left] ^ f[0][right]) + np.bitwise_count(f[1][left] ^ f[1][right]) <= SIMILAR_RADIUS


def links_in_buckets(k: np.ndarray, f: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): nodes to link, so that inside each run of equal k exactly what the radius connects is connected; rows
    of one node are already."""
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(k)])
    after = np.repeat(starts + sizes, sizes) - np.arange(len(k)) - 1  # members of the bucket behind each
    at = np.flatnonzero((after > 0) & (np.repeat(sizes, sizes) <= 256))
    found_left, found_right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, 256):
        at = at[after[at] >= step]
        if not len(at):
            break
        near = at[similar_pairs(f, at, at + step) & (node[at] != node[at + step])]
        found_left.append(near)
        found_right.append(near + step)
    left, right = np.concatenate(found_left), np.concatenate(found_right)
    # A link is left out where both ends are linked to the same first member, which comes before them.
    first = np.full(len(k), len(k))
    np.minimum.at(first, right, left)
    keep = (first[right] == left) | (first[left] != first[right])
    found_left, found_right = [left[keep]], [right[keep]]
    for start, size in zip(starts[sizes > 256].tolist(), sizes[sizes > 256].tolist()):
        todo, x, y = np.arange(start, start + size), f[0][start : start + size], f[1][start : start + size]
        wave: list[int] = []
        while len(todo):
            root = heappop(wave) if wave else int(todo[0])
            near = np.bitwise_count(x ^ f[0][root]) + np.bitwise_count(y ^ f[1][root]) <= SIMILAR_RADIUS
            if near.any():
                hit = todo[near]
                todo, x, y = todo[~near], x[~near], y[~near]
                hit = hit[hit != root]
                for i in hit.tolist():
                    heappush(wave, i)
                found_left.append(np.full(len(hit), root))
                found_right.append(hit)
    left, right = node[np.concatenate(found_left)], node[np.concatenate(found_right)]
    return left[left != right], right[left != right]


def links_of_sorted(batches: Iterator[pa.RecordBatch], hot: int | None) -> Iterator[pa.RecordBatch]:
    """Of rows k, f1, f2, node sorted by k and node: the links a, b of each bucket, and the key of each bucket of more than
    hot rows, which is not held. A bucket may span batches. Links lead to the first members of a bucket where they can,
    so that different tables find the same ones."""
    held: list[np.ndarray] = []
    passed = None
    for batch in chain(batches, [None]):
        over: list[int] = []
        if batch is not None:
            new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            new = new if passed is None else new[:, new[0] != passed]
            if not new.shape[1]:
                continue
            held.append(new)
            last = int(new[0, -1])
            if held[0][0, 0] == last and (hot is None or sum(x.shape[1] for x in held) <= hot):
                continue
            rows = np.concatenate(held, axis=1)
            end = int(np.searchsorted(rows[0], last))
            held, rows = [rows[:, end:]], rows[:, :end]
            if hot is not None and held[0].shape[1] > hot:
                passed, held = last, []
                over.append(last)
        else:
            rows = np.concatenate([np.zeros((4, 0), np.int64), *held], axis=1)
        keys, sizes = np.unique(rows[0], return_counts=True)
        large = sizes > hot if hot is not None else np.zeros(len(keys), bool)
        over += keys[large].tolist()
        rows = rows[:, ~np.repeat(large, sizes)]
        left, right = links_in_buckets(rows[0], rows[1:3].view(np.uint64), rows[3])
        none = pa.nulls(len(over), pa.int64())
        columns = [pa.array([None] * len(left) + over, pa.int64()), *(pa.concat_arrays([pa.array(x), none]) for x in (left, right))]
        yield pa.RecordBatch.from_arrays(columns, names=["hot", "a", "b"])


def similar_classes(distinct: DataFrame, hot: int = WIDE_HOT) -> DataFrame:
    """node, root: what links of all pairs within the radius connect of the distinct wide fingerprints (f1, f2, node LONG).

    Two tables a quarter come first. What they connect is one node for the others, which so find few links more even in a
    large group of near copies."""
    quarters = [F.shiftrightunsigned("f1", 32), F.col("f1"), F.shiftrightunsigned("f2", 32), F.col("f2")]
    tables = [(t, quarters[q].bitwiseAND(F.lit(m).cast("long")).bitwiseOR(F.lit(t << 32).cast("long"))) for _, t, q, m in quarter_masks(1)]

    def dealt(prints: DataFrame, keys: list) -> DataFrame:
        return prints.select("f1", "f2", "root", F.explode(F.array(*keys)).alias("k")).select("k", "f1", "f2", "root")

    def found(rows: DataFrame, most: int | None) -> DataFrame:
        links = rows.repartition("k").sortWithinPartitions("k", "root").mapInArrow(lambda batches: links_of_sorted(batches, most), "hot long, a long, b long")
        return cut(links.distinct(), "similar")

    early = [key for t, key in tables if t % 31 < 2]
    first = found(dealt(distinct.withColumn("root", F.col("node")), early), hot)
    prints = cut(distinct.join(components(first.filter("hot IS NULL").select("a", "b")), "node", "left").withColumn("root", F.coalesce("root", "node")), "first-classes")
    rest = found(dealt(prints, [key for t, key in tables if t % 31 >= 2]), hot)
    links, hot_keys = rest.filter("hot IS NULL").select("a", "b"), first.unionByName(rest).filter("hot IS NOT NULL").select(F.col("hot").alias("k"))
    if not hot_keys.isEmpty():
        # The masks are a fixed table of 3,844 rows.
        finer = distinct.sparkSession.createDataFrame(quarter_masks(2), "p long, t long, q int, m long")
        members = dealt(prints, [key for _, key in tables]).join(hot_keys, "k", "left_semi").select("f1", "f2", "root", F.shiftright("k", 32).alias("p"))
        quarter = F.when(F.col("q") == 0, quarters[0]).when(F.col("q") == 1, quarters[1]).when(F.col("q") == 2, quarters[2]).otherwise(quarters[3])
        rows = members.join(F.broadcast(finer), "p").select(quarter.bitwiseAND(F.col("m")).bitwiseOR(F.shiftleft("t", 32)).alias("k"), "f1", "f2", "root")
        links = links.unionByName(found(rows, None).select("a", "b"))
    more = components(links).select(F.col("node").alias("root"), F.col("root").alias("last"))
    return look_up(prints.select("node", "root"), more, "root").select("node", F.coalesce("last", "root").alias("root"))


def one_of_similar(docs: DataFrame, hot: int = WIDE_HOT) -> DataFrame:
    """docs with one row of each group of near copies (five-word shingles, an estimated similarity of 0.8 or more, and what
    such links connect): that of the smallest id, and of equal ids the first row. Odd rows are as in one_of_each."""
    (row,) = own_names(docs, "row")
    keyed = cut(docs.withColumn(row, F.struct(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"))), "numbered-rows")
    prints = wide_fingerprints(keyed.select(row, "text"), row)
    distinct = cut(prints.groupBy("f1", "f2").agg(F.min(row).alias("least")).withColumn("node", F.monotonically_increasing_id()), "fingerprint-ids")
    classes = similar_classes(distinct.select("f1", "f2", "node"), hot)
    best = distinct.join(classes, "node").groupBy("root").agg(F.min("least").alias("best")).select("best.row")
    return keyed.join(best, F.col(f"{row}.row") == best["row"], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
