"""Operator 2, quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of hashed features: its words, its pairs of neighbouring words and its
character 3- and 5-grams. A softmax over two outputs follows; all is trained by stochastic gradient descent in numpy on
a bounded sample of labelled rows, in a task: the driver gets the model alone. As mean and output are linear, a trained model scores by one number a bucket, and
whole texts are scored by array arithmetic without a loop over words.

Defined results: null and empty texts have no feature and get the score of the output bias; equal texts get equal
scores; rows without a label are scored like any other; conflicting labels of repeated rows all count; with no usable
labelled rows every score is 0.5; long texts are learned from and scored whole, in parts that change nothing; an empty
table gives an empty result; other input columns, whatever their names, are ignored by score() and kept by keep_good().
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import cut, map_texts, slices, text_or_empty

BUCKETS = 1 << 18
GRAMS = (3, 5)
M = 0x9E3779B97F4A7C15
#: Bounds of the training sample: its rows, taken in order of a seeded hash of the id, and their bytes in all, which end
#: the sample at the first row beyond them, however long each row is.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 256 << 20
#: A longer text is kept in the sample as the counts of its buckets, which are fewer than BUCKETS.
LONG_TEXT = 64 << 10
PIECE = 1 << 20


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(n, M, np.uint64)]).cumprod(dtype=np.uint64)


_POWER = _powers(PIECE + 64)
_INVERSE = np.concatenate([np.ones(1, np.uint64), np.full(PIECE + 64, pow(M, -1, 1 << 64), np.uint64)]).cumprod(dtype=np.uint64)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(46)).astype(np.int32)  # 18 bits


def features(text: str) -> np.ndarray:
    """Buckets of all features of a whole text, repeats included; the parts it is worked on in change nothing."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le"), dtype=np.uint32)
    gaps = (codes == 32) | (codes == 10) | (codes == 9) | (codes == 13)
    if gaps.all():
        return np.zeros(0, np.int32)
    found, size = [], len(codes)
    before = np.zeros(0, np.uint64)  # the last whole word
    open_hash, open_size = np.uint64(0), 0  # the word that goes on into the part
    for start in range(0, size, PIECE):
        n = min(PIECE, size - start)
        c = codes[start : start + n + max(GRAMS) - 1].astype(np.uint64) + np.uint64(1)  # a gram may end in the next part
        prefix = np.concatenate([np.zeros(1, np.uint64), (c * _POWER[: len(c)]).cumsum(dtype=np.uint64)])
        for k in GRAMS:
            m = min(n, size - start - k + 1)
            if m > 0:
                found.append(_bucket((prefix[k : k + m] - prefix[:m]) * _INVERSE[:m], k))
        gap = gaps[start : start + n]
        edge = np.diff(np.concatenate([[1], gap.astype(np.int8), [1]]))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        word = (prefix[last] - prefix[first]) * _INVERSE[first]
        lengths = last - first
        if open_size and gap[0]:
            word = np.concatenate([[open_hash], word])
        elif open_size:
            word[:1] = word[:1] * np.uint64(pow(M, open_size, 1 << 64)) + open_hash
            lengths[0] += open_size
        open_size = 0
        if not gap[-1]:
            open_hash, open_size, word = word[-1], int(lengths[-1]), word[:-1]
        found.append(_bucket(word, 1))
        word = np.concatenate([before, word])
        found.append(_bucket(word[1:] * np.uint64(3) + word[:-1], 2))
        before = word[-1:]
    return np.concatenate(found)


@dataclass
class Model:
    bucket: np.ndarray  # what a feature adds to the difference of the two outputs
    bias: float

    def score(self, text: str) -> float:
        f = features(text)
        logit = self.bias + (float(self.bucket[f].sum(dtype=np.float64)) / len(f) if len(f) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often each occurs."""
    return np.unique(features(text), return_counts=True)


def train(texts: list[str], labels: list[int], **settings) -> Model:
    return learn([(*counted(t), int(label)) for t, label in zip(texts, labels)], **settings)


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 4, rate: float = 20.0, batch: int = 32, seed: int = 2) -> Model:
    """Stochastic gradient descent on the cross entropy of the softmax. rows: buckets, their counts, label."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    docs = [row for row in rows if len(row[0])]
    if len({d[2] for d in docs}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    epochs = max(epochs, -(-100 * batch // len(docs)))  # small samples get a hundred steps too
    steps = epochs * max(1, len(docs) // batch)
    done = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            own = [docs[k] for k in order[i : i + batch]]
            lr = np.float32(rate * (1 - 0.95 * min(1.0, done / steps)))
            done += 1
            ids = np.concatenate([d[0] for d in own])
            weight = np.concatenate([(d[1] / d[1].sum()).astype(np.float32) for d in own])[:, None]
            starts = np.cumsum([0, *[len(d[0]) for d in own[:-1]]])
            hidden = np.add.reduceat(table[ids] * weight, starts, axis=0)
            z = hidden @ output + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), [d[2] for d in own]] -= 1
            p /= len(own)
            back = p @ output.T
            output -= lr * hidden.T @ p
            bias -= lr * p.sum(axis=0)
            rows = np.repeat(np.arange(len(own)), [len(d[0]) for d in own])
            change = back[rows] * weight * lr * np.float32(len(own))
            for k in range(dim):
                table[:, k] -= np.bincount(ids, change[:, k], minlength=BUCKETS).astype(np.float32)
    side = output[:, 1] - output[:, 0]
    return Model(table @ side, float(bias[1] - bias[0]))


def fold(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3))


def first_by_hash(known: DataFrame, order: Column, rows: int) -> DataFrame:
    """The rows of known that come first in the order of a hash: ``rows`` of them and a few more (all, if there are fewer).

    How far to go is found from how many rows lie in each range of the hash, ranges that grow by a fiftieth, so that
    nothing but these counts reaches the driver, however many rows and partitions there are."""
    part = F.floor(F.log2(F.greatest(order.cast("double") + F.lit(2.0**63), F.lit(1.0))) * 35)  # under 2,300 ranges, in the order of the hash
    total, upto = 0, None
    for r in sorted(known.groupBy(part.alias("range")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["range"]):
        total, upto = total + r["n"], r["range"]
        if total >= rows:
            break
    return known if upto is None else known.filter(part <= upto)


def learn_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of a sample (label, text or else ids and counts), whose buckets are kept in a file meanwhile."""
    sizes, labels = [], []
    with tempfile.TemporaryFile() as file:
        for batch in batches:
            for part in slices(batch, "text"):
                for r in part.to_pylist():
                    ids, counts = counted(r["text"]) if r["text"] is not None else (np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32))
                    file.write(np.concatenate([ids, counts]).astype(np.int32).tobytes())
                    sizes.append(len(ids))
                    labels.append(r["label"])
        file.flush()
        stored = np.memmap(file, np.int32, "r") if any(sizes) else np.zeros(0, np.int32)
        starts = 2 * np.cumsum([0, *sizes])
        model = learn([(stored[a : a + n], stored[a + n : a + 2 * n], label) for a, n, label in zip(starts, sizes, labels)])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Learns from at most ``rows`` rows that are labelled and not held out, and SAMPLE_BYTES of them."""
    order = F.xxhash64(F.lit(7), key)
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out).select(key, F.col(label).cast("int").alias("label"))
    # Ids alone meet first, so that the bound counts rows that are there.
    there = cut(known.join(docs.select(key), key, "left_semi"), "labelled-ids")
    chosen = first_by_hash(there, order, rows).orderBy(order, "label").limit(rows)
    own = docs.select(key, text_or_empty().alias("text")).join(F.broadcast(chosen), key).orderBy(order, "label", F.md5(F.col("text").cast("binary"))).limit(rows)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            packed = [(t, None, None) if len(t) <= LONG_TEXT else (None, *(x.astype(np.int32).tobytes() for x in counted(t))) for t in texts]
            short, ids, counts = ([p[i] for p in packed] for i in range(3))
            sizes = [len(a.encode()) if a is not None else len(b) + len(c) for a, b, c in packed]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.string()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), pa.array(sizes, pa.int64())], names=["label", "text", "ids", "counts", "size"])

        return work

    sample = cut(map_texts(own.select("label", "text"), "text", "label int, text string, ids binary, counts binary, size long", make), "labelled-sample")
    place = sample.select("size", F.monotonically_increasing_id().alias("place"))  # one file, in the order above
    sizes = [r["size"] for r in place.orderBy("place").collect()]
    n = int(np.searchsorted(np.cumsum([0, *sizes]), SAMPLE_BYTES, side="right")) - 1
    if not n:
        return learn([])
    # The rows of a limit after a sort are one partition, in that order.
    first = sample.withColumn("place", F.monotonically_increasing_id()).orderBy("place").limit(n).select("label", "text", "ids", "counts")
    return pickle.loads(first.mapInArrow(learn_sample, "model binary").first()["model"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row, from the whole text and nothing else."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB

    def make():
        m = shared.value
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=[key, "score"])

    return map_texts(docs.select(key, text_or_empty(text).alias("text")), "text", f"{key} {kind}, score double", make)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without those scored under the threshold, all columns kept."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def make():
        m = shared.value
        return lambda batch: batch.filter(pa.array([m.score(t.as_py() or "") >= threshold for t in batch.column(at)], pa.bool_()))

    return map_texts(docs, "text", docs.schema, make)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold() == 1)
    return score(docs, model).select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
