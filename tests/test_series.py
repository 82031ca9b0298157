"""Golden values and edge cases of ranges, chunks, codec, ring, cluster, statistics and workload."""

import math
import random
import struct

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.functions.hashing import fnv1a, mix64, ring_positions
from tidewake.operators import chunks, cluster, codec, ranges, ring, stats
from tidewake.sources import tables, workload


def samples(spark, rows):
    return spark.createDataFrame(rows, tables.SAMPLES)


def bits(x):
    return np.asarray(x, dtype=np.float64).view(np.uint64).tolist()


GOLDEN = [
    ([1700000000000], [3.14159], "01000000080000000000018bcfe56800400921f9f01b866e"),
    ([1000, 2000, 3000], [42.0] * 3, "030000000b00000000000000000003e8e3e800404500000000000000"),
    (list(range(1, 8)), [0.0, -0.0, math.inf, -math.inf, 1e308, 1e-308, 123456.789],
     "070000000a000000000000000000000180800000000000000000c00f019fff40060ee004733ce17af22e1fbff37e12fef91039c3fc0f914dae7a79e1b0"),
]


@pytest.mark.parametrize("ts,vs,want", GOLDEN)
def test_codec_golden(ts, vs, want):
    assert codec.encode(ts, np.array(vs)).hex() == want
    back, values = codec.decode(bytes.fromhex(want))
    assert back == ts and bits(values) == bits(vs)


def test_codec_bucket_edges_and_sizes():
    ts, step = [0, 0], 0
    for dod in (64, -63, 256, -255, 2048, -2047, 65, -64, 257, -256, 2049):
        step += dod
        ts.append(ts[-1] + step)
    (_, bits_of_times), _ = codec.encode_streams(ts, np.ones(len(ts)))
    assert bits_of_times == 64 + 1 + 9 + 9 + 12 + 12 + 16 + 16 + 12 + 12 + 16 + 16 + 68
    assert codec.decode(codec.encode(ts, np.ones(len(ts))))[0] == ts
    edges = codec.encode(ts[1:], np.ones(len(ts) - 1))
    assert codec.decode(edges)[0] == ts[1:]
    flat = codec.encode([10000 * (i + 1) for i in range(1000)], np.full(1000, 7.0))
    assert len(flat) == 283


def test_codec_empty_truncated_nan():
    assert codec.encode([], np.array([])).hex() == "0000000000000000"
    assert codec.decode(bytes(8))[0] == []
    whole = codec.encode([1, 2, 900], np.array([math.nan, 1.0, math.nan]))
    assert bits(codec.decode(whole)[1]) == bits([math.nan, 1.0, math.nan])
    for n in (0, 7, 12, len(whole) - 4):
        with pytest.raises(ValueError):
            codec.decode(whole[:n])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(1 << 63), (1 << 63) - 1), st.floats(width=64)), max_size=60))
def test_codec_round_trip(rows):
    ts, vs = [r[0] for r in rows], [r[1] for r in rows]
    back, values = codec.decode(codec.encode(ts, np.array(vs, dtype=np.float64)))
    assert back == ts and bits(values) == bits(vs)


def test_ring_golden():
    assert fnv1a(["", "a", "n0#0"]).tolist() == [1469598103934665603, 4953267810257967366, 14911110585864728998]
    assert ring_positions(["", "a", "n0#0", "series-0"]).tolist() == [5665620140241705579, 5667979809800783955, 11668796739867357707, 643246200509904824]
    assert int(mix64(np.array([5], dtype=np.uint64))[0]) == 7134611160154358618
    r = ring.Ring(["n0", "n1", "n2"])
    assert r.replicas(["series-0", "series-1", "series-2", "cpu.usage{host=h0,inst=0}", "click"], 2) == [["n0", "n2"], ["n2", "n1"], ["n0", "n2"], ["n1", "n2"], ["n1", "n0"]]
    assert r.replicas(["x"], 9)[0][0] == r.owners(["x"])[0] and len(r.replicas(["x"], 9)[0]) == 3
    assert ring.Ring([]).owners(["x"]) == [""] and r.replicas(["x"], 0) == [[]]
    assert r.add("n0").nodes == r.nodes and r.remove("zz").nodes == r.nodes


def test_ring_balance_and_remap():
    keys = [f"series-{i}" for i in range(100_000)]
    eight = ring.Ring([f"n{i}" for i in range(8)], 200)
    old = np.array(eight.owners(keys))
    assert np.unique(old, return_counts=True)[1].max() / (len(keys) / 8) == pytest.approx(1.054, abs=1e-3)
    new = np.array(eight.add("n8").owners(keys))
    assert (old != new).mean() == pytest.approx(0.10282) and set(new[old != new]) == {"n8"}
    gone = np.array(eight.remove("n3").owners(keys))
    assert set(old[old != gone]) == {"n3"}


def test_scaling_model(spark):
    keys = spark.range(200_000).select(F.concat(F.lit("series-"), F.col("id").cast("string")).alias("key"))
    rows = {r["nodes"]: r for r in ring.scaling_model(keys, range(3, 9, 5)).collect()}
    assert round(rows[3]["points_per_s"]) == 4487884 and round(rows[8]["points_per_s"]) == 11396681


def test_ranges_inclusive_duplicates_empty(spark):
    s = samples(spark, [("s", i, (i + 1) * 1000, float(i)) for i in range(3000)] + [("s", 5000, 2000, 9.0)])
    assert ranges.range_raw(s, "s", 1000, 3000, ordered=True).collect() == [(1000, 0.0), (2000, 1.0), (3000, 2.0), (2000, 9.0)]
    for agg in ranges.AGGREGATIONS[1:]:
        assert ranges.range_query(s, "missing", 0, 9, agg).first() == (0.0, 0)
        assert ranges.range_by_code(s, "s", 9, 0, ranges.AGGREGATIONS.index(agg)).first() == (0.0, 0)
    with pytest.raises(ValueError):
        ranges.range_query(s, "s", 0, 1, "median")
    i = ranges.index_bounds(samples(spark, [("t", k, k * 10, 0.0) for k in range(1000)]), 105, 100).first()
    assert (i["lower"], i["upper"]) == (11, 11)


def test_nan_never_wins_min_max(spark):
    s = samples(spark, [("a", 0, 0, math.nan), ("a", 1, 1, 2.0), ("b", 0, 0, math.nan)])
    assert ranges.range_query(s, "a", 0, 9, "min").first()[0] == 2.0 and ranges.range_query(s, "a", 0, 9, "max").first()[0] == 2.0
    assert ranges.range_query(s, "b", 0, 9, "min").first()[0] == math.inf and ranges.range_query(s, "b", 0, 9, "max").first()[0] == -math.inf


def test_chunks_do_not_depend_on_span(spark):
    s = samples(spark, [("k", i, (i + 1) * 10, float(i)) for i in range(2600)] + [("l", i * 7, i, 0.0) for i in range(30)])
    meta = sorted(tuple(r) for r in chunks.chunk_meta(chunks.assign_chunks(s, span=100)).collect())
    assert meta == sorted(tuple(r) for r in chunks.chunk_meta(chunks.assign_chunks(s)).collect())
    assert [m[2] for m in meta if m[0] == "k"] == [1024, 1024, 552]
    own = codec.encode_chunks(chunks.assign_chunks(s))
    assert codec.decode_range(own, "k", 10230, 10260).count() == 4


def test_leading_and_trailing_zeros(spark):
    s = samples(spark, [("k", 0, 0, 0.0), ("k", 1, 1, -0.0), ("k", 2, 2, -0.0), ("k", 3, 3, 1.0)])
    rows = [(r["lead"], r["trail"]) for r in chunks.xor_values(chunks.assign_chunks(s)).orderBy("seq").collect()]
    x = bits([-0.0])[0] ^ bits([1.0])[0]
    assert rows == [(None, None), (0, 63), (None, None), (min(64 - x.bit_length(), 31), (x & -x).bit_length() - 1)]


def test_percentile_is_nearest_rank_by_floor(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    assert dict(map(tuple, stats.percentiles(df, "x", [0, 50, 95, 100]).collect())) == {0.0: 0.0, 50.0: 50.0, 95.0: 95.0, 100.0: 99.0}
    rng = random.Random(1)
    xs = [rng.choice([-3.5, 0.0, 7.25, rng.uniform(-1e6, 1e6)]) for _ in range(777)]
    want = sorted(xs)[min(776, math.floor(0.9 * 777))]
    assert stats.percentiles(spark.createDataFrame([(x,) for x in xs], "x double"), "x", [90]).first()["value"] == want


def test_failover(spark):
    keys = spark.createDataFrame([("series-0",), ("series-1",)], "key string")
    assert dict(map(tuple, cluster.failover(keys, ["n0", "n1", "n2"], 2, ["n2"]).collect())) == {"series-0": "n2", "series-1": "n2"}
    assert {r["node"] for r in cluster.failover(keys, ["n0", "n1", "n2"], 2, []).collect()} == {None}
    with pytest.raises(Exception, match="UNAVAILABLE"):
        cluster.require_live(cluster.failover(keys, ["n0"], 1, [])).collect()


def test_detector_by_hand(spark):
    oks = [False, False, False, True, False, True, False, False, True]
    log = spark.createDataFrame([(0, i, ok) for i, ok in enumerate(oks)], "node long, seq long, ok boolean")
    assert sorted((r["seq"], r["event"]) for r in cluster.transitions(log).collect()) == [(1, "evict"), (3, "recover"), (7, "evict"), (8, "recover")]


def test_workload_kinds(spark):
    own = spark.createDataFrame([(i,) for i in (49, 50, 79, 80, 100)], "i long").select(workload.metric_kind(F.col("i")).alias("k"))
    assert [r["k"] for r in own.collect()] == ["flat", "counter", "counter", "wander", "flat"]
    keys = spark.range(5).select(workload.series_key(F.col("id")).alias("k"))
    assert [r["k"] for r in keys.collect()] == ["cpu.usage{host=h0,inst=0}", "mem.used{host=h0,inst=1}", "net.rx{host=h0,inst=2}", "disk.io{host=h0,inst=3}", "http.reqs{host=h0,inst=4}"]


def draw(number, i, s):
    """What the workload draws, from the public hash function: 32-bit constants, then 64-bit numbers, each seeding the next."""
    h = 42
    for raw in (struct.pack("<i", workload.SEED), struct.pack("<i", number), struct.pack("<q", i), struct.pack("<q", s)):
        h = xxhash.xxh64_intdigest(raw, h)
    h -= (h >> 63) << 64
    return h % (1 << 30) / (1 << 30)


def test_workload_by_hand(spark):
    made = {}
    for r in workload.generate(spark, 6, 400, first=47).unionByName(workload.generate(spark, 3, 400, first=79)).orderBy("seq").collect():
        made.setdefault(int(r["key"].split("inst=")[1][:-1]), []).append((r["ts_ms"], r["value"]))
    assert sorted(made) == [47, 48, 49, 50, 51, 52, 79, 80, 81]
    jitters = 0
    for i, rows in made.items():
        ts, want = workload.START_MS, []
        value = 0.75 if i >= 80 else 1000.0
        for s in range(400):
            jitter = math.floor(draw(2, i, s) * 3) - 1 if draw(1, i, s) < 1 / 200 else 0
            jitters += jitter != 0
            ts += workload.STEP_MS + jitter
            if i < 50:
                value = float(math.floor(draw(4, i, s) * 100)) if s == 0 or draw(3, i, s) >= 0.85 else value
            elif i < 80:
                value += 2
            else:
                u = draw(5, i, s)
                value = max(0.0, round(value + (-0.01 if u < 1 / 3 else 0.0 if u < 2 / 3 else 0.01), 2))
            want.append((ts, value))
        assert rows == want
    assert jitters


def test_workload_compresses_as_published(spark):
    made = workload.generate(spark, 100, 2048).withColumn("key", F.concat_ws("|", "kind", "key"))
    encoded = codec.encode_chunks(chunks.assign_chunks(made.drop("kind"))).withColumn("kind", F.substring_index("key", "|", 1))
    ratio = {r["kind"]: r["ratio"] for r in stats.compression_report(encoded).collect()}
    assert all(ratio[k] == pytest.approx(v, rel=0.05) for k, v in {"flat": 28.55, "counter": 10.34, "wander": 3.48, None: 9.62}.items()), ratio


def test_load_generator(spark, tmp_path):
    from tidewake.sources import loadgen

    done = loadgen.write_batches(spark, str(tmp_path / "s"), 7, 50, 3, 4)
    assert (done["batches"], done["accepted"]) == (3, 350) and done["points_per_s"] > 0
    rows = loadgen.queries(spark, str(tmp_path / "s"), 50, 4).collect()
    assert [(r["agg"], r["scanned"]) for r in rows] == [("none", 50), ("avg", 50), ("avg", 50)] and rows[0]["scalar"] == 0.0 < rows[1]["scalar"]


def test_storage_round_trip(spark, tmp_path):
    s = samples(spark, [(f"k{i % 7}", i, i * 1000, float(i)) for i in range(500)])
    tables.write_samples(s, str(tmp_path / "s"))
    assert tables.read_samples(spark, str(tmp_path / "s"), "k3", 3000, 17000).orderBy("seq").select("seq").collect() == [(3,), (10,), (17,)]
    tables.write_replicated(s, str(tmp_path / "r"), ["n0", "n1", "n2"], 2)
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1000
    nested = spark.createDataFrame([("a", 0, [(1, 1.0), (2, 2.0)]), ("a", 1, [(3, 3.0)]), ("b", 0, [])], "key string, batch long, samples array<struct<ts_ms:long,value:double>>")
    assert [tuple(r) for r in tables.explode_series(nested).orderBy("seq").select("key", "ts_ms").collect()] == [("a", 1), ("a", 2), ("a", 3)]


@pytest.mark.parametrize("span", [1, 3, 7, 1000])
def test_detector_does_not_depend_on_spans(spark, span):
    rng = random.Random(span)
    rows = [(node, i, rng.random() < (0.5, 0.05, 0.95)[node]) for node in range(3) for i in range(200) if rng.random() < 0.9]
    want = []
    for node in range(3):
        misses = 0
        for _, i, ok in (r for r in rows if r[0] == node):
            if ok and misses >= 2:
                want.append((node, i, "recover"))
            misses = 0 if ok else misses + 1
            if misses == 2:
                want.append((node, i, "evict"))
    log = spark.createDataFrame(rows, "node long, seq long, ok boolean")
    assert sorted(map(tuple, cluster.transitions(log, span).collect())) == sorted(want)


def test_percentiles_put_nan_last(spark):
    xs = [math.nan, 1.0, math.inf, -math.inf, -5.0, 0.0]
    got = stats.percentiles(spark.createDataFrame([(x,) for x in xs], "x double"), "x", [0, 20, 50, 80, 100]).collect()
    assert {r["p"]: str(r["value"]) for r in got} == {0.0: "-inf", 20.0: "-5.0", 50.0: "1.0", 80.0: "inf", 100.0: "nan"}


def test_replicas_default(spark):
    assert cluster.replication(spark) == 2
    spark.conf.set("tidewake.replicas", "3")
    assert cluster.replication(spark) == 3
    spark.conf.set("tidewake.replicas", "")
    assert cluster.replication(spark) == 2


def test_health_of_live_nodes(spark):
    copies = spark.createDataFrame([("n0", "a"), ("n0", "b"), ("n1", "a"), ("n1", "a")], "node string, key string")
    assert [tuple(cluster.cluster_health(copies, live).first()) for live in (["n0", "n1", "n9"], ["n1"], [])] == [(3, 3, 4), (1, 1, 2), (0, 0, 0)]


def test_shared_folder(spark):
    from types import SimpleNamespace

    from tidewake.sources import shared

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    path = shared.shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and path.startswith(spark.conf.get("spark.checkpoint.dir"))
    shared.delete(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_chunks_are_sealed_across_micro_batches(spark, tmp_path):
    from tidewake.streaming import stream

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for n in range(4):  # each far from a whole chunk of ten
        made = spark.range(n * 6, n * 6 + 6).selectExpr("id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id AS user_id", "'k' AS event_type", "1.0D AS value", "'' AS props")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "in")).schema == spark.createDataFrame([], schema).schema
    query = stream.ingest(stream.seal_chunks(stream.stream_events(spark, str(tmp_path / "in"), 1), 10), str(tmp_path / "out"), str(tmp_path / "state"))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    assert sorted((r["chunk_id"], r["n"], r["last_ts"] - r["first_ts"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 10, 9000), (1, 10, 9000)]


def test_failure_detection_as_a_stream(spark, tmp_path):
    from tidewake.plans.registry import in_three_files, probe_log
    from tidewake.streaming import stream

    d = "/root/testdata/sf0.001"
    in_three_files(probe_log(spark, d), str(tmp_path / "in"), "seq")
    log = spark.readStream.schema("node long, seq long, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.ingest(stream.detect_failures(log), str(tmp_path / "out"), str(tmp_path / "state"))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("node", "seq", "event").collect()))
    assert got == sorted(map(tuple, cluster.transitions(probe_log(spark, d)).collect())) and got
