"""All queries of the library by name, with their SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.hashing import ring_hash
from tidewake.functions.text import parse_nodes
from tidewake.operators import chunks, cluster, codec, ranges, ring, stats
from tidewake.sources import loadgen, tables, workload
from tidewake.sources.shared import shared_path
from tidewake.streaming import stream

START, END = 1704412800000, 1704844800000
O_START, O_END = 852076800000, 883612799999
V_FIRST, V_LAST = 1704067589165, 1706659032194
NODES3, NODES8 = ["n0", "n1", "n2"], [f"n{i}" for i in range(8)]
SPEC = "node0=node0:50051, node1=node1:50051,\n  node2=node2:50051,,broken, =x"


def events(spark: SparkSession, d: str, start: int | None = None, end: int | None = None) -> DataFrame:
    return tables.samples_from_events(spark, d, start, end)


def in_range(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d, START, END)


def chunked(spark: SparkSession, d: str) -> DataFrame:
    return chunks.assign_chunks(events(spark, d))


def chunked_orders(spark: SparkSession, d: str) -> DataFrame:
    return chunks.assign_chunks(tables.samples_from_orders(spark, d))


def user_keys(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("series-"), F.col("user_id").cast("string")).alias("key")).distinct()


def scalar(agg: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return ranges.range_query(in_range(spark, d), "click", START, END, agg).select(F.round("scalar", 4).alias("scalar"))

    return query


def all_aggs(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, *[F.round(c, 4).alias(f"v_{c}") for c in ("sum", "avg", "min", "max")], F.col("count").alias("v_count"))


def range_all_aggs(spark, d):
    rows = ranges.select_range(in_range(spark, d), "click", START, END)
    return all_aggs(rows.agg(*[c.alias(n) for n, c in ranges.aggregates().items()]))


def windows(spark: SparkSession) -> DataFrame:
    types = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "unknown", "view"]))
    q = F.col("id")
    return spark.range(200).select(q.alias("qid"), F.element_at(types, (q % 6 + 1).cast("int")).alias("key"), (1704067200000 + q * 10800000).alias("start"), (1704067200000 + q * 10800000 + (q % 9) * 7200000 - 1).alias("end"))


def chunk_prune_stats(spark, d):
    meta = chunks.chunk_meta(chunked_orders(spark, d))
    per = lambda a, n: chunks.kept(meta, O_START, O_END, a).groupBy("key").agg(F.count(F.lit(1)).alias(n))
    full = meta.groupBy("key").agg(F.count(F.lit(1)).alias("chunks")).join(per(False, "by_time"), "key", "left").join(per(True, "by_arrival"), "key", "left")
    return full.select("key", "chunks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("by_time", "by_arrival")])


def pruned_count(arrival: bool):
    def query(spark, d):
        own = chunked_orders(spark, d)
        counts = chunks.pruned_range(own, O_START, O_END, arrival).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        return own.select("key").distinct().join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))

    return query


def dod_bucket_hist(spark, d):
    return chunks.deltas(chunked(spark, d)).groupBy(chunks.dod_bits(F.col("dod")).cast("long").alias("bits")).agg(F.count(F.lit(1)).alias("n"))


def value_xor_zero(spark, d):
    return chunks.xor_values(chunked(spark, d)).groupBy("key").agg(F.count(F.when(F.col("x") == 0, 1)).alias("same"))


def xor_windows(spark, d):
    x = chunks.xor_values(chunked(spark, d)).filter("lead IS NOT NULL")
    return x.groupBy("key", "chunk_id").agg(F.count(F.lit(1)).alias("changed"), *[f(c).cast("long").alias(f"{n}_{c}") for c in ("lead", "trail") for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))])


def compression_report(spark, d):
    r = stats.compression_report(codec.encode_chunks(chunked(spark, d)), "key")
    return r.select("key", "points", "raw", "bytes", F.round("ratio", 6).alias("ratio"), F.round("bytes_per_point", 6).alias("bytes_per_point"))


def load_generator(spark, d):
    """40 series of 300 samples written in batches of 15, then the three queries over one step more, so that jitter moves no sample out."""
    path = shared_path(spark, "load")
    done = loadgen.write_batches(spark, path, 40, 300, 15, 8)
    return loadgen.queries(spark, path, 301, 8).select("agg", "key", "scanned").unionByName(spark.createDataFrame([("write", "*", done["accepted"])], "agg string, key string, scanned long"))


def workload_counters(spark, d):
    """Count and sum of values of each counter among 200 series of 100 samples, jitter and other draws aside."""
    made = workload.generate(spark, 200, 100)
    return made.filter("kind = 'counter'").groupBy("key").agg(F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total"), F.round(F.avg(F.abs(F.col("ts_ms") - workload.START_MS - workload.STEP_MS * (F.col("seq") + 1))), -1).alias("drift"))


def codec_chunks(spark, d):
    return codec.encode_chunks(chunked(spark, d)).select("key", "chunk_id", "n", "first_ts", "last_ts", F.length("payload").cast("long").alias("bytes"))


def codec_decode_range(spark, d):
    return codec.decode_range(codec.encode_chunks(chunked(spark, d)), "click", START, END)


def remapped(change):
    def query(spark, d):
        old = ring.Ring(NODES8)
        return ring.remap(user_keys(spark, d), old, change(old))

    return query


def scaling_model(spark, d):
    m = ring.scaling_model(user_keys(spark, d), range(3, 9), vnodes=64)
    return m.select("nodes", *[F.round(c, 4).alias(c) for c in ("max_share", "efficiency", "factor", "against_linear")], F.round("points_per_s", 0).alias("points_per_s"))


def probe_log(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 8).alias("node"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))


def live_health(spark, d):
    return cluster.cluster_health(cluster.fan_out(events(spark, d), NODES3, cluster.replication(spark)), ["n0", "n2"])


def cluster_health(spark, d):
    t = cluster.cluster_totals(cluster.fan_out(events(spark, d), NODES3, 2))
    return t.select("node", "series", "samples").unionByName(t.agg(F.lit("*").alias("node"), F.sum("series").alias("series"), F.sum("samples").alias("samples")))


def latency_percentiles(spark, d):
    return stats.percentiles(events(spark, d), "value", [50, 90, 95, 99, 100])


def series_index(spark: SparkSession) -> DataFrame:
    return spark.range(1000).withColumnRenamed("id", "i")


def counter_series(spark, d):
    i, s = F.col("i"), F.col("seq")
    grid = spark.range(20).select((F.col("id") + 50).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("seq"))
    return grid.select(workload.series_key(i).alias("key"), "seq", (F.lit(workload.START_MS) + workload.STEP_MS * (s + 1)).cast("long").alias("ts_ms"), workload.counter_value(s).alias("value"))


def in_three_files(df: DataFrame, path: str, seq: str) -> None:
    """Thirds by seq, one file after the other, so that a stream reads them in this order, a micro-batch each."""
    low, high = df.agg(F.min(seq), F.max(seq)).first()
    step = ((high or 0) - (low or 0)) // 3 + 1
    for n in range(3):
        df.filter((F.col(seq) >= (low or 0) + n * step) & (F.col(seq) < (low or 0) + (n + 1) * step)).coalesce(1).write.mode("append").parquet(path)


def streamed(spark: SparkSession, d: str, make, name: str) -> DataFrame:
    """The whole output of a stream over the events in three micro-batches, written as files and read back."""
    base = shared_path(spark, name)
    in_three_files(spark.read.parquet(f"{d}/events.parquet"), f"{base}/in", "event_id")
    out = make(stream.stream_events(spark, f"{base}/in", 1))
    schema = out.schema
    stream.ingest(out, f"{base}/out", f"{base}/state")
    return spark.read.schema(schema).parquet(f"{base}/out")


def stream_chunk_seal(spark, d):
    return streamed(spark, d, stream.seal_chunks, "seal")


def stream_health_transitions(spark, d):
    base = shared_path(spark, "probes")
    in_three_files(probe_log(spark, d), f"{base}/in", "seq")
    log = spark.readStream.schema("node long, seq long, ok boolean").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stream.ingest(stream.detect_failures(log), f"{base}/out", f"{base}/state")
    return spark.read.schema("node long, seq long, event string").parquet(f"{base}/out")


def stored_range(spark, d):
    """Samples written to the stored layout, then one range of one key read from it."""
    path = shared_path(spark, "samples")
    tables.write_samples(events(spark, d), path)
    return tables.read_samples(spark, path, "click", START, END).select("seq", "ts_ms", "value")


def replicated_write(spark, d):
    path = shared_path(spark, "replicas")
    tables.write_replicated(events(spark, d), path, NODES3, 2)
    return spark.read.parquet(path).groupBy(F.col("node").cast("string").alias("node"), "key").agg(F.count(F.lit(1)).alias("samples"))


def nested_write(spark, d):
    """Batches of up to 1,000 events as nested series, flattened and stored; accepted is the number of samples of each key."""
    batch = F.floor(F.col("seq") / 1000).alias("batch")
    lists = events(spark, d).groupBy("key", batch).agg(F.sort_array(F.collect_list(F.struct("seq", "ts_ms", "value"))).alias("s"))
    nested = lists.select("key", "batch", F.transform("s", lambda x: F.struct(x["ts_ms"].alias("ts_ms"), x["value"].alias("value"))).alias("samples"))
    path = shared_path(spark, "nested")
    tables.write_samples(tables.explode_series(nested), path, 8)
    flat = tables.read_samples(spark, path)
    return flat.groupBy("key").agg(F.count(F.lit(1)).alias("accepted"), F.min_by("ts_ms", "seq").alias("first_ts"), F.max_by("ts_ms", "seq").alias("last_ts"))


def stream_ingest(spark, d):
    return streamed(spark, d, lambda s: s, "ingest").groupBy("key").agg(F.count(F.lit(1)).alias("samples"))


QUERIES = {
    "range_raw": lambda s, d: ranges.range_raw(in_range(s, d), "click", START, END),
    **{f"range_{a}": scalar(a) for a in ("sum", "avg", "min", "max", "count")},
    "range_all_aggs": range_all_aggs,
    "range_scanned": lambda s, d: ranges.range_query(in_range(s, d), "error", START, END, "count").select("scanned"),
    "range_missing_key": lambda s, d: all_aggs(ranges.select_range(in_range(s, d), "missing", START, END).agg(*[c.alias(n) for n, c in ranges.aggregates().items()])),
    "range_inverted": lambda s, d: ranges.range_raw(events(s, d), "click", END, START),
    "range_unknown_agg": lambda s, d: ranges.range_by_code(in_range(s, d), "click", START, END, 9).select("scalar"),
    "range_boundary": lambda s, d: ranges.range_query(events(s, d), "view", V_FIRST, V_LAST, "count").select("scanned"),
    "range_batch": lambda s, d: all_aggs(ranges.batch_query(events(s, d), windows(s)), "qid"),
    "index_bounds": lambda s, d: ranges.index_bounds(events(s, d), START, END),
    "series_count": lambda s, d: ranges.series_count(events(s, d)),
    "samples_per_series": lambda s, d: ranges.samples_per_series(events(s, d)),
    "chunk_assign": lambda s, d: chunked(s, d).select("key", "seq", "chunk_id"),
    "chunk_meta": lambda s, d: chunks.chunk_meta(chunked(s, d)),
    "chunk_prune_stats": chunk_prune_stats,
    "range_count_minmax_prune": pruned_count(False),
    "range_count_arrival_prune": pruned_count(True),
    "ts_delta": lambda s, d: chunks.deltas(chunked(s, d)).select("key", "seq", F.coalesce("delta", F.lit(0)).alias("delta")),
    "ts_dod": lambda s, d: chunks.deltas(chunked(s, d)).select("key", "seq", F.coalesce("dod", F.lit(0)).alias("dod")),
    "dod_bucket_hist": dod_bucket_hist,
    "ts_stream_bits": lambda s, d: chunks.timestamp_bits(chunked(s, d)),
    "value_xor_zero": value_xor_zero,
    "xor_windows": xor_windows,
    "codec_roundtrip_mismatch": lambda s, d: stats.roundtrip_mismatches(chunked(s, d)),
    "codec_chunks": codec_chunks,
    "codec_decode_range": codec_decode_range,
    "compression_report": compression_report,
    "ring_hash_keys": lambda s, d: user_keys(s, d).select("key", ring_hash("key").cast("string").alias("pos")),
    "ring_owner": lambda s, d: ring.with_owner(user_keys(s, d), ring.Ring(NODES3)),
    "ring_replicas": lambda s, d: ring.with_replicas(user_keys(s, d), ring.Ring(NODES3), 2).select("key", F.array_join("replicas", ",").alias("replicas")),
    "ring_load_share": lambda s, d: ring.load_share(ring.with_owner(user_keys(s, d), ring.Ring(NODES3))).select("node", "keys", F.round("share", 6).alias("share")),
    "ring_remap_add": remapped(lambda r: r.add("n8")),
    "ring_remap_remove": remapped(lambda r: r.remove("n3")),
    "scaling_model": scaling_model,
    "replica_fanout": lambda s, d: cluster.fan_out(events(s, d), NODES3, 2).groupBy("node", "copy").agg(F.count(F.lit(1)).alias("samples")),
    "cluster_health": cluster_health,
    "live_health": live_health,
    "ring_counts": lambda s, d: ring.ring_counts(s, ring.Ring(NODES8)),
    "failover_read": lambda s, d: cluster.failover(user_keys(s, d), NODES3, 2, ["n1", "n2"]),
    "health_transitions": lambda s, d: cluster.transitions(probe_log(s, d)),
    "latency_percentiles": latency_percentiles,
    "under_threshold": lambda s, d: stats.threshold(events(s, d), "value", 50.0).select("largest", F.round("share", 6).alias("share"), F.round("mean", 4).alias("mean")),
    "series_key_gen": lambda s, d: series_index(s).select("i", workload.series_key(F.col("i")).alias("key")),
    "metric_kind": lambda s, d: series_index(s).select("i", workload.metric_kind(F.col("i")).alias("kind")),
    "counter_series": counter_series,
    "load_generator": load_generator,
    "workload_counters": workload_counters,
    "node_spec_parse": lambda s, d: parse_nodes(s.createDataFrame([(SPEC,)], "spec string")),
    "stream_chunk_seal": stream_chunk_seal,
    "stream_ingest": stream_ingest,
    "stream_health_transitions": stream_health_transitions,
    "stored_range": stored_range,
    "replicated_write": replicated_write,
    "nested_write": nested_write,
}

EV = "ev AS (SELECT event_type AS key, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, value FROM events)"
OD = "od AS (SELECT o_orderpriority AS key, o_orderkey AS seq, epoch_us(o_orderdate) // 1000 AS ts_ms, o_totalprice AS value FROM orders)"
CLICK = f"key = 'click' AND ts_ms BETWEEN {START} AND {END}"
ALL = "round(coalesce(sum(value), 0), 4) AS v_sum, round(coalesce(avg(value), 0), 4) AS v_avg, round(coalesce(min(value), 0), 4) AS v_min, round(coalesce(max(value), 0), 4) AS v_max, count(value)::DOUBLE AS v_count"
CH = EV + ", ch AS (SELECT *, ((row_number() OVER (PARTITION BY key ORDER BY seq) - 1) // 1024)::BIGINT AS chunk_id FROM ev)"
CHO = OD + ", ch AS (SELECT *, ((row_number() OVER (PARTITION BY key ORDER BY seq) - 1) // 1024)::BIGINT AS chunk_id FROM od)"
META = "meta AS (SELECT key, chunk_id, count(*) AS n, arg_min(ts_ms, seq) AS first_ts, arg_max(ts_ms, seq) AS last_ts, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts FROM ch GROUP BY ALL)"
DL = CH + ", dl AS (SELECT *, ts_ms - lag(ts_ms) OVER w AS delta FROM ch WINDOW w AS (PARTITION BY key, chunk_id ORDER BY seq)), dd AS (SELECT *, delta - coalesce(lag(delta) OVER (PARTITION BY key, chunk_id ORDER BY seq), 0) AS dod FROM dl)"
BITS = "CASE WHEN dod IS NULL THEN 64 WHEN dod = 0 THEN 1 WHEN dod BETWEEN -63 AND 64 THEN 9 WHEN dod BETWEEN -255 AND 256 THEN 12 WHEN dod BETWEEN -2047 AND 2048 THEN 16 ELSE 68 END"
# The change of the bit pattern in a chunk as 64 characters, with its leading (31 at most) and trailing zeros.
XOR = (
    CH + ", xb AS (SELECT key, chunk_id, seq, xor(value::BIT, lag(value::BIT) OVER (PARTITION BY key, chunk_id ORDER BY seq))::VARCHAR AS x FROM ch), "
    "xw AS (SELECT *, least(strpos(x, '1') - 1, 31) AS l, strpos(reverse(x), '1') - 1 AS t FROM xb)"
)
# A chunk's bytes: bits of both streams by the rules of the format; the window of the last change is carried along.
BYTES = (
    DL.replace("WITH ", "").replace(CH, XOR) + f", tb AS (SELECT key, chunk_id, sum({BITS}) AS b FROM dd GROUP BY ALL), "
    "vl AS (SELECT key, chunk_id, count(*) FILTER (strpos(x, '1') = 0) AS same, "
    "list_prepend({'l': -1, 't': -1, 'b': 0}, coalesce(list({'l': l::BIGINT, 't': t::BIGINT, 'b': 0::BIGINT} ORDER BY seq) FILTER (strpos(x, '1') > 0), [])) AS w FROM xw GROUP BY ALL), "
    "vb AS (SELECT key, chunk_id, 64 + same + list_reduce(w, lambda s, x: CASE WHEN s['l'] >= 0 AND x['l'] >= s['l'] AND x['t'] >= s['t'] "
    "THEN {'l': s['l'], 't': s['t'], 'b': s['b'] + 66 - s['l'] - s['t']} ELSE {'l': x['l'], 't': x['t'], 'b': s['b'] + 77 - x['l'] - x['t']} END)['b'] AS b FROM vl), "
    f"{META}, cb AS (SELECT meta.*, (8 + ceil(tb.b / 8.0) + ceil(vb.b / 8.0))::BIGINT AS bytes FROM meta JOIN tb USING (key, chunk_id) JOIN vb USING (key, chunk_id))"
)
KEYS = "kk AS (SELECT DISTINCT 'series-' || user_id AS key FROM events)"
TWO64 = "18446744073709551616::UHUGEINT"


def hashed(name: str, source: str, s: str) -> str:
    """A relation of source with h, the ring position of the string s."""
    return (
        f"{name}0 AS (SELECT *, list_reduce(list_prepend(1469598103934665603::UHUGEINT, list_transform(range(1, length({s}) + 1), lambda i: ascii(substring({s}, i::BIGINT, 1))::UHUGEINT)), "
        f"lambda h, c: (xor(h::UHUGEINT, c) * 1099511628211::UHUGEINT) % {TWO64}) AS a FROM {source}), "
        f"{name}1 AS (SELECT * EXCLUDE a, (a + 11400714819323198485::UHUGEINT) % {TWO64} AS a FROM {name}0), "
        f"{name}2 AS (SELECT * EXCLUDE a, (xor(a, a >> 30) * 13787848793156543929::UHUGEINT) % {TWO64} AS a FROM {name}1), "
        f"{name}3 AS (SELECT * EXCLUDE a, (xor(a, a >> 27) * 10723151780598845931::UHUGEINT) % {TWO64} AS a FROM {name}2), "
        f"{name} AS (SELECT * EXCLUDE a, xor(a, a >> 31) AS h FROM {name}3)"
    )


def ring_sql(name: str, nodes: list[str], vnodes: int = 256) -> str:
    points = f"(SELECT node, node || '#' || i AS s FROM (SELECT unnest({nodes}) AS node), range({vnodes}) t(i))"
    return hashed(name, points, "s")


def owner_sql(name: str, r: str) -> str:
    return f"{name} AS (SELECT key, coalesce(node, (SELECT arg_min(node, h) FROM {r})) AS node FROM k ASOF LEFT JOIN {r} ON k.h <= {r}.h)"


def replica_sql(name: str, r: str, n: int) -> str:
    return f"d AS (SELECT key, node, min(({r}.h + {TWO64} - k.h) % {TWO64}) AS dist FROM k, {r} GROUP BY ALL), {name} AS (SELECT key, list(node ORDER BY dist)[1:{n}] AS reps FROM d GROUP BY key)"


K = KEYS + ", " + hashed("k", "kk", "key")
EK = EV + ", kk AS (SELECT DISTINCT key FROM ev), " + hashed("k", "kk", "key") + ", " + ring_sql("r", NODES3) + ", " + replica_sql("rs", "r", 2)


def remap_sql(after: list[str], changed: str) -> str:
    return (
        f"WITH {K}, {ring_sql('r', NODES8)}, {ring_sql('q', after)}, {owner_sql('o', 'r')}, {owner_sql('p', 'q')} "
        f"SELECT count(*) AS keys, count(*) FILTER (o.node <> p.node) AS moved, count(*) FILTER (o.node <> p.node AND o.node <> '{changed}' AND p.node <> '{changed}') AS moved_elsewhere FROM o JOIN p USING (key)"
    )


def scaling_sql() -> str:
    parts = [f"{ring_sql(f'r{n}', [f'n{i}' for i in range(n)], 64)}, {owner_sql(f'o{n}', f'r{n}')}, s{n} AS (SELECT {n}::BIGINT AS nodes, max(c) / sum(c) AS m FROM (SELECT count(*) AS c FROM o{n} GROUP BY node))" for n in range(3, 9)]
    union = " UNION ALL ".join(f"SELECT * FROM s{n}" for n in range(3, 9))
    return f"WITH {K}, {', '.join(parts)} SELECT nodes, round(m, 4) AS max_share, round(1.0::DOUBLE / nodes / m * 0.97, 4) AS efficiency, round(nodes * 1600000.0::DOUBLE * (1.0::DOUBLE / nodes / m * 0.97), 0) AS points_per_s, round(m3 / m, 4) AS factor, round(m3 / m / (nodes / 3.0::DOUBLE), 4) AS against_linear FROM ({union}), (SELECT m AS m3 FROM s3)"


def prune_sql(low: str, high: str) -> str:
    return f"WITH {CHO}, {META}, kept AS (SELECT key, chunk_id FROM meta WHERE {high} >= {O_START} AND {low} <= {O_END}), c AS (SELECT key, count(*) AS n FROM ch SEMI JOIN kept USING (key, chunk_id) WHERE ts_ms BETWEEN {O_START} AND {O_END} GROUP BY key) SELECT key, coalesce(n, 0) AS n FROM (SELECT DISTINCT key FROM od) LEFT JOIN c USING (key)"


def percentile_sql() -> str:
    return "WITH l AS (SELECT list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL) SELECT p::DOUBLE AS p, v[least(len(v) - 1, floor(p * len(v) / 100)::BIGINT) + 1] AS value FROM l, (SELECT unnest([50, 90, 95, 99, 100]) AS p) WHERE len(v) > 0"


ORACLE_SQL = {
    "range_raw": f"WITH {EV} SELECT ts_ms, value FROM ev WHERE {CLICK}",
    **{f"range_{a}": f"WITH {EV} SELECT round(coalesce({a}(value), 0), 4)::DOUBLE AS scalar FROM ev WHERE {CLICK}" for a in ("sum", "avg", "min", "max", "count")},
    "range_all_aggs": f"WITH {EV} SELECT {ALL} FROM ev WHERE {CLICK}",
    "range_scanned": f"WITH {EV} SELECT count(*) AS scanned FROM ev WHERE {CLICK.replace('click', 'error')}",
    "range_missing_key": f"WITH {EV} SELECT {ALL} FROM ev WHERE {CLICK.replace('click', 'missing')}",
    "range_inverted": f"WITH {EV} SELECT ts_ms, value FROM ev WHERE key = 'click' AND ts_ms BETWEEN {END} AND {START}",
    "range_unknown_agg": "SELECT 0.0::DOUBLE AS scalar",
    "range_boundary": f"WITH {EV} SELECT count(*) AS scanned FROM ev WHERE key = 'view' AND ts_ms BETWEEN {V_FIRST} AND {V_LAST}",
    "range_batch": f"WITH {EV}, w AS (SELECT i AS qid, ['click', 'error', 'purchase', 'signup', 'unknown', 'view'][i % 6 + 1] AS key, 1704067200000 + i * 10800000 AS s, 1704067200000 + i * 10800000 + (i % 9) * 7200000 - 1 AS e FROM range(200) t(i)) SELECT qid, {ALL} FROM w LEFT JOIN ev ON ev.key = w.key AND ts_ms BETWEEN s AND e GROUP BY qid",
    "index_bounds": f"WITH {EV} SELECT key, count(*) FILTER (ts_ms < {START}) AS lower, count(*) FILTER (ts_ms <= {END}) AS upper FROM ev GROUP BY key",
    "series_count": f"WITH {EV} SELECT count(DISTINCT key) AS series FROM ev",
    "samples_per_series": f"WITH {EV} SELECT key, count(*) AS samples FROM ev GROUP BY key",
    "chunk_assign": f"WITH {CH} SELECT key, seq, chunk_id FROM ch",
    "chunk_meta": f"WITH {CH}, {META} SELECT * FROM meta",
    "chunk_prune_stats": f"WITH {CHO}, {META} SELECT key, count(*) AS chunks, count(*) FILTER (max_ts >= {O_START} AND min_ts <= {O_END}) AS by_time, count(*) FILTER (last_ts >= {O_START} AND first_ts <= {O_END}) AS by_arrival FROM meta GROUP BY key",
    "range_count_minmax_prune": prune_sql("min_ts", "max_ts"),
    "range_count_arrival_prune": prune_sql("first_ts", "last_ts"),
    "ts_delta": f"WITH {DL} SELECT key, seq, coalesce(delta, 0) AS delta FROM dd",
    "ts_dod": f"WITH {DL} SELECT key, seq, coalesce(dod, 0) AS dod FROM dd",
    "dod_bucket_hist": f"WITH {DL} SELECT ({BITS})::BIGINT AS bits, count(*) AS n FROM dd GROUP BY 1",
    "ts_stream_bits": f"WITH {DL} SELECT key, chunk_id, sum({BITS})::BIGINT AS ts_bits FROM dd GROUP BY ALL",
    "value_xor_zero": f"WITH {CH}, x AS (SELECT key, value = lag(value) OVER (PARTITION BY key, chunk_id ORDER BY seq) AS same FROM ch) SELECT key, count(*) FILTER (same) AS same FROM x GROUP BY key",
    "xor_windows": f"WITH {XOR} SELECT key, chunk_id, count(*) AS changed, sum(l)::BIGINT AS sum_lead, min(l)::BIGINT AS min_lead, max(l)::BIGINT AS max_lead, sum(t)::BIGINT AS sum_trail, min(t)::BIGINT AS min_trail, max(t)::BIGINT AS max_trail FROM xw WHERE strpos(x, '1') > 0 GROUP BY ALL",
    "codec_chunks": f"WITH {BYTES} SELECT key, chunk_id, n, first_ts, last_ts, bytes FROM cb",
    "compression_report": f"WITH {BYTES} SELECT key, sum(n)::BIGINT AS points, (sum(n) * 16)::BIGINT AS raw, sum(bytes)::BIGINT AS bytes, round((sum(n) * 16)::DOUBLE / sum(bytes)::DOUBLE, 6) AS ratio, round(sum(bytes)::DOUBLE / sum(n)::DOUBLE, 6) AS bytes_per_point FROM cb GROUP BY ROLLUP (key)",
    "live_health": f"WITH {EK} SELECT 2::BIGINT AS live, sum(series)::BIGINT AS series, sum(samples)::BIGINT AS samples FROM (SELECT reps[i + 1] AS node, count(DISTINCT key) AS series, count(*) AS samples FROM ev JOIN rs USING (key), range(2) t(i) GROUP BY 1) WHERE node IN ('n0', 'n2')",
    "ring_counts": f"WITH {ring_sql('r', NODES8)} SELECT count(DISTINCT node) AS nodes, count(DISTINCT h) AS vnodes FROM r",
    "load_generator": "SELECT 'write' AS agg, '*' AS key, 12000::BIGINT AS scanned UNION ALL SELECT * FROM (VALUES ('none', 'cpu.usage{host=h0,inst=0}', 300), ('avg', 'mem.used{host=h0,inst=1}', 300), ('avg', 'net.rx{host=h0,inst=2}', 300))",
    "workload_counters": "SELECT ['cpu.usage', 'mem.used', 'net.rx', 'disk.io', 'http.reqs'][i % 5 + 1] || '{host=h' || (i // 5) % 256 || ',inst=' || i || '}' AS key, 100::BIGINT AS samples, sum(1000 + 2 * (s + 1))::DOUBLE AS total, 0.0::DOUBLE AS drift FROM range(200) t(i), range(100) u(s) WHERE i % 100 >= 50 AND i % 100 < 80 GROUP BY i",
    "codec_roundtrip_mismatch": f"WITH {EV} SELECT DISTINCT key, 0::BIGINT AS mismatches FROM ev",
    "codec_decode_range": f"WITH {EV} SELECT ts_ms, value FROM ev WHERE {CLICK}",
    "ring_hash_keys": f"WITH {K} SELECT key, h::VARCHAR AS pos FROM k",
    "ring_owner": f"WITH {K}, {ring_sql('r', NODES3)}, {owner_sql('o', 'r')} SELECT key, node FROM o",
    "ring_replicas": f"WITH {K}, {ring_sql('r', NODES3)}, {replica_sql('rs', 'r', 2)} SELECT key, array_to_string(reps, ',') AS replicas FROM rs",
    "ring_load_share": f"WITH {K}, {ring_sql('r', NODES3)}, {owner_sql('o', 'r')} SELECT node, count(*) AS keys, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM o GROUP BY node",
    "ring_remap_add": remap_sql([*NODES8, "n8"], "n8"),
    "ring_remap_remove": remap_sql([n for n in NODES8 if n != "n3"], "n3"),
    "scaling_model": scaling_sql(),
    "replica_fanout": f"WITH {EK} SELECT reps[i + 1] AS node, i::INTEGER AS copy, count(*) AS samples FROM ev JOIN rs USING (key), range(2) t(i) GROUP BY ALL",
    "cluster_health": f"WITH {EK}, c AS (SELECT reps[i + 1] AS node, count(DISTINCT key) AS series, count(*) AS samples FROM ev JOIN rs USING (key), range(2) t(i) GROUP BY 1) SELECT * FROM c UNION ALL SELECT '*', sum(series)::BIGINT, sum(samples)::BIGINT FROM c",
    "failover_read": f"WITH {K}, {ring_sql('r', NODES3)}, {replica_sql('rs', 'r', 2)} SELECT key, list_filter(reps, lambda n: n IN ('n1', 'n2'))[1] AS node FROM rs",
    "health_transitions": "WITH p AS (SELECT user_id % 8 AS node, event_id AS seq, event_type <> 'error' AS ok FROM events), g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY node ORDER BY seq) AS run FROM p), m AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY node, run ORDER BY seq) AS misses FROM g), b AS (SELECT *, lag(misses) OVER (PARTITION BY node ORDER BY seq) AS before FROM m) SELECT node, seq, CASE WHEN ok THEN 'recover' ELSE 'evict' END AS event FROM b WHERE (NOT ok AND misses = 2) OR (ok AND before >= 2)",
    "latency_percentiles": percentile_sql(),
    "under_threshold": "SELECT max(value) AS largest, round(avg(CASE WHEN value <= 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, round(avg(value), 4) AS mean FROM events",
    "series_key_gen": "SELECT i, ['cpu.usage', 'mem.used', 'net.rx', 'disk.io', 'http.reqs'][i % 5 + 1] || '{host=h' || (i // 5) % 256 || ',inst=' || i || '}' AS key FROM range(1000) t(i)",
    "metric_kind": "SELECT i, CASE WHEN i % 100 < 50 THEN 'flat' WHEN i % 100 < 80 THEN 'counter' ELSE 'wander' END AS kind FROM range(1000) t(i)",
    "counter_series": "SELECT ['cpu.usage', 'mem.used', 'net.rx', 'disk.io', 'http.reqs'][i % 5 + 1] || '{host=h' || (i // 5) % 256 || ',inst=' || i || '}' AS key, s AS seq, 1700000000000 + 15000 * (s + 1) AS ts_ms, (1000 + 2 * (s + 1))::DOUBLE AS value FROM range(50, 70) t(i), range(100) u(s)",
    "node_spec_parse": "SELECT split_part(t, '=', 1) AS node, substr(t, instr(t, '=') + 1) AS addr FROM (SELECT trim(unnest(string_split('node0=node0:50051, node1=node1:50051,' || chr(10) || '  node2=node2:50051,,broken, =x', ',')), ' ' || chr(9) || chr(10)) AS t) WHERE instr(t, '=') > 0",
    "stream_chunk_seal": f"WITH {CH}, {META} SELECT * FROM meta WHERE n = 1024",
    "stream_ingest": f"WITH {EV} SELECT key, count(*) AS samples FROM ev GROUP BY key",
    "stored_range": f"WITH {EV} SELECT seq, ts_ms, value FROM ev WHERE {CLICK}",
    "replicated_write": f"WITH {EK} SELECT reps[i + 1] AS node, key, count(*) AS samples FROM ev JOIN rs USING (key), range(2) t(i) GROUP BY ALL",
    "nested_write": f"WITH {EV} SELECT key, count(*) AS accepted, arg_min(ts_ms, seq) AS first_ts, arg_max(ts_ms, seq) AS last_ts FROM ev GROUP BY key",
}
ORACLE_SQL["stream_health_transitions"] = ORACLE_SQL["health_transitions"]
