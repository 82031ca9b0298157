"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line. Each time is the best of two runs of the full result."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

NAMES = [
    "range_sum", "range_all_aggs", "range_batch", "index_bounds", "samples_per_series", "chunk_meta", "range_count_minmax_prune", "ts_stream_bits",
    "codec_roundtrip_mismatch", "codec_decode_range", "ring_owner", "ring_replicas", "replica_fanout", "cluster_health", "health_transitions", "latency_percentiles",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidewake.operators import chunks, codec, ranges, stats
    from tidewake.plans.registry import QUERIES
    from tidewake.sources import tables, workload

    def timed(make) -> float:
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return round(best, 3)

    out = {n: timed(lambda n=n: QUERIES[n](spark, sf)) for n in NAMES}
    # Scan rate over doubles that are there, in memory as columns; and with their generation, as in earlier rounds.
    n = 20_000_000
    doubles = spark.range(n, numPartitions=int(cpus)).select((F.pmod(F.col("id") * 2654435761, F.lit(10007)) - 5000).cast("double").alias("value"))
    wanted = [c.alias(name) for name, c in ranges.aggregates().items()]
    out["aggregate_20m"] = timed(lambda: doubles.agg(*wanted))
    held = doubles.cache()
    held.count()
    out["aggregate_20m_in_memory"] = timed(lambda: held.agg(*wanted))
    held.unpersist()
    # Ratios of the described workload at a tenth of its size; then encoding and writing alone, over samples that are there.
    made = workload.generate(spark, 300, 1000).withColumn("key", F.concat_ws("|", "kind", "key"))
    encoded = codec.encode_chunks(chunks.assign_chunks(made.drop("kind"))).withColumn("kind", F.substring_index("key", "|", 1))
    start = time.perf_counter()
    report = {r["kind"] or "all": round(r["ratio"], 3) for r in stats.compression_report(encoded).collect()}
    out["generate_encode_300k"] = round(time.perf_counter() - start, 3)
    lists = codec.chunk_lists(chunks.assign_chunks(made.drop("kind"))).crossJoin(spark.range(10).select("id")).drop("id").repartition(4 * int(cpus)).cache()
    points = lists.agg(F.sum("n")).first()[0]
    out["encode_3m"] = timed(lambda: codec.encode_lists(lists))
    one = timed(lambda: codec.encode_lists(lists.limit(lists.count() // 10).coalesce(1)))
    with tempfile.TemporaryDirectory() as folder:
        start = time.perf_counter()
        tables.write_samples(made.select("key", "seq", "ts_ms", "value"), f"{folder}/samples", 8)
        written = round(time.perf_counter() - start, 3)
    rates = {
        "melem_per_s": round(n / 1e6 / out["aggregate_20m"], 1), "melem_per_s_in_memory": round(n / 1e6 / out["aggregate_20m_in_memory"], 1),
        "encode_points_per_s": round(points / out["encode_3m"]), "encode_points_per_s_one_task": round(points / 10 / one), "encode_speedup": round(points / out["encode_3m"] / (points / 10 / one), 2),
        "write_points_per_s": round(300_000 / written), "windows_per_s": round(200 / out["range_batch"]),
    }
    print(json.dumps({"metric": "total_seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf, "compression": report, **rates}))
    spark.stop()


if __name__ == "__main__":
    main()
