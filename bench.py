"""Bench: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints one JSON line.

Each query is forced with the ``noop`` sink (full execution, nothing
collected).  Bars come from ``lineitem`` (weekly, one symbol per supplier)
and ``events`` (hourly) as in FIXTURES.md.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ticklake.session import get_spark
    spark = get_spark(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    from pyspark.sql import functions as F

    from ticklake.operators import clean as CL
    from ticklake.operators import features as FT
    from ticklake.operators import strategy as ST
    from ticklake.operators.metrics import metrics
    from ticklake.sources.bars import bars_h, bars_w
    from ticklake.streaming import jobs as SJ

    def bars():
        return bars_w(spark, sf_dir)

    def q_bars():
        return bars()

    def q_common_strategy():
        return ST.run_strategy(bars(), ST.CommonStrategy)

    def q_momentum():
        return ST.run_strategy(bars(), "momentum")

    def q_overlap():
        return ST.run_strategy(bars(), "overlap")

    def q_clean():
        b = bars()
        gappy = b.withColumn("close", F.when((F.unix_seconds("ts") / 604800) % 10 == 0, None).otherwise(F.col("close")))
        return CL.clean(gappy, calendar=True)

    def q_sequences():
        return FT.preprocess(bars(), seq_len=20, horizon=1)

    def q_metrics():
        return metrics(bars())

    def q_stream_bars():
        return SJ.run_to_table(SJ.stream_bars(SJ.read_events_stream(spark, sf_dir)), "bench-stream")

    qs = {"bars_weekly": q_bars, "common_strategy": q_common_strategy, "momentum_category": q_momentum,
          "overlap_category": q_overlap, "cleaning_pipeline": q_clean, "sequences": q_sequences,
          "metrics": q_metrics, "stream_bars": q_stream_bars}
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    times = {}
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        df = fn()
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
