"""Timed run of the whole pipeline; prints one JSON line.

Messages derived from the tables are written out first (not timed). Then: ingest into the store,
the hourly pass, each dashboard over its whole history, all read models written, range queries
from them, a small late batch with its dashboards, a nightly reconciliation, a drain.
"""

from __future__ import annotations

import json
import os
import sys
import time
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from bazaarlens.functions.buckets import buckets_of_hours, instant
from bazaarlens.plans import projection
from bazaarlens.plans.dashboards import REGISTRY, project
from bazaarlens.plans.ingest import ingest_batch
from bazaarlens.session import local_session, shared_folder
from bazaarlens.sources import sample_tables, wire
from bazaarlens.sources.store import EventStore
from bazaarlens.streaming.jobs import drain

AS_OF = datetime(2025, 1, 1)
EVER = datetime(1990, 1, 1), datetime(2030, 1, 1)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, memory="16g", partitions=int(cores) if cores.isdigit() else 8)
    folder = shared_folder(spark, "bench")
    store = EventStore(spark, f"{folder}/store", period="month")
    seconds: dict[str, float] = {}

    def timed(name, action):
        started = time.time()
        result = action()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name:40s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
        return result

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    sample = sample_tables.wire_messages(spark, sf_dir).repartition(4 * int(cores))
    sample.write.parquet(f"{folder}/messages")
    sent = spark.read.parquet(f"{folder}/messages")
    late = F.col("ingested_at") >= instant(datetime(2024, 1, 29))
    messages = sent.count()
    in_first = sent.where(~late).count()

    first = timed(
        "ingest_all",
        lambda: ingest_batch(
            store, sent.where(~late).select(*wire.COLUMNS), source="b", batch_id=0, as_of=AS_OF
        ),
    )
    homes = projection.periods_of(first)
    timed("hourly_all", lambda: projection.refresh_hourly(store, homes))
    hours = projection.touched_hours(first).where(F.col("hour_start") < instant(datetime(2024, 12, 1)))
    buckets = buckets_of_hours(hours).persist()
    buckets.count()
    for name in REGISTRY:
        timed(
            f"project_{name}",
            lambda name=name: noop(
                project(name, buckets, hourly=store.hourly(), events=store.events(), only_buckets=False)
            ),
        )
    buckets.unpersist()
    timed("write_all_read_models", lambda: projection.project_batch(store, first, AS_OF))
    for name in REGISTRY:
        timed(
            f"serve_{name}",
            lambda name=name: [df.collect() for df in projection.serve(store, name, *EVER)],
        )
    batch = timed(
        "late_batch_ingest",
        lambda: ingest_batch(
            store, sent.where(late).select(*wire.COLUMNS), source="b", batch_id=1, as_of=AS_OF
        ),
    )
    timed("late_batch_dashboards", lambda: projection.project_batch(store, batch, AS_OF))
    timed(
        "reconcile_day",
        lambda: projection.reconcile(store, datetime(2024, 1, 15).date(), as_of=AS_OF),
    )
    timed("drain_dead_letters", lambda: drain(store, clock=lambda: datetime(2025, 1, 2)))
    print(
        json.dumps(
            {
                "metric": "pipeline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "messages": messages,
                "ingest_messages_per_sec": round(in_first / seconds["ingest_all"]),
            }
        )
    )


if __name__ == "__main__":
    main()
