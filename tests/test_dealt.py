"""Tables dealt by a key, and the queries over a delivery log dealt by event id."""

import re
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bazaarlens import session
from bazaarlens.operators.versions import as_versions, latest_versions, resolve
from bazaarlens.plans import corrections, ingest
from bazaarlens.session import written_by
from bazaarlens.sources.store import EventStore

from helpers import header_message, messages, uid

T = datetime(1997, 3, 4)
DAY = timedelta(days=1)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A few rows of each table: repeated and missing keys, erased users."""
    folder = str(tmp_path_factory.mktemp("tables"))
    n = 60
    lines = [(i % 20, i % 7 + 1, i % 5, None if i == 9 else i % 3, 1.0 + i, 10.0, 0.1, 0.0, "NAR"[i % 3], "F", T + DAY * (i % 9)) for i in range(n)]
    rows = {
        "orders": (("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"), [(i, i % 9, "OF"[i % 2], 1.5 * i, T + DAY * (i % 20)) for i in range(n)]),
        "part": (("p_partkey", "p_type", "p_size", "p_retailprice"), [(i, "LARGE", i % 8, 900.0 + i) for i in range(n)]),
        "customer": (("c_custkey",), [(i,) for i in range(n)]),
        "supplier": (("s_suppkey", "s_nationkey"), [(i, i % 5) for i in range(n)]),
        "events": (
            ("event_id", "ts", "user_id", "event_type", "value"),
            [(i, T + DAY * 9800 + DAY * (i % 40), 50 * (i % 4) + i % 2, ("signup", "view", "click", "purchase", "error")[i % 5], 2.0 * i) for i in range(4 * n)],
        ),
        "lineitem": (
            ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
            lines,
        ),
    }
    for name, (columns, values) in rows.items():
        pq.write_table(pa.table({c: [v[i] for v in values] for i, c in enumerate(columns)}), f"{folder}/{name}.parquet")
    return folder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_a_dealt_log_gives_the_same_versions_without_a_shuffle(spark, tables):
    log = entry.deliveries(spark, tables)
    dealt = written_by(log, "event_id", "log", 5)
    latest = latest_versions(as_versions(dealt), dealt=True)
    assert "Exchange" not in plan(latest)
    assert rows_of(latest) == rows_of(latest_versions(as_versions(log)))


def test_a_hot_key_is_not_left_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(session, "LARGE_PART", 0)
    rows = spark.range(40000).selectExpr("if(id % 9 = 0, concat('e', id), 'hot') as event_id", "sha2(cast(id as string), 256) as text")
    for hot in (True, False):
        log = rows if hot else rows.where("event_id <> 'hot'")
        last = written_by(log, "event_id", "log", 16).groupBy("event_id").agg(F.max("text").alias("text"))
        assert ("Exchange hashpartitioning" in plan(last)) == hot
        assert last.count() == 4445 + hot


def test_a_table_dealt_without_rows_can_be_read(spark):
    empty = written_by(spark.createDataFrame([], "event_id string, n int"), "event_id", "empty", 4)
    assert empty.count() == 0 and empty.columns == ["event_id", "n"]


def test_rows_in_one_current_table_only_are_counted(spark):
    one = [("a", 1), ("b", 2), ("c", 3), (None, 4)]
    count = lambda x, y: entry.differing_rows(*[spark.createDataFrame(r, "event_id string, v int") for r in (x, y)]).first()[0]
    assert count(one, one) == 0
    assert count(one, [("a", 1), ("b", 5), ("d", 3), (None, 4)]) == 4
    assert count(one, one[:3]) == 1 and count(one, [*one[:3], (None, 5)]) == 2


def test_replaying_deals_the_deliveries_once(spark, tables):
    found = entry.replay_equality(spark, tables)
    assert [r.differing_rows for r in found.collect()] == [0]
    # Of all events nothing but what the two current tables differ in goes through a shuffle.
    dealt = re.findall(r"Exchange hashpartitioning\((.*?)[#,]", plan(found).split("Initial Plan")[-1])
    assert set(dealt) <= {"row", "event_id"} and plan(found).count("SortMergeJoin") >= 1


@pytest.mark.parametrize("name", ["raw_upsert_latest", "pii_redaction_current", "pii_pending_scan"])
def test_current_tables_are_read_from_a_dealt_log(spark, tables, name):
    found = entry.queries()[name](spark, tables)
    plain = resolve(entry.deliveries(spark, tables)).current
    assert not re.search(r"Exchange hashpartitioning\((packed|event_id)", plan(found).split("Initial Plan")[-1])
    if name == "pii_pending_scan":
        assert found.count() > 0
        return
    assert found.count() == plain.count() > 0
    same = ["event_id", "occurred_at"] + (["payload"] if name == "raw_upsert_latest" else ["pii_redacted_at"])
    if name == "pii_redaction_current":
        assert rows_of(found.select(*same)) == rows_of(entry.comparable(plain.select(*same)))


def test_a_batch_is_resolved_without_a_shuffle_and_kept_in_no_cache(spark, root, monkeypatch):
    seen, real = [], ingest.resolve

    def spy(arrivals, prior=None, **options):
        kept = spark.sparkContext._jsc.getPersistentRDDs().size()
        latest = latest_versions(as_versions(arrivals), dealt=options["dealt"])
        seen.append((prior is None, options["dealt"], kept, "Exchange" in plan(latest)))
        return real(arrivals, prior, **options)

    monkeypatch.setattr(ingest, "resolve", spy)
    store, before = EventStore(spark, f"{root}/store"), spark.sparkContext._jsc.getPersistentRDDs().size()
    for batch in range(2):
        sent = [header_message(n, "OrderCreated", {"orderId": f"o{n}", "total": batch}) for n in range(1, 3 + batch)]
        ingest.ingest_batch(store, messages(spark, sent), source="s", batch_id=batch, as_of=T + DAY * batch)
    assert seen == [(True, True, before, False), (False, False, before, True)]
    assert {r.event_id: r.total for r in store.events().collect()} == {uid(n): 1 for n in (1, 2, 3)}
    assert store.event_log().count() == 5


def test_hours_are_gathered_by_key_before_they_are_spread(spark, tables):
    found = plan(entry.queries()["revenue_by_sku"](spark, tables))
    assert "Exchange hashpartitioning(key" in found and "Exchange hashpartitioning(granularity" not in found


def test_state_and_changes_of_ratings_come_from_one_table(spark, tables):
    reviews = entry.S.review_edits(spark, tables)
    step = corrections.apply_ratings(spark.createDataFrame([], corrections.RATING), reviews)
    assert step.state.count() == reviews.select("payload").distinct().selectExpr("get_json_object(payload, '$.orderId')", "get_json_object(payload, '$.sku')").distinct().count()
    assert not re.search("Join|parse_json|from_json", plan(step.state) + plan(step.changes))
