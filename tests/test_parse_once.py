"""The parse's single pass gives what separate passes gave."""

from pyspark.sql import functions as F

from bazaarlens.functions import payload as P
from bazaarlens.operators.envelope import ENVELOPE_FIELDS, _header, parse_messages
from bazaarlens.plans.corrections import ratings
from bazaarlens.sources import sample_tables
from helpers import body_message, header_message, messages

TEXTS = ("{}", "1", "null", '""', "[1]", '{"a":1} x', "1,2", "1] [2", '1,"last":0', "", " ", "{", '{"a":1,"a":2}', ' {"a":"]"} ', "nul", None)
WHOLE = [True, True, True, True, True, False, False, False, False, False, False, False, True, True, False, False]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_json_value_and_nothing_else(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = [r.ok for r in rows.select("i", F.coalesce(P.is_json(F.col("t")), F.lit(False)).alias("ok")).orderBy("i").collect()]
    assert got == WHOLE


def test_last_header_of_a_name(spark):
    rows = spark.createDataFrame(
        [(0, [("a", b"1"), ("b", b"2"), ("a", b"3")]), (1, [("b", None), (None, b"x")]), (2, []), (3, None), (4, [("a", b"1"), ("a", None)])],
        "i int, headers array<struct<key: string, value: binary>>",
    )
    got = rows.select("i", _header("a"), _header("b")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [("3", "2"), (None, None), (None, None), (None, None), (None, None)]


def test_the_text_is_parsed_once(spark):
    plan = plan_of(parse_messages(messages(spark, [header_message(1, "OrderCreated", "{}"), body_message(2, {"a": 1})]), F.lit(None).cast("timestamp")))
    assert plan.count("parseJson") == 1 and "from_json" not in plan and "json_object_keys" not in plan.lower()


def test_reviews_parse_their_payload_once(spark):
    rows = spark.createDataFrame([("e", "ReviewSubmitted", None, "{}")], "event_id string, event_type string, occurred_at timestamp, payload string")
    assert plan_of(ratings(rows)).count("from_json") == 1


def test_rows_that_become_many_events_are_dealt_out(spark, tmp_path):
    """A file of one row group must not be one task."""
    rows = spark.range(3000).selectExpr("id as o_orderkey", "id as o_custkey", "'F' as o_orderstatus", "1.0d as o_totalprice", "timestamp_ntz'1997-01-01' as o_orderdate")
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    events = sample_tables.platform_events(spark, str(tmp_path), ["OrderCreated", "OrderConfirmed"])
    assert "RepartitionByExpression" in plan_of(events)
    assert events.count() == 2700 + 2400
