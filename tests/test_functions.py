from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import buckets as B
from bazaarlens.functions import measures as M
from bazaarlens.functions import payload as P


def one(spark, value, expr, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "granularity, start",
    [
        ("hour", "2028-02-29 23:00:00"),
        ("day", "2028-02-29 00:00:00"),
        ("week", "2028-02-28 00:00:00"),
        ("month", "2028-02-01 00:00:00"),
    ],
)
def test_bucket_start(spark, granularity, start):
    got = one(
        spark,
        "2028-02-29 23:59:59.999999",
        lambda v: B.bucket_start(granularity, v.cast("timestamp")).cast("string"),
    )
    assert got == start


def test_week_of_a_sunday_starts_on_the_monday_before(spark):
    got = one(spark, "2023-01-01 00:00:00", lambda v: B.bucket_start("week", v.cast("timestamp")).cast("string"))
    assert got == "2022-12-26 00:00:00"


def test_windows_of_a_date():
    day = date(2028, 2, 29)
    assert B.window_of(day, "month") == (datetime(2028, 2, 1), datetime(2028, 3, 1))
    assert B.window_of(day, "day") == (datetime(2028, 2, 29), datetime(2028, 3, 1))
    assert B.window_of(date(2023, 1, 1), "week") == (datetime(2022, 12, 26), datetime(2023, 1, 2))
    assert B.window_of(date(2022, 12, 26), "week") == (datetime(2022, 12, 26), datetime(2023, 1, 2))
    assert B.window_of(date(2023, 12, 5), "month")[1] == datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        B.window_of(day, "year")


def test_document_id_leaves_out_a_null_key(spark):
    start = B.instant(datetime(2026, 8, 18, 14))
    row = spark.range(1).select(
        B.document_id(F.lit("hour"), start).alias("a"),
        B.document_id(F.lit("hour"), start, F.lit("sku-1")).alias("b"),
        B.document_id(F.lit("hour"), start, F.lit(None).cast("string")).alias("c"),
    ).first()
    assert tuple(row) == ("hour:2026-08-18T14", "hour:2026-08-18T14:sku-1", "hour:2026-08-18T14")


def test_hours_and_buckets_of_a_window(spark):
    bounds = spark.range(1).select(
        B.instant(datetime(2026, 8, 31, 23, 30)).alias("window_from"),
        B.instant(datetime(2026, 9, 1, 1)).alias("window_to"),
    )
    hours = B.hours_between(bounds)
    assert hours.count() == 2
    counts = {r.granularity: r["count"] for r in B.buckets_of_hours(hours).groupBy("granularity").count().collect()}
    assert counts == {"hour": 2, "day": 2, "week": 1, "month": 2}


@pytest.mark.parametrize(
    "text, string, money, integer",
    [
        ('{"f":"a"}', "a", 0, 0),
        ('{"f":5}', None, 5, 5),
        ('{"f":"7"}', "7", 0, 0),
        ('{"f":4.0}', None, 4, 0),
        ('{"f":4.5}', None, 4.5, 0),
        ('{"f":1e2}', None, 100, 0),
        ('{"f":42.123456}', None, 42.123456, 0),
        ('{"f":99999999999}', None, 99999999999, 0),
        ('{"f":1e22}', None, 1e22, 0),
        ('{"f":-12345678901234567890123456789}', None, -12345678901234567890123456789, 0),
        ('{"f":79228162514264337593543950335}', None, 2**96 - 1, 0),
        ('{"f":79228162514264337593543950336}', None, 0, 0),
        ('{"f":1e40}', None, 0, 0),
        ('{"f":true}', None, 0, 0),
        ('{"f":null}', None, 0, 0),
        ('{"f":{"x":1}}', None, 0, 0),
        ('{"g":1}', None, 0, 0),
        ('{"f":"a","f":"b"}', "b", 0, 0),
    ],
)
def test_tolerant_reads(spark, text, string, money, integer):
    df = spark.createDataFrame([(text,)], "p string").select(P.parse_fields(F.col("p"), "f").alias("j"))
    row = df.select(P.as_string(F.col("j.f")), P.as_money(F.col("j.f")), P.as_int(F.col("j.f"))).first()
    assert row[0] == string
    assert float(row[1]) == pytest.approx(money)
    assert row[2] == integer


@pytest.mark.parametrize(
    "text, ok",
    [
        ('{"a":1}', True),
        ("{}", True),
        (' {"a":1} ', True),
        ("[1]", False),
        ('"x"', False),
        ("{not-valid-json", False),
        ('{"a":1', False),
        ('{"a":1} tail', False),
        ('{"a":1}{"b":2}', False),
        ('{"a":1},"b":{"c":2}', False),
        ("{'a':1}", False),
        ("", False),
        (None, False),
    ],
)
def test_json_object_check(spark, text, ok):
    assert one(spark, text, P.is_json_object) is ok


def test_fingerprint(spark):
    def shape(text):
        return one(spark, text, P.shape_fingerprint)

    assert shape('{"a":1,"b":2}') == shape('{"b":"x","a":null}')
    assert shape('{"a":1,"b":2,"promoCode":3}') != shape('{"a":1,"b":2}')
    assert shape("{}") == shape("[1]") == "E3B0C44298FC1C14"


def test_redaction_keeps_everything_else(spark):
    got = one(
        spark,
        '{"userId":"user-1","email":"a@b.com","displayName":"Alice","orderId":"order-1"}',
        P.redact,
    )
    assert got == (
        '{"userId":"user-1","email":"[redacted]","displayName":"[redacted]","orderId":"order-1"}'
    )


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"orderId":"o","total":85153.80}', '{"orderId":"o","total":85153.80}'),
        ('{"name": "a \\"b\\" c", "n":1e2}', '{"name": "[redacted]", "n":1e2}'),
        ('{"email":null}', '{"email":"[redacted]"}'),
        ('{"o":{"email":"x"},"email":"y"}', '{"o":{"email":"x"},"email":"[redacted]"}'),
        ('{"o":{"name":"x"},"name":{"first":"y"}}', '{"o":{"name":"x"},"name":"[redacted]"}'),
        ('{"o":[{"name":"x"}]}', '{"o":[{"name":"x"}]}'),
        ('{"s":"say \\"hi\\"","name":["a"],"n":null,"b":true}', '{"s":"say \\"hi\\"","name":"[redacted]","n":null,"b":true}'),
        ("{}", "{}"),
    ],
)
def test_redaction_cases(spark, text, expected):
    assert one(spark, text, P.redact) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("A0EEBC999C0B4EF8BB6D6BB9BD380A11", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"),
        ("{a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11}", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"),
        (" (a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11) ", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"),
        ("{a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11)", None),
        ("a0eebc99", None),
        ("", None),
    ],
)
def test_uuid_forms(spark, text, expected):
    assert one(spark, text, P.canonical_uuid) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-08-18T14:37:52Z", "2026-08-18 14:37:52"),
        ("2026-08-18T14:37:52.125+02:00", "2026-08-18 12:37:52.125"),
        ("2026-08-18", "2026-08-18 00:00:00"),
        ("2026-08-18 14:37", "2026-08-18 14:37:00"),
        ("2026-08-18T10:00Z", "2026-08-18 10:00:00"),
        ("2026-08-18T10:00-03:30", "2026-08-18 13:30:00"),
        ("T12:00", None),
        ("yesterday", None),
        ("2026-13-01T00:00:00Z", None),
    ],
)
def test_timestamps(spark, text, expected):
    assert one(spark, text, lambda v: P.iso_timestamp(v).cast("string")) == expected


def test_rates(spark):
    row = spark.range(1).select(
        M.drop_off(F.lit(3), F.lit(4)),
        M.drop_off(F.lit(3), F.lit(0)),
        M.safe_ratio(F.lit(1), F.lit(4)),
        M.safe_ratio(F.lit(1), F.lit(0)),
    ).first()
    assert tuple(row) == (0.25, None, 0.25, 0.0)
