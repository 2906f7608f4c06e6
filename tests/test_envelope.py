from datetime import datetime

import pytest

from bazaarlens.functions.buckets import instant
from bazaarlens.operators.envelope import accepted, parse_messages, rejected

from helpers import body_message, header_message, messages, uid

AS_OF = datetime(2026, 9, 1)


def parse(spark, *rows):
    return parse_messages(messages(spark, list(rows)), instant(AS_OF))


def test_header_and_body_styles_give_the_same_envelope(spark):
    body = {
        "eventType": "OrderCreated",
        "eventId": uid(1),
        "publisherService": "order-service",
        "occurredAt": "2025-11-18T10:00:00Z",
        "total": 1,
    }
    rows = accepted(
        parse(spark, header_message(1, "OrderCreated", {"total": 1}), body_message(2, body, key="k-1"))
    ).select("event_id", "event_type", "publisher_service", "partition_key", "occurred_at", "contains_pii")
    a, b = rows.collect()
    assert a == b
    assert a.event_type == "OrderCreated" and a.contains_pii


def test_header_wins_and_last_header_wins(spark):
    m = list(header_message(1, "OrderCreated", {"eventType": "Other", "eventId": 5}))
    m[5] = [("eventType", b"First"), *m[5]]
    row = parse(spark, tuple(m)).first()
    assert row.failure_reason is None and row.event_type == "OrderCreated"


def test_defaults(spark):
    row = parse(spark, body_message(7, {"eventType": "X"}, key=None)).first()
    assert row.publisher_service == "unknown"
    assert row.occurred_at == AS_OF
    assert row.partition_key == row.event_id
    again = parse(spark, body_message(7, {"eventType": "X"}, key=None)).first()
    assert again.event_id == row.event_id


@pytest.mark.parametrize(
    "message, reason, event_type",
    [
        (body_message(1, "{not-valid-json", key="malformed"), "missing_event_type", "Unknown"),
        (body_message(1, {"a": 1}), "missing_event_type", "Unknown"),
        (body_message(1, {"eventType": None}), "missing_event_type", "Unknown"),
        (body_message(1, {"eventType": 5}), "mistyped_envelope_field", "Unknown"),
        (body_message(1, {"eventType": "X", "occurredAt": 5}), "mistyped_envelope_field", "Unknown"),
        (body_message(1, {"eventType": "X", "eventId": "nope"}), "invalid_event_id", "Unknown"),
        (body_message(1, {"eventType": "X", "occurredAt": "nope"}), "invalid_occurred_at", "Unknown"),
        (body_message(1, {"eventType": " "}), "blank_envelope_field", " "),
        (body_message(1, {"eventType": "X"}, key=""), "blank_envelope_field", "X"),
        (body_message(1, {"eventType": "X", "eventId": uid(0)}), "blank_envelope_field", "X"),
        (header_message(1, "X", "{broken"), "invalid_json", "X"),
        (header_message(1, "X", "[1]"), "payload_not_object", "X"),
        (header_message(1, "X", '{"a":1} tail'), "invalid_json", "X"),
        (header_message(1, "X", ""), "invalid_json", "X"),
    ],
)
def test_rejects(spark, message, reason, event_type):
    parsed = parse(spark, message)
    assert accepted(parsed).count() == 0
    letter = rejected(parsed).first()
    assert (letter.failure_reason, letter.event_type) == (reason, event_type)
    assert letter.payload == message[4].decode()
    assert letter.retry_count == 3 and letter.reprocessed_at is None


def test_unparseable_with_headers_keeps_its_id(spark):
    letter = rejected(parse(spark, header_message(9, "X", "{broken"))).first()
    assert letter.event_id == uid(9)


def test_poison_does_not_stop_the_next_message(spark):
    parsed = parse(spark, body_message(1, "{not-valid-json"), header_message(2, "OrderCreated", {}))
    assert accepted(parsed).count() == 1 and rejected(parsed).count() == 1


def test_invalid_utf8_is_replaced_not_lost(spark):
    m = list(header_message(1, "X", {}))
    m[4] = b'{"a":"\xff"}'
    row = parse(spark, tuple(m)).first()
    assert row.failure_reason is None and "�" in row.payload
