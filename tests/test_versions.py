import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators.envelope import describe_payload
from bazaarlens.functions import payload as P
from bazaarlens.operators.versions import ERASING, as_versions, first_following, latest_versions, redactions, resolve

from helpers import sequential, uid

START = datetime(2026, 1, 1)


def random_deliveries(seed, n=80, ids=12, users=3):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        kind = rng.choice(["OrderCreated", "UserRegistered", "OrderConfirmed", "UserDataErased"])
        payload = {"userId": f"u{rng.randrange(users)}", "email": f"e{seq}", "n": seq}
        if rng.random() < 0.1:
            payload.pop("userId")
        if rng.random() < 0.05:
            payload["userId"] = 5
        out.append(
            {
                "seq": seq,
                "id": uid(rng.randrange(ids) + 1),
                "type": kind,
                "payload": payload,
                "at": START + timedelta(hours=rng.randrange(2000)),
                "landed": START + timedelta(minutes=seq),
            }
        )
    return out


def arrivals(spark, deliveries, chunk=7):
    rows = [
        (d["id"], d["type"], "p", "k", d["at"], json.dumps(d["payload"]), d["landed"], f"{d['seq']:06d}", d["seq"] // chunk)
        for d in deliveries
    ]
    schema = """event_id string, event_type string, publisher_service string, partition_key string,
      occurred_at timestamp, payload string, ingested_at timestamp, arrival_seq string, arrival_chunk bigint"""
    return describe_payload(spark.createDataFrame(rows, schema), "test")


def as_model(current):
    return {
        r.event_id: {
            "type": r.event_type,
            "payload": json.loads(r.payload),
            "at": r.occurred_at,
            "pii": r.contains_pii,
            "landed": r.ingested_at,
            "redacted": r.pii_redacted_at,
        }
        for r in current.collect()
    }


@pytest.mark.parametrize("seed", range(6))
def test_resolve_equals_one_at_a_time(spark, seed):
    deliveries = random_deliveries(seed)
    resolved = resolve(arrivals(spark, deliveries))
    rows, records = sequential(deliveries)
    assert as_model(resolved.current) == rows
    got = sorted(
        (r.user_id, r.triggering_event_id, r.rows_redacted) for r in resolved.redactions.collect()
    )
    assert got == records


@pytest.mark.parametrize("seed", [3, 4])
def test_records_alone_need_few_columns(spark, seed):
    """A log of these columns gives the same records."""
    deliveries = random_deliveries(seed)
    log = arrivals(spark, deliveries)
    got = redactions(log.select(*ERASING)).orderBy("redaction_id").collect()
    assert got == resolve(log).redactions.orderBy("redaction_id").collect()
    assert sorted((r.user_id, r.triggering_event_id, r.rows_redacted) for r in got) == sequential(deliveries)[1]


def test_records_alone_without_an_erasure(spark):
    d = [{"seq": 0, "id": uid(1), "type": "OrderConfirmed", "payload": {"userId": "x"}, "at": START, "landed": START}]
    assert redactions(arrivals(spark, d).select(*ERASING)).isEmpty()


@pytest.mark.parametrize("seed", [11, 12])
def test_batches_equal_bulk(spark, seed):
    deliveries = random_deliveries(seed)
    whole = as_model(resolve(arrivals(spark, deliveries)).current)
    prior = None
    for lo in range(0, 80, 40):
        part = arrivals(spark, deliveries[lo : lo + 40])
        prior = resolve(part, prior).current
        path_rows = prior.collect()
        prior = spark.createDataFrame(path_rows, prior.schema)
    assert as_model(prior) == whole


def test_duplicated_and_shuffled_input_changes_nothing(spark):
    deliveries = random_deliveries(21)
    again = deliveries + deliveries
    random.Random(1).shuffle(again)
    assert as_model(resolve(arrivals(spark, again)).current) == as_model(
        resolve(arrivals(spark, deliveries)).current
    )


def test_an_erasure_with_nothing_pending_leaves_a_record(spark):
    d = [
        {"seq": 0, "id": uid(1), "type": "UserDataErased", "payload": {"userId": "x"}, "at": START, "landed": START},
        {"seq": 1, "id": uid(1), "type": "UserDataErased", "payload": {"userId": "x"}, "at": START, "landed": START},
    ]
    got = [r.rows_redacted for r in resolve(arrivals(spark, d)).redactions.orderBy("redaction_id").collect()]
    assert sorted(got) == [0, 1]


def test_principals(spark):
    d = [
        {"seq": 0, "id": uid(1), "type": "UserRegistered", "payload": {"userId": "x", "email": "e"}, "at": START, "landed": START},
        {"seq": 1, "id": uid(2), "type": "UserDataErased", "payload": {"userId": "x"}, "at": START, "landed": START},
        {"seq": 2, "id": uid(3), "type": "OrderConfirmed", "payload": {}, "at": START, "landed": START},
    ]
    by = {r.event_id: (r.created_by, r.updated_by) for r in resolve(arrivals(spark, d)).current.collect()}
    assert by[uid(1)] == ("test", "system:analytics-pii-redaction-sweep")
    assert by[uid(3)] == ("test", "test")


@pytest.mark.parametrize("inclusive", [True, False])
def test_first_following_against_brute_force(spark, inclusive):
    rng = random.Random(5)
    left = [(rng.choice("ab"), rng.randrange(60)) for _ in range(80)]
    right = [(rng.choice("ab"), rng.randrange(60)) for _ in range(15)]

    def frame(rows):
        return spark.createDataFrame([(k, f"{s:04d}", s // 9) for k, s in rows], "k string, arrival_seq string, arrival_chunk bigint")

    found = frame(right).withColumn("found", F.struct("arrival_seq"))
    got = first_following(frame(left), found, "k", inclusive=inclusive).collect()
    assert len(got) == len(left)
    for r in got:
        s = int(r.arrival_seq)
        later = [t for k, t in right if k == r.k and (t >= s if inclusive else t > s)]
        assert (int(r.following.arrival_seq) if r.following else None) == (min(later) if later else None)


def test_latest_of_ids_in_any_form_with_chosen_columns(spark):
    """Ids that are no uuid, that look like the bytes of one, or differ in case stay apart."""
    plain = "00112233-4455-6677-8899-aabbccddeeff"
    ids = [plain, plain.upper(), plain.replace("-", ""), plain + "\n", "no", "", "0123456789abcdef", None]
    d = [
        {"seq": 10 * n + k, "id": i, "type": f"T{k}", "payload": {"n": n}, "at": START, "landed": START + timedelta(minutes=k)}
        for n, i in enumerate(ids)
        for k in (1, 0, 2)
    ]
    rows = latest_versions(as_versions(arrivals(spark, d)), ("event_type", "payload"))
    assert rows.columns == ["event_id", "event_type", "payload", "ingested_at", "created_by", "kept"]
    got = {r.event_id: (r.event_type, json.loads(r.payload)["n"], r.ingested_at, r.created_by) for r in rows.collect()}
    assert got == {i: ("T2", n, START, "test") for n, i in enumerate(ids)} and rows.count() == len(ids)


def test_digests_tell_rows_apart(spark):
    rows = [("a", None), (None, "a"), ("a", ""), ("", "a"), ("-", ""), ("", "-"), ("1:a", ""), ("1:", "a"), (None, None), ("a-", None)]
    df = spark.createDataFrame(rows + rows, "x string, y string").select(P.digest(F.col("x"), F.col("y")).alias("d"))
    got = [bytes(r.d) for r in df.collect()]
    assert len(set(got)) == len(rows) and {len(d) for d in got} == {32} and got[: len(rows)] == got[len(rows) :]


def test_shuffles_start_with_many_small_parts(spark):
    """A task's share must not grow with the input: small parts are merged again."""
    plan = spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()
    assert ", 1000)" in plan._jdf.queryExecution().executedPlan().toString() and plan.rdd.getNumPartitions() == 1
