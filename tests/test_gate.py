"""Gate corpus (FIXTURES.md 2.4): 14 accepted and 38 rejected payloads."""
from pyspark.sql import functions as F

from paylake.operators.gate import gate_counters, observe_gate, split_valid, to_keyed, validate_events
from paylake.sources.driver_tables import ACCEPT_PAYLOADS, REJECT_CASES, REJECT_PAYLOADS


def _corpus(spark):
    rows = [(i, p, True) for i, p in enumerate(ACCEPT_PAYLOADS)]
    rows += [(100 + i, p, False) for i, p in enumerate(REJECT_PAYLOADS)]
    return spark.createDataFrame(rows, "offset long, value string, expect boolean")


def test_corpus_sizes():
    assert len(ACCEPT_PAYLOADS) == 14 and len(REJECT_PAYLOADS) == 38


def test_gate_classifies_corpus(spark):
    out = validate_events(_corpus(spark)).collect()
    wrong = [(r.value, r.reason) for r in out if r.ok != r.expect]
    assert not wrong, wrong
    assert all(r.reason is None for r in out if r.ok)
    expected = dict(REJECT_CASES)
    wrong_reason = [(r.value, r.reason, expected[r.value]) for r in out
                    if not r.ok and r.reason != expected[r.value]]
    assert not wrong_reason, wrong_reason


def test_split_and_key(spark):
    good, bad = split_valid(validate_events(_corpus(spark)))
    assert good.count() == 14 and bad.count() == 38
    keys = dict(to_keyed(good).select("offset", "key").collect())
    assert keys[0] == "e1"          # full object
    assert keys[4] == "b"           # duplicate key: last wins
    assert keys[5] == "a"           # key case-insensitive
    assert keys[2] == ""          # top-level null


def test_counters_and_observation(spark):
    validated = validate_events(_corpus(spark))
    row = gate_counters(validated).first()
    assert (row.consumed, row.forwarded, row.parse_err) == (52, 14, 38)
    observed, obs = observe_gate(validated)
    observed.filter(F.col("ok")).write.format("noop").mode("overwrite").save()
    assert obs.get == {"consumed": 52, "forwarded": 14, "parse_err": 38}


#: payload, reason (None: accepted), key
DUPLICATES = [
    ('{"user_id":"x","user_id":5}', "bad_field_type", None),
    ('{"user_id":5,"user_id":"x"}', "bad_field_type", None),
    ('{"event_id":5,"event_id":"a"}', "bad_field_type", None),
    ('{"amount":"1","Amount":2}', "bad_field_type", None),
    ('{"amount":true,"zz":1,"amount":2.5}', "bad_field_type", None),
    ('{"user\\u005fid":"x","user_id":5}', "bad_field_type", None),
    ('{"user_id":1.0,"user_id":null}', "bad_field_type", None),
    ('{"event_id":"a","event_id":null}', None, "a"),
    ('{"event_id":null,"event_id":"b"}', None, "b"),
    ('{"event_id":"b","EVENT_ID":"a"}', None, "a"),
    ('{"EVENT_ID":"a","event_id":"b"}', None, "b"),
    ('{"event_id":"a","event_id":"b","event_id":null}', None, "b"),
    ('{"user_id":1,"user_id":18446744073709551615}', None, ""),
    ('{"zz":1,"zz":"x","event_id":"a"}', None, "a"),
    ('{"event_id":"a","x":{"event_id":5,"event_id":6}}', None, "a"),
    ('{"amount":1e400,"amount":1}', "bad_field_type", None),
]


def test_every_duplicate_is_checked_and_the_last_id_stands(spark):
    rows = [(i, p) for i, (p, _, _) in enumerate(DUPLICATES)]
    out = validate_events(spark.createDataFrame(rows, "offset long, value string").repartition(3))
    assert {r.offset: r.reason for r in out.collect()} == {i: r for i, (_, r, _) in enumerate(DUPLICATES)}
    keys = dict(to_keyed(split_valid(out)[0]).select("offset", "key").collect())
    assert keys == {i: k for i, (_, r, k) in enumerate(DUPLICATES) if r is None}


def test_the_gate_looks_each_field_up_once(spark):
    """The rule's conditions mention a field's kind several times; the kind is found
    once a message, and no parsed object reaches the step that may walk entries."""
    plan = validate_events(_corpus(spark).repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schemaOfVariant(try_variant_get(") == 6
    rule = next(line for line in plan.splitlines() if "malformed_json" in line)
    assert "try_variant_get(_body" not in rule and "map_keys" not in rule
