"""Validation gate (V1-V5): accept a message only if it decodes as one
payment-event JSON object with correctly typed fields.

The rule is that of a strict typed JSON decoder:

* the text is exactly one JSON value (nothing before or after it) and that
  value is an object or ``null``;
* keys match field names case-insensitively and unknown keys are ignored; of
  duplicate keys each value must have the field's type, and the last value that
  isn't null stands;
* ``event_id`` / ``status`` / ``payment_date`` / ``updated_at`` must be strings,
  ``user_id`` an unsigned 64-bit integer, ``amount`` a finite number; ``null``
  is allowed for every field.

Everything is evaluated with Spark's native VARIANT expressions in the JVM --
no Python runs per row.  The common case (no upper-case key) is plain
code-generated expressions; only objects with upper-case or duplicate keys take a
case-insensitive lambda over all entries.  A VARIANT keeps one of equal keys, so
duplicates are told from the list of keys (``json_object_keys``), and such a
message is parsed as a map, whose entries keep them all in their order.
``try_parse_json`` stops at the
end of the first JSON value, so the text is checked in two wrappings:
``[<text>]`` must be an array of exactly one element (rejects ``{}, 1``;
a streaming ``json_array_length``) and ``{"a":<text>,"z":0}`` must be an
object of exactly two keys (rejects trailing garbage such as ``{} x`` or
``{}],[{}``).  Duplicate keys need
``spark.sql.variant.allowDuplicateKeys=true`` (see :mod:`paylake.session`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from paylake.schemas import LONG_MAX, UINT64_MAX
from paylake.session import computed

_STRING_FIELDS = ("event_id", "status", "payment_date", "updated_at")
_ALL_FIELDS = ("event_id", "user_id", "amount", "status", "payment_date", "updated_at")


def _wide(n: int) -> Column:
    """A DECIMAL(20,0) literal (64-bit-unsigned bounds do not fit a Python->JVM long)."""
    return F.lit(str(n)).cast("decimal(20,0)")


def _unsigned(kind: Column, value: Column) -> Column:
    as_long = F.try_variant_get(value, "$", "bigint")
    as_wide = F.try_variant_get(value, "$", "decimal(20,0)")
    return (((kind == "BIGINT") & (as_long >= 0))
            | (kind.rlike(r"^DECIMAL\((19|20),0\)$")
               & (as_wide > _wide(LONG_MAX)) & (as_wide <= _wide(UINT64_MAX))))


def _finite(kind: Column, value: Column) -> Column:
    as_double = F.try_variant_get(value, "$", "double")
    return ((kind == "BIGINT") | kind.startswith("DECIMAL")
            | ((kind == "DOUBLE") & ~F.isnan(as_double)
               & (F.abs(as_double) < F.lit(float("inf")))))


def _kind_ok(field: str, kind: Column, value: Column) -> Column:
    """Kind rule for the value of one known field (absent or JSON null passes);
    ``kind`` is the value's ``schema_of_variant``, null for an absent one."""
    if field in _STRING_FIELDS:
        ok = kind == "STRING"
    elif field == "user_id":
        ok = _unsigned(kind, value)
    else:
        ok = _finite(kind, value)
    return F.when(kind.isNull() | (kind == "VOID"), F.lit(True)).otherwise(F.coalesce(ok, F.lit(False)))


def _field_ok(entry: Column) -> Column:
    """Kind rule for one ``(key, value)`` entry, keys matched case-insensitively."""
    key = F.lower(entry["key"])
    value = entry["value"]
    rule = F.lit(True)
    for field in reversed(_ALL_FIELDS):
        rule = F.when(key == field, _kind_ok(field, F.schema_of_variant(value), value)).otherwise(rule)
    return rule


def _entries(value: Column) -> Column:
    """Every ``(key, value)`` entry of an object's text in order, duplicates too."""
    return F.map_entries(F.from_json(value, "map<string,variant>"))


def _field(body: Column, field: str) -> Column:
    return F.try_variant_get(body, f"$.{field}", "variant")


def _kinds(body: Column) -> dict[str, Column]:
    """The kind of each known field, looked up by its exact name."""
    return {f: F.schema_of_variant(_field(body, f)) for f in _ALL_FIELDS}


def _exact_ok(body: Column, kinds: dict[str, Column]) -> Column:
    """All known fields well typed, looked up by their exact names."""
    ok = F.lit(True)
    for field in _ALL_FIELDS:
        ok = ok & _kind_ok(field, kinds[field], _field(body, field))
    return ok


def _fields_ok(value: Column, size: Column, names: Column, exact: Column) -> Column:
    """All known fields well typed, every value of duplicate keys included.

    Fast path (no upper-case letter in any key and no key twice, the normal
    case): the six fields looked up by exact name -- plain code-generated
    expressions.  Otherwise walk every entry with a lambda so that keys match
    case-insensitively."""
    plain = (names == F.lower(names)) & ~(F.size(F.json_object_keys(value)) > size)
    by_entry = F.coalesce(F.forall(_entries(value), _field_ok), F.lit(True))
    return F.when(names.isNull(), F.lit(True)).when(plain, exact).otherwise(by_entry)


def _parsed(value: Column) -> dict[str, Column]:
    """The parsed forms of a message that the gate rule looks at."""
    wrapped = F.try_parse_json(F.concat(F.lit('{"a":'), value, F.lit(',"z":0}')))
    return {"one": F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))),
            "pair": wrapped.try_cast("map<string,variant>")}


def _facts(one: Column, pair: Column, body: Column, fields: Column, kinds: dict[str, Column]) -> dict[str, Column]:
    """What the rule needs of the parsed forms, in plain values: whether the text is
    one value and that JSON null, an object's number of keys, the keys (null for
    anything else) and whether the fields of these exact names are well typed."""
    return {"single": F.coalesce(one == 1, F.lit(False)) & F.coalesce(F.size(pair) == 2, F.lit(False)),
            "void": F.coalesce(F.is_variant_null(body), F.lit(False)),
            "size": F.size(fields),
            "names": F.array_join(F.map_keys(fields), "\u0001"),
            "exact": _exact_ok(body, kinds)}


def _reason(value: Column, single: Column, void: Column, size: Column, names: Column, exact: Column) -> Column:
    # An object is exactly what casts to a map; JSON null is also accepted.
    return (F.when(value.isNull() | ~single, F.lit("malformed_json"))
            .when(names.isNull() & ~void, F.lit("not_an_object"))
            .when(~_fields_ok(value, size, names, exact), F.lit("bad_field_type")))


def gate_reason(value: Column) -> Column:
    """NULL if the message passes the gate, else the reason it is dropped."""
    parsed = _parsed(value)
    body = parsed["pair"]["a"]
    return _reason(value, **_facts(parsed["one"], parsed["pair"], body, body.try_cast("map<string,variant>"), _kinds(body)))


def validate_events(df: DataFrame, value_col: str = "value") -> DataFrame:
    """V1: add ``ok`` (BOOLEAN) and ``reason`` (STRING, NULL when ok).

    The parsed forms, the fields' kinds and what the rule needs of them are
    intermediate columns, dropped again at the end: the rule mentions each several
    times within conditions, where nothing is shared between the mentions, and the
    step that may walk entries gets plain values in place of parsed objects.
    A filter on ``ok`` reads its value, see :func:`paylake.session.computed`."""
    value = F.col(value_col).cast("string")
    parsed = _parsed(value)
    staged = (df.withColumn("_one", parsed["one"]).withColumn("_pair", parsed["pair"])
                .withColumn("_body", F.col("_pair")["a"])
                .withColumn("_fields", F.col("_body").try_cast("map<string,variant>"))
                .withColumns({f"_kind_{f}": kind for f, kind in _kinds(F.col("_body")).items()}))
    kinds = {f: F.col(f"_kind_{f}") for f in _ALL_FIELDS}
    facts = _facts(F.col("_one"), F.col("_pair"), F.col("_body"), F.col("_fields"), kinds)
    staged = (staged.withColumns({f"_{k}": c for k, c in facts.items()})
                    .drop("_one", "_pair", "_body", "_fields", *[f"_kind_{f}" for f in kinds])
                    .withColumn("reason", _reason(value, **{k: F.col(f"_{k}") for k in facts}))
                    .drop(*[f"_{k}" for k in facts]))
    return computed(staged.withColumn("ok", F.col("reason").isNull()))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V2: (forwarded messages, dropped messages with their reason).

    Both sides derive from the same validated frame; in a stream they are
    written from one ``foreachBatch`` so the source position always advances.
    """
    good = validated.filter(F.col("ok")).drop("ok", "reason")
    bad = validated.filter(~F.col("ok")).drop("ok")
    return good, bad


def to_keyed(good: DataFrame, value_col: str = "value") -> DataFrame:
    """V3: ``(key, value)`` with the original text as value and ``event_id`` as key.

    The key is read with the same case-insensitive rule as the gate (of several
    ids, the last in the text that isn't null); a message without an id has the
    key ``''``.  Repartitioning by key is left to the sink (Kafka hashes the key).
    """
    ids = F.filter(_entries(F.col(value_col)), lambda e: F.lower(e["key"]) == "event_id")
    texts = F.filter(F.transform(ids, lambda e: F.try_variant_get(e["value"], "$", "string")), lambda x: x.isNotNull())
    key = F.coalesce(F.try_element_at(texts, F.lit(-1)), F.lit(""))
    return good.select(key.alias("key"), F.col(value_col).alias("value"),
                       *[c for c in good.columns if c not in (value_col, "key")])


def gate_counter_columns() -> list[Column]:
    """V4 counter aggregates: consumed, forwarded, parse_err."""
    return [F.count(F.lit(1)).alias("consumed"),
            F.count_if(F.col("ok")).alias("forwarded"),
            F.count_if(~F.col("ok")).alias("parse_err")]


def gate_counters(validated: DataFrame) -> DataFrame:
    """V4 as a one-row report (the batch form of the periodic log line)."""
    return validated.agg(*gate_counter_columns())


def observe_gate(validated: DataFrame, name: str = "gate") -> tuple[DataFrame, Observation]:
    """V4 without an extra pass: counters ride along the write as an Observation.

    In a stream the same metrics are reported per micro-batch through
    ``StreamingQueryListener`` / ``query.lastProgress['observedMetrics']``.
    """
    obs = Observation(name)
    return validated.observe(obs, *gate_counter_columns()), obs
