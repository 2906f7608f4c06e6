"""Tolerant reads of opaque JSON payloads: a missing or mistyped field gives its default."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.vocabulary import PII_EVENT_TYPES, PII_FIELDS, REDACTED

MONEY = "decimal(38,6)"

#: Amounts are 96-bit integers with a decimal point; what is larger is no amount.
LARGEST_MONEY = Decimal(2**96 - 1)


def parse_fields(payload: Column, *names: str) -> Column:
    """One pass over the text: a struct of variants, one per requested top-level field."""
    return F.from_json(payload, ", ".join(f"`{n}` variant" for n in names))


def kind(field: Column) -> Column:
    return F.schema_of_variant(field)


def as_string(field: Column) -> Column:
    """The field when it is a JSON string, else null."""
    return F.when(kind(field) == "STRING", F.try_variant_get(field, "$", "string"))


def as_money(field: Column) -> Column:
    """The field when it is a JSON number of at most LARGEST_MONEY either way, else 0.

    Six fraction digits are kept, further ones rounded.
    """
    numeric = (kind(field).isin("BIGINT", "DOUBLE", "FLOAT")) | kind(field).startswith("DECIMAL")
    value = F.when(numeric, F.try_variant_get(field, "$", MONEY))
    return F.coalesce(F.when(F.abs(value) <= F.lit(LARGEST_MONEY), value), F.lit(0).cast(MONEY))


def as_int(field: Column) -> Column:
    """The field when it is an integer literal that fits 32 bits, else 0."""
    value = F.when(kind(field) == "BIGINT", F.try_variant_get(field, "$", "int"))
    return F.coalesce(value, F.lit(0))


def lenient_text(payload: Column, name: str) -> Column:
    """The field as text whatever its JSON kind."""
    return F.get_json_object(payload, f"$.{name}")


def is_json(text: Column) -> Column:
    """The text is exactly one JSON value."""
    return is_framed(framed_variant(text), text)


def framed_variant(text: Column) -> Column:
    """The text and its own hash, read as the two elements of an array; null if that is no JSON.

    The parser stops after the first value, so anything trailing it would go unseen. In the frame
    it breaks the array or comes where the hash belongs.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text).cast("string"), F.lit("]")))


def is_framed(framed: Column, text: Column) -> Column:
    """Whether ``framed_variant`` of the text holds exactly one JSON value and the hash."""
    return F.coalesce(F.try_variant_get(framed, "$[1]", "bigint") == F.xxhash64(text), F.lit(False))


def is_json_object(text: Column) -> Column:
    return F.coalesce(is_json(text), F.lit(False)) & F.ltrim(text).startswith("{")


def shape_fingerprint(payload: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the sorted top-level field names."""
    names = F.sort_array(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")))
    return F.upper(F.substring(F.sha2(F.array_join(names, ","), 256), 1, 16))


def contains_pii(event_type: Column) -> Column:
    return F.coalesce(event_type.isin(*PII_EVENT_TYPES), F.lit(False))


# "field": scalar, for any personal field.
_PII_SCALAR = (
    rf'("(?:{"|".join(PII_FIELDS)})"\s*:\s*)'
    r'(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*|true|false|null)'
)


def redact(payload: Column) -> Column:
    """Blank the personal top-level fields that are present; keep everything else.

    The text is edited in place when that provably touches the top-level fields and nothing
    else: as many matches as such fields, and all of them blank afterwards. Otherwise (nested
    fields of the same name, objects as values) the object is rebuilt field by field.
    """
    names = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    present = F.size(F.filter(names, lambda n: n.isin(*PII_FIELDS)))
    matches = F.size(F.regexp_extract_all(payload, F.lit(_PII_SCALAR), F.lit(0)))
    edited = F.regexp_replace(payload, _PII_SCALAR, f'$1"{REDACTED}"')
    after = F.from_json(edited, ", ".join(f"`{n}` string" for n in PII_FIELDS))
    in_place = matches == present
    for n in PII_FIELDS:
        in_place = in_place & (F.coalesce(after[n], F.lit(REDACTED)) == REDACTED)
    return F.when(in_place, edited).otherwise(_rebuilt_without_pii(payload))


def _rebuilt_without_pii(payload: Column) -> Column:
    texts = F.from_json(payload, "map<string,string>")
    kinds = F.from_json(payload, "map<string,variant>")

    def field(entry: Column) -> Column:
        name, text = entry["key"], entry["value"]
        value = (
            F.when(name.isin(*PII_FIELDS), F.lit(f'"{REDACTED}"'))
            .when(text.isNull(), F.lit("null"))
            .when(kind(kinds[name]) == "STRING", quoted(text))
            .otherwise(text)
        )
        return F.concat(quoted(name), F.lit(":"), value)

    fields = F.array_join(F.transform(F.map_entries(texts), field), ",")
    return F.concat(F.lit("{"), F.coalesce(fields, F.lit("")), F.lit("}"))


def quoted(text: Column) -> Column:
    """The text as a JSON string literal."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, with the columns fixed as values.

    The optimizer replaces a computed column by its expression in every filter below which the
    computation lies, which multiplies costly parsing; it does not do so through a generator.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def canonical_uuid(text: Column) -> Column:
    """Lower-case hyphenated form of a uuid written plain, hyphenated, in braces or parentheses."""
    raw = F.lower(F.trim(text))
    dashed = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    size = F.length(raw)
    return (
        F.when((size == 32) & raw.rlike("^[0-9a-f]{32}$"), hyphenate(raw))
        .when((size == 36) & raw.rlike(f"^{dashed}$"), raw)
        .when((size == 38) & raw.rlike(rf"^(\{{{dashed}\}}|\({dashed}\))$"), F.substring(raw, 2, 36))
    )


def digest(*texts: Column) -> Column:
    """The 32 bytes of a SHA-256 of texts, null or not: each is written with its length, so that no
    two rows write the same."""
    each = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*each), 256))


def is_hyphenated(text: Column) -> Column:
    """Whether the text is a uuid in its canonical form; false for null."""
    dashed = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    return F.coalesce((F.length(text) == 36) & text.rlike(f"^{dashed}$"), F.lit(False))


def hyphenate(hex32: Column) -> Column:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(hex32, start, size) for start, size in cuts])


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 date or date-time, zone optional (UTC when absent); null when it is not one."""
    raw = F.trim(text)
    shaped = raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$")
    # Spark's cast wants seconds where a zone follows.
    bare = F.substring(raw, 17, 1).isin("Z", "+", "-")
    full = F.when(bare, F.concat(F.substring(raw, 1, 16), F.lit(":00"), F.substr(raw, F.lit(17)))).otherwise(raw)
    return F.when(shaped, full.try_cast("timestamp"))
