"""Values as CSV fields and back. Field text is the same for any engine that reads it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL, PREFIX = "\\N", "0x"
_STAMP = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?([+-]\d{2}:\d{2})?)?)?Z?$"


def number_text(value: Column) -> Column:
    """The shortest decimal text of a double, never with an exponent: 1 for 1.0."""
    text = value.cast("double").cast("string")
    wide = F.when(F.abs(value) >= 1, F.format_string("%.12f", value.cast("double"))).otherwise(F.format_string("%.340f", value.cast("double")))
    plain = F.when(text.contains("E"), wide).otherwise(text)
    return F.when(F.isnan(value.cast("double")), "NaN").when(text.contains("Inf"), F.replace(text, F.lit("Infinity"), F.lit("Inf"))).otherwise(F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def encode(value: Column, kind: T.DataType, null: str = NULL, prefix: str = PREFIX) -> Column:
    """A value of a Spark type as a field. Sub-seconds of time stamps are dropped; empty binaries are null, as in the format's origin."""
    if isinstance(kind, T.BooleanType):
        text = F.when(value, "1").otherwise("0")
        text = F.when(value.isNotNull(), text)
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = number_text(value)
    elif isinstance(kind, T.DecimalType):
        text = value.cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.when(F.length(value) > 0, F.concat(F.lit(prefix), F.lower(F.hex(value))))
    elif isinstance(kind, T.TimestampType):
        text = F.date_format(utc(value), "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, T.TimestampNTZType):
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(null))


def utc(instant: Column) -> Column:
    """The clock time at Greenwich (no zone) of an instant, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def at_utc(clock: Column) -> Column:
    """The instant at which clocks at Greenwich show a time."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), clock).cast("timestamp")


def parse_timestamp(text: Column) -> Column:
    """Time stamp (no zone; offsets are applied, others are UTC) of ISO-like text with or without T, time, seconds, fraction, offset or Z; null for empty text.

    Text of another form is an error: a wrong value must not pass for a missing one.
    """
    # The offset is taken off the clock time, so that the session's zone plays no part.
    plain = F.regexp_replace(F.regexp_replace(text, "Z$", ""), r"([ T]\d{2}:\d{2}.*)[+-]\d{2}:\d{2}$", "$1").cast("timestamp_ntz")
    offset = F.regexp_extract(text, r"[ T]\d{2}:\d{2}.*([+-]\d{2}:\d{2})Z?$", 1)
    part = lambda first, n: F.substring(offset, first, n).cast("int")
    minutes = (part(2, 2) * 60 + part(5, 2)) * F.when(offset.startswith("-"), -1).otherwise(1)
    # Most text has no offset, and casting the empty text of one costs more than all the rest.
    shifted = F.when(offset != "", plain - F.make_dt_interval(mins=minutes)).otherwise(plain)
    bad = F.raise_error(F.concat(F.lit("could not convert to a time stamp: "), text))
    return F.when(text.isNull() | (text == ""), F.lit(None).cast("timestamp_ntz")).when(text.rlike(_STAMP), shifted).otherwise(bad.cast("timestamp_ntz"))


def epoch_timestamp(number: Column) -> Column:
    """Time stamp of Unix time: milliseconds if its magnitude is over 1e12, else seconds."""
    return utc(F.when(F.abs(number) > 10**12, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number)))


def uuid_from_bytes(raw: Column) -> Column:
    """Canonical text of 16 bytes; other lengths are an error."""
    text = F.lower(F.hex(raw))
    canonical = F.concat_ws("-", *[F.substring(text, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(raw.isNull(), F.lit(None).cast("string")).when(F.length(raw) == 16, canonical).otherwise(F.raise_error(F.lit("a UUID has 16 bytes")).cast("string"))


def uuid_to_bytes(text: Column) -> Column:
    return F.unhex(F.replace(text, F.lit("-"), F.lit("")))


def decode(field: Column, kind: T.DataType, null: str | None = NULL, prefix: str | None = PREFIX, epochs: bool = False) -> Column:
    """A field as a value of a Spark type. null=None: no field means null; prefix=None: no text means bytes. Fields that don't parse are errors."""
    text = field if null is None else F.when(field != null, field)
    if isinstance(kind, T.BooleanType):
        return text.cast("boolean")
    if isinstance(kind, T.BinaryType):
        if prefix is None:
            return text.cast("binary")
        raw = F.unhex(F.substring(text, len(prefix) + 1, 2_000_000_000))
        checked = F.when(raw.isNull(), F.raise_error(F.concat(F.lit("not hexadecimal: "), text)).cast("binary")).otherwise(raw)
        return F.when(text.startswith(prefix), checked).otherwise(text.cast("binary"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        stamp = F.when(text.rlike(r"^-?\d+$"), epoch_timestamp(text.try_cast("bigint"))).otherwise(parse_timestamp(F.when(~text.rlike(r"^-?\d+$"), text))) if epochs else parse_timestamp(text)
        return at_utc(stamp) if isinstance(kind, T.TimestampType) else stamp
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, kind, {"mode": "FAILFAST"})
    return text.cast(kind)
