"""Textual forms of durations, deadlines, timestamps, sizes, integers and payloads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units of durations in milliseconds, and of sizes in bytes.
DURATION_MS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000}
SIZE_BYTES = {
    "PiB": 1_024**5, "TiB": 1_024**4, "GiB": 1_024**3, "MiB": 1_024**2, "KiB": 1_024,
    "PB": 1_000**5, "TB": 1_000**4, "GB": 1_000**3, "MB": 1_000**2, "KB": 1_000,
    "T": 1_000**4, "B": 1_000**3, "M": 1_000**2, "K": 1_000, "": 1,
}


def _scaled(number: Column, unit: Column, units: dict[str, int]) -> Column:
    scale = F.lit(None).cast("long")
    for name, factor in units.items():
        scale = F.when(unit == name, F.lit(factor).cast("long")).otherwise(scale)
    return number.try_cast("long") * scale


def duration_ms(text: Column) -> Column:
    """Milliseconds of an unsigned integer with unit ms, s, m or h; null for anything else."""
    found = text.rlike(r"^[0-9]+(ms|s|m|h)$")
    return F.when(found, _scaled(F.regexp_extract(text, r"^([0-9]+)", 1), F.regexp_extract(text, r"(ms|s|m|h)$", 1), DURATION_MS))


def rfc3339_ms(text: Column) -> Column:
    """Milliseconds since the epoch of a date and time with offset, truncated; null if it is none."""
    found = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(found, F.unix_millis(F.try_to_timestamp(text)))


def rfc3339(ms: Column) -> Column:
    """The UTC date and time with milliseconds of a time in milliseconds; the session's zone is UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def elapsed_ms(later_ms: Column, earlier_ms: Column) -> Column:
    """Milliseconds from one time to a later one; an error where it isn't later, null for null."""
    return F.when(later_ms < earlier_ms, F.raise_error(F.lit("negative duration")).cast("long")).otherwise(later_ms - earlier_ms)


def seconds_and_nanos(ms: Column) -> Column:
    """A time in milliseconds as a struct (seconds, nanos), both cut towards zero and of its sign."""
    seconds = (ms - ms % 1_000) / 1_000
    return F.when(ms.isNotNull(), F.struct(seconds.cast("long").alias("seconds"), (ms % 1_000 * 1_000_000).cast("int").alias("nanos")))


def millis_of(parts: Column) -> Column:
    """The milliseconds of a struct (seconds, nanos); what is below a millisecond is cut off towards zero."""
    nanos = parts["nanos"].cast("long")
    return 1_000 * parts["seconds"] + ((nanos - nanos % 1_000_000) / 1_000_000).cast("long")


def deadline(text: Column, now_ms: Column) -> Column:
    """The deadline of a request: null text is now, "+" and a duration relative, digits or a date absolute."""
    relative = now_ms + duration_ms(F.substr(text, F.lit(2)))
    number = text.try_cast("double").try_cast("long")
    return F.when(text.isNull(), now_ms).when(text.startswith("+"), relative).when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), number).otherwise(rfc3339_ms(text))


def unsigned(text: Column) -> Column:
    """A long of ASCII digits only, or null; null beyond its range too."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def signed(text: Column) -> Column:
    """A long of ASCII digits with an optional minus, or null."""
    return F.when(text.rlike("^-?[0-9]+$"), text.try_cast("long"))


def size_bytes(text: Column) -> Column:
    """Bytes of an unsigned integer with a binary, metric or informal unit, whose case counts; null for anything else.

    Alone, "B" is a billion. A size beyond a long is null.
    """
    unit = F.regexp_extract(text, "([A-Za-z]*)$", 1)
    number = F.regexp_extract(text, r"^\+?([0-9]+)", 1).try_cast("long")
    scale = F.lit(None).cast("long")
    for name, factor in SIZE_BYTES.items():
        scale = F.when(unit == name, F.lit(factor).cast("long")).otherwise(scale)
    return F.when(text.rlike(r"^\+?[0-9]+([PTGMK]i?B|[TBMK])?$"), F.try_multiply(number, scale))


def integer_bytes(value: Column) -> Column:
    """The length of an integer's reply on the wire: a colon, its digits and sign, and two line ends."""
    return F.length(value.cast("string")).cast("long") + 3


def bulk_bytes(value: Column) -> Column:
    """The length of a string's reply on the wire: a dollar, its length, its bytes and four line ends."""
    n = F.octet_length(value)
    return F.length(n.cast("string")).cast("long") + n + 5


def even_part(index: Column, total: Column, parts: int) -> Column:
    """Which of `parts` even parts of `total` things the thing at index is in; the first parts get one more."""
    more = total % parts
    size = (total - more) / parts
    first = more * (size + 1)
    return F.when(index < first, F.floor(index / (size + 1))).otherwise(more + F.floor((index - first) / F.greatest(size, F.lit(1)))).cast("long")
