"""Lax readings of values that came as text, and the problems of a record, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean true or false.
TRUE, FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")
UUID = "^(?:urn:uuid:)?\\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\\}?$"


def lax_int(text: Column) -> Column:
    """Whole numbers, with underscores between digits or a fraction of zeros; null for anything else."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?<=\d)_(?=\d)", ""), r"\.0*$", "")
    return F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("long"))


def lax_bool(text: Column) -> Column:
    said = F.lower(text)
    return F.when(said.isin(*TRUE), True).when(said.isin(*FALSE), False)


def lax_uuid(text: Column) -> Column:
    """Lower-case, hyphenated; braces, a URN prefix and missing hyphens are forgiven."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^urn:uuid:|[{}-]", "")
    parts = [F.substr(bare, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.lower(F.trim(text)).rlike(UUID), F.concat_ws("-", *parts))


def lax_timestamp(text: Column) -> Column:
    """ISO 8601 with a date and optional time and offset (UTC if none), or Unix seconds, or milliseconds from 2e10 on."""
    number = F.when(F.trim(text).rlike(r"^-?\d+(\.\d+)?$"), F.trim(text).try_cast("double"))
    seconds = F.when(F.abs(number) > 2e10, number / 1000).otherwise(number)
    iso = F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"), F.trim(text).try_cast("timestamp"))
    return F.when(number.isNotNull(), F.timestamp_micros((seconds * 1_000_000).cast("long"))).otherwise(iso)


def problems(**checks: Column) -> Column:
    """Names of the checks that a record fails, in order; a check that is null is not failed."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
