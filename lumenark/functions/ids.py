"""Stable derived ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_of(*parts: Column) -> Column:
    """sha256 of parts joined by the unit separator."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def signless_long(digest: Column) -> Column:
    """The first 8 bytes of a hex digest as a positive long: the sign bit is cleared, and 0 is 1."""
    first = F.conv(F.substring(digest, 1, 1), 16, 10).cast("int").bitwiseAND(7)
    return F.greatest(F.lit(1).cast("long"), F.conv(F.concat(F.hex(first), F.substring(digest, 2, 15)), 16, 10).cast("long"))


def uuid_v3(text: Column) -> Column:
    """Name-based UUID of the text's bytes: md5 with version and variant set."""
    h = F.md5(text)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def retry_delay_ms(attempt: Column) -> Column:
    """30 s doubled with each attempt, at most 120 s."""
    return F.lit(30_000).cast("long") * F.pow(F.lit(2), F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(2))).cast("long")


def status_after_failure(attempt: Column, permanent: Column, most: int = 3) -> Column:
    return F.when(permanent, "FAILED_PERMANENT").when(attempt >= most, "FAILED_EXHAUSTED").otherwise("FAILED_RETRYABLE")


def minutes_seconds(ms: Column) -> Column:
    """m:ss"""
    s = F.floor(ms / 1000).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)
