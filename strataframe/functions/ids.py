"""Identifiers: one spelling per UUID, digest and instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """The text without outer white space of any kind; null stays null."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def known(c: Column) -> Column:
    """The stripped text, or null where it is blank."""
    s = strip(c)
    return F.when(s != "", s)


def key_text(c: Column) -> Column:
    """Lower case without outer white space; null where blank."""
    return F.lower(known(c))


def uuid_key(c: Column) -> Column:
    """One spelling per UUID: case, white space, braces, ``urn:uuid:`` and missing hyphens don't count.

    A text that is no UUID comes out in lower case without outer white space; blank is null.
    """
    s = F.regexp_replace(key_text(c), r"^urn:uuid:|^\{|\}$", "")
    return F.when(
        s.rlike("^[0-9a-f]{32}$"),
        F.regexp_replace(s, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
    ).otherwise(s)


def digest_key(c: Column) -> Column:
    """One spelling per SHA-256 digest: case, white space and a leading algorithm name don't count."""
    return F.nullif(F.regexp_replace(key_text(c), r"^sha-?256\s*[:=\-]?\s*", ""), F.lit(""))


def known_size(c: Column) -> Column:
    """The size, or null where it is negative."""
    return F.when(c >= 0, c)


def instant(c: Column) -> Column:
    """The instant of an ISO-8601 text; null where it can't be read."""
    return F.try_to_timestamp(strip(c))
