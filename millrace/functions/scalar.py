"""Scalar functions over columns: hashes, encodings, filters, clocks, logic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("string").cast("binary"), 256)


def xxhash(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def checksum(c: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return F.crc32(c.cast("string").cast("binary"))


def hex_lower(c: Column) -> Column:
    return F.lower(F.hex(c.cast("string").cast("binary")))


def base64_text(c: Column) -> Column:
    return F.base64(c.cast("string").cast("binary"))


def bloom_false_rate(n: Column, bits: Column, hashes: int) -> Column:
    """Share of strangers that a Bloom filter of ``bits`` bits with n members lets pass: (1 - e^(-kn/m))^k."""
    return F.pow(1 - F.exp(-F.lit(hashes) * n / bits), F.lit(hashes))


def clock_pack(millis: Column, counter: Column) -> Column:
    """A hybrid logical clock reading in one long: 48 bits of time, 16 of a counter."""
    return F.shiftleft(millis.cast("long"), 16).bitwiseOR(counter.cast("long").bitwiseAND(F.lit(0xFFFF)))


def clock_millis(clock: Column) -> Column:
    return F.shiftrightunsigned(clock, 16)


def clock_counter(clock: Column) -> Column:
    return clock.bitwiseAND(F.lit(0xFFFF))


def case_insensitive_like(c: Column, pattern: str) -> Column:
    return c.ilike(pattern)


def is_uuid(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
