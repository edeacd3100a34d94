"""Scalar expressions: sizes, shares, times and renderings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.errors import UsageError

BLOCK = 512
#: Seconds of 0001-01-01T00:00:00Z and 9999-12-31T23:59:59Z.
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799
U64_MAX = (1 << 64) - 1


def ceil_block(n: Column) -> Column:
    """Bytes up to a whole number of 512-byte blocks."""
    return n + F.pmod(-n, F.lit(BLOCK))


def saturating(n: Column) -> Column:
    """An unsigned 64-bit number: not under 0 and not over 2**64 - 1."""
    return F.least(F.greatest(n.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")), F.lit(str(U64_MAX)).cast("decimal(38,0)"))


def permille(part: Column, whole: Column) -> Column:
    """part of whole in thousandths, rounded half up; 0 of nothing. For whole numbers."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor((part * 1000 + F.floor(whole / 2)) / whole)).cast("long")


def rfc3339(seconds: Column) -> Column:
    """UTC text of epoch seconds, held within years 0001 to 9999."""
    held = F.greatest(F.least(seconds, F.lit(LAST_SECOND)), F.lit(FIRST_SECOND))
    return F.date_format(F.timestamp_seconds(held), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def render_set(ids: Column) -> Column:
    """{0,1,2}"""
    return F.concat(F.lit("{"), F.array_join(ids.cast("array<string>"), ","), F.lit("}"))


def short_digest(digest: Column) -> Column:
    """sha256: and the first 12 hex digits; whatever isn't longer than that stays."""
    return F.when(F.startswith(digest, F.lit("sha256:")) & (F.length(digest) > 19), F.concat(F.substring(digest, 1, 19), F.lit("…"))).otherwise(digest)


def record_length(body: Column) -> Column:
    """Bytes of an extended-header record with a body of so many bytes ("key=value"): the number
    counts its own digits, a space and the line end."""
    rest = body + 2
    digits = lambda n: F.length(n.cast("string"))
    once = rest + digits(rest)
    return rest + digits(once)


_SIZE = r"^\+?([0-9]+)(?:([kKmMgGtT])[iI]?)?$"


def size_bytes(text: Column) -> Column:
    """Bytes of texts like 16k, 1M or 2Gi, in powers of 1024; null if it isn't one or is over
    2**64 - 1."""
    t = F.trim(text)
    number = F.ltrim(F.regexp_extract(t, _SIZE, 1), F.lit("0"))
    unit = F.lower(F.regexp_extract(t, _SIZE, 2))
    factor = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).when(unit == "t", 1 << 40).otherwise(1)
    digits = F.when(t.rlike(_SIZE) & (F.length(number) <= 20), F.coalesce(F.nullif(number, F.lit("")), F.lit("0")))
    value = digits.cast("decimal(20,0)") * factor.cast("decimal(15,0)")
    return F.when(value <= F.lit(str(U64_MAX)).cast("decimal(20,0)"), value.cast("decimal(20,0)"))


def parse_size(text: str) -> int:
    """The same for an option."""
    m = re.fullmatch(_SIZE, text.strip())
    out = int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[(m[2] or "").lower()] if m else U64_MAX + 1
    if out > U64_MAX:
        raise UsageError(f"not a size: {text!r}")
    return out


def has_bits(mode: Column, bits: int) -> Column:
    """Whether a mode has all of these bits, like 0o4000 for set-user-id."""
    return mode.bitwiseAND(F.lit(bits)) == F.lit(bits)


def octal(mode: Column) -> Column:
    """Four octal digits."""
    return F.lpad(F.conv(mode.cast("string"), 10, 8), 4, "0")
