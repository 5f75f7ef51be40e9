"""Integer and byte expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from streamloom.functions.codestream import FNV_PRIME, SIGNATURE_START


def _div(a: Column, b: Column) -> Column:
    """SQL's integer division, which never goes through floating point."""
    return F.call_function("div", a, b)


def ceildiv(a: Column | str, b: Column | int) -> Column:
    """Ceiling of a / b for integers, a of any sign, b positive."""
    a = F.col(a) if isinstance(a, str) else a
    b = b if isinstance(b, Column) else F.lit(b)
    return _div(a - F.pmod(a, b), b) + F.when(F.pmod(a, b) > 0, 1).otherwise(0)


def floordiv(a: Column, b: Column | int) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return _div(a - F.pmod(a, b), b)


def int_log2(x: Column) -> Column:
    """Place of the highest set bit; 0 for 0 and 1, as of ``x | 1``."""
    return F.length(F.bin(x.cast("bigint").bitwiseOR(F.lit(1).cast("bigint")))) - 1


def be_uint(data: Column, offset: Column | int, size: int) -> Column:
    """Big-endian unsigned integer of ``size`` bytes at a 0-based offset; bytes past the end are missing."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    return F.conv(F.hex(F.substring(data, offset + 1, F.lit(size))), 16, 10).cast("bigint")


def pid_component(pid: Column, components: int | Column = 3) -> Column:
    return F.pmod(pid, components if isinstance(components, Column) else F.lit(components))


def pid_ordinal(pid: Column, components: int | Column = 3) -> Column:
    return floordiv(pid, components)


def direction_depth(types: Column, level: Column, skip: int) -> Column:
    """How many of the first ``level`` decomposition types aren't ``skip``."""
    return F.size(F.filter(F.slice(types, F.lit(1), level), lambda t: t != skip)).cast("bigint")


def scup(data: Column, len0: Column) -> Column:
    """Suffix length of a cleanup segment: the last byte and the low half of the one before."""
    return F.when(len0 >= 2, be_uint(data, len0 - 1, 1) * 16 + F.pmod(be_uint(data, len0 - 2, 1), F.lit(16)))


def signature(data: Column) -> Column:
    """FNV-style 64-bit hash of all bytes of a short binary column, as 16 hex digits.

    Products are DECIMAL, as BIGINT multiplication would overflow; for long
    inputs use the Arrow function in ``operators.header``.
    """
    big = "decimal(38,0)"
    full = F.lit(Decimal(2**64)).cast(big)
    low = F.lit(2**32)

    def step(h: Column, x: Column) -> Column:
        # The byte touches the low 8 bits only: xor them alone and put them back.
        tail = (h % F.lit(256)).cast("int")
        return (((h - tail + tail.bitwiseXOR(x)).cast(big) * F.lit(FNV_PRIME).cast("decimal(13,0)")).cast(big) % full).cast(big)

    places = F.when(F.length(data) > 0, F.sequence(F.lit(0), F.length(data) - 1)).otherwise(F.array().cast("array<int>"))
    bytes_ = F.transform(places, lambda i: be_uint(data, i, 1).cast("int"))
    h = F.aggregate(bytes_, F.lit(Decimal(SIGNATURE_START)).cast(big), step)
    high, rest = F.floor(h / low.cast(big)).cast("bigint"), (h % low.cast(big)).cast("bigint")
    return F.lower(F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(rest), 8, "0")))
