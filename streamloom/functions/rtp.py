"""RTP fields as column expressions: fixed header, payload sub-header, validity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.functions.integer import be_uint

#: Bytes that a receive buffer holds, and of the payload's own header.
MAX_BYTES, SUB_HEADER = 9216, 8


def serial_difference(a: Column, b: Column, bits: int = 16) -> Column:
    """a - b modulo 2**bits, as a signed number."""
    half = 1 << bits - 1
    return F.pmod(a - b + F.lit(half), F.lit(half * 2)) - F.lit(half)


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of values that are computed once.

    Filters on decoded fields are pushed below their projection by copying
    expressions; bound values keep those copies small.
    """
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def _fields(data: Column, x: Column) -> Column:
    base = F.lit(12) + x["b0"].bitwiseAND(15) * 4
    extended, padded = x["b0"].bitwiseAND(16) != 0, x["b0"].bitwiseAND(32) != 0
    header = F.when(~extended, base).when(x["n"] >= base + 4, base + 4 + be_uint(data, base.cast("int") + 2, 2) * 4)
    pad = F.when(padded, be_uint(data, x["n"] - 1, 1)).otherwise(F.lit(0).cast("bigint"))
    return let({"n": x["n"], "b0": x["b0"], "b1": x["b1"], "hdr_len": header, "pad_len": pad}, lambda y: _checked(data, y))


def _checked(data: Column, y: Column) -> Column:
    n, header, pad, version = y["n"], y["hdr_len"], y["pad_len"], F.shiftright(y["b0"], 6)
    reason = (
        F.when(n.isNull() | (n < 12), "short").when(version != 2, "version").when(header.isNull() | (header > n), "header")
        .when(pad > n - header, "padding").when(n - pad > MAX_BYTES, "oversize").when(n - pad - header < SUB_HEADER, "payload"))
    return F.struct(
        version.alias("version"), (y["b0"].bitwiseAND(32) != 0).alias("padding"), (y["b0"].bitwiseAND(16) != 0).alias("extension"), y["b0"].bitwiseAND(15).alias("csrc_count"),
        (y["b1"] >= 128).alias("marker"), y["b1"].bitwiseAND(127).alias("pt"), header.alias("hdr_len"), pad.alias("pad_len"), reason.alias("drop_reason"))


def decode(datagrams: DataFrame) -> DataFrame:
    """Every datagram with its fields, header and padding lengths, payload and ``drop_reason``.

    ``drop_reason`` names the first check that a malformed datagram fails:
    short, version, header, padding, oversize or payload; it is null for a
    well-formed one, and only that has a payload.
    """
    data = F.col("data")
    fields = let({"n": F.length(data), "b0": be_uint(data, 0, 1), "b1": be_uint(data, 1, 1)}, lambda x: _fields(data, x))
    out = datagrams.withColumn("_f", fields)
    names = ("version", "padding", "extension", "csrc_count", "marker", "pt", "hdr_len", "pad_len", "drop_reason")
    out = out.withColumns({n: F.col(f"_f.{n}") for n in names} | {"seq": be_uint(data, 2, 2), "rtp_ts": be_uint(data, 4, 4), "ssrc": be_uint(data, 8, 4)}).drop("_f")
    size = F.length(data) - F.col("hdr_len") - F.col("pad_len")
    return out.withColumn("payload", F.when(F.col("drop_reason").isNull(), F.substring(data, F.col("hdr_len").cast("int") + 1, size.cast("int"))))


def validate(datagrams: DataFrame) -> DataFrame:
    """Well-formed packets only; the filter comes before any shuffle."""
    return decode(datagrams).where(F.col("drop_reason").isNull()).drop("drop_reason")


def sub_header(payload: Column) -> Column:
    """The payload header's fields in use; PID is of worth only where ``ordb`` is set."""
    word = be_uint(payload, 4, 4)
    return F.struct(
        F.shiftright(be_uint(payload, 0, 1), 6).cast("int").alias("mh"), (be_uint(payload, 1, 1) >= 128).alias("ordb"),
        F.shiftright(word, 20).cast("int").alias("pos"), word.bitwiseAND((1 << 20) - 1).cast("int").alias("pid"))


def body(payload: Column) -> Column:
    return F.substring(payload, SUB_HEADER + 1, 2**31 - 1)
