"""Jitter-buffer reordering with exact loss accounting, as window functions.

A packet of a stream is accepted if it isn't before the first one, hasn't come
already, and everything that came earlier is less than ``depth`` ahead of it:
then the buffer hadn't given it up.  What the frontier has passed without
acceptance is lost.  One sort by arrival, one by sequence; no state machine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.functions.rtp import serial_difference

DEPTH = 64


def unwrap(packets: DataFrame, key: str = "stream_id", seq: str = "seq", order: str = "arrival_id", bits: int = 16) -> DataFrame:
    """Add ``seq_ext``, the sequence number counted on across wraps, from the first arrival's value.

    Each arrival is taken as the nearest number to the one before it, so steps
    add up; streams with gaps of half the ring or more are ambiguous by nature.
    """
    w = Window.partitionBy(key).orderBy(order)
    step = F.coalesce(serial_difference(F.col(seq), F.lag(seq).over(w), bits), F.lit(0))
    first = F.first(seq).over(w)
    return packets.withColumn("_step", step.cast("bigint")).withColumn("seq_ext", (F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)) + first).cast("bigint")).drop("_step")


def classify(packets: DataFrame, depth: int = DEPTH, key: str = "stream_id", seq: str = "seq_ext", order: str = "arrival_id") -> DataFrame:
    """Add ``status``: accepted, duplicate or late, as the jitter buffer would find each arrival."""
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # The windows by stream come first: their partitioning also serves the one by stream and number.
    placed = packets.withColumns({"_first": F.first(seq).over(w), "_ahead": F.max(seq).over(before)})
    placed = placed.withColumn("_copy", F.row_number().over(Window.partitionBy(key, seq).orderBy(order)))
    released = (F.col(seq) < F.col("_first")) | (F.coalesce("_ahead", seq) >= F.col(seq) + depth)
    # A copy of a packet that the frontier has passed is late, like any other one behind it.
    status = F.when(released, "late").when(F.col("_copy") > 1, "duplicate").otherwise("accepted")
    return placed.withColumn("status", status).drop("_first", "_ahead", "_copy")


def reorder(packets: DataFrame, depth: int = DEPTH, key: str = "stream_id", seq: str = "seq_ext", order: str = "arrival_id", flush: bool = False) -> DataFrame:
    """Accepted packets up to the frontier, in sequence order, with the ``gap`` flag and ``out_no``.

    The frontier is where the buffer stops at the end of input: it has released
    all below the largest number seen less ``depth``, and the run of packets
    without a hole above that.  ``flush`` also releases the rest.
    """
    accepted = classify(packets, depth, key, seq, order).where("status = 'accepted'").drop("status")
    w = Window.partitionBy(key).orderBy(seq)
    whole = Window.partitionBy(key)
    out = accepted.withColumns({"_max": F.max(seq).over(whole), "_before": F.lag(seq).over(w)})
    gap = F.coalesce(F.col(seq) != F.col("_before") + 1, F.lit(False))
    # The first hole above the forced frontier holds back all behind it.
    hole = F.max(F.when(gap & (F.col(seq) - 1 > F.col("_max") - depth), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumns({"gap": gap, "_held": hole})
    if not flush:
        out = out.where("_held = 0")
    return out.withColumn("out_no", F.row_number().over(w).cast("bigint")).drop("_max", "_before", "_held")


def loss_stats(packets: DataFrame, depth: int = DEPTH, key: str = "stream_id", seq: str = "seq_ext", order: str = "arrival_id") -> DataFrame:
    """Per stream: accepted, duplicate, late, net_lost and the drop counters.

    ``slot_busy`` and ``queue_full`` are backpressure of a fixed ring; they
    are 0, as Spark holds its source back instead.
    """
    c = classify(packets, depth, key, seq, order).withColumn("_max", F.max(seq).over(Window.partitionBy(key)))
    ok = F.col("status") == "accepted"
    out = c.groupBy(key).agg(
        F.count_if(ok).cast("bigint").alias("accepted"), F.count_if(F.col("status") == "duplicate").cast("bigint").alias("duplicate"), F.count_if(F.col("status") == "late").cast("bigint").alias("late"),
        F.min_by(seq, order).alias("_first"), F.max("_max").alias("_max"), F.count_if(ok & (F.col(seq) <= F.col("_max") - depth)).alias("_released"))
    lost = F.greatest(F.col("_max") - depth - F.col("_first") + 1, F.lit(0)) - F.col("_released")
    zero = F.lit(0).cast("bigint")
    return out.select(key, "accepted", "duplicate", "late", lost.cast("bigint").alias("net_lost"), zero.alias("slot_busy"), zero.alias("queue_full"), lost.cast("bigint").alias("total_drops"))
