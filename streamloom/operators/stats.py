"""Statistics by media time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.operators.reorder import unwrap

#: Ticks of a window: half a second at 90 kHz.
TICKS = 45000


def interval_stats(packets: DataFrame, ticks: int = TICKS, key: str = "stream_id", order: str = "seq_ext", ts: str = "rtp_ts") -> DataFrame:
    """Packets, bytes, frames and rate of every ``ticks`` of media time since a stream's first packet.

    Windows are tumbling by the unwrapped media clock, so the result doesn't
    depend on when it runs; frames a second are by media time, too.
    """
    flat = unwrap(packets.withColumnRenamed("seq_ext", "_seq"), key, ts, "_seq", 32).withColumnsRenamed({"seq_ext": "_ts", "_seq": "seq_ext"})
    first = F.first("_ts").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    w = flat.withColumn("interval_no", F.floor((F.col("_ts") - first) / F.lit(ticks)).cast("bigint"))
    frames = F.count_if("marker")
    return w.groupBy(key, "interval_no").agg(
        F.count("*").cast("bigint").alias("packets"), F.sum("size").cast("bigint").alias("bytes"), frames.cast("bigint").alias("frames"), (frames * F.lit(90000.0 / ticks)).alias("frames_per_second"))
