"""Codestream files, packetizing, and loss injection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamloom.functions.rtp import let

BODY = 1400


def read_codestreams(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of raw codestream files; those that don't begin with SOC are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.j2[ck]").load(path)
    return files.select("path", "content").where(F.hex(F.substring("content", 1, 2)) == "FF4F")


#: Bytes in which the end of a main header is looked for first.
NEAR = 4096


def sod_end(content: Column) -> Column:
    """Offset after the first SOD code; 0 if there is none."""
    # A character for each byte, so that places of the text are places of the bytes.
    def place(data: Column) -> Column:
        return F.locate("\u00ff\u0093", F.decode(data, "ISO-8859-1"))

    near = place(F.substring(content, F.lit(1), F.lit(NEAR)))
    at = F.when(near > 0, near).otherwise(F.when(F.length(content) > NEAR, place(content)).otherwise(0))
    return F.when(at > 0, at + 1).otherwise(0).cast("int")


def packetize(streams: DataFrame, content: str = "content", body: int = BODY) -> DataFrame:
    """Sub-headered packets: the main header through SOD, then bodies of ``body`` bytes; marker on the last.

    Adds pkt_no, payload, marker and drops ``content``; streams without SOD give nothing.
    """
    data = F.col(content)
    # Bound once, and without a filter on it that would be computed again: no SOD gives no packets.
    cuts = let({"end": sod_end(data), "size": F.length(data)}, lambda x: F.when(x["end"] > 0, F.transform(
        F.sequence(F.lit(0), F.ceil((x["size"] - x["end"]) / F.lit(body)).cast("int")),
        lambda k: F.struct(k.cast("bigint").alias("no"), F.when(k == 0, 1).otherwise(x["end"] + (k - 1) * body + 1).alias("at"), F.when(k == 0, x["end"]).otherwise(body).alias("n"), (x["end"] + k * body >= x["size"]).alias("last")))))
    rows = streams.withColumn("_cut", F.explode(cuts))
    head = F.when(F.col("_cut.no") == 0, F.unhex(F.lit("C000000000000000"))).otherwise(F.unhex(F.lit("0000000000000000")))
    payload = F.concat(head, F.substring(data, F.col("_cut.at"), F.col("_cut.n")))
    return rows.withColumns({"pkt_no": F.col("_cut.no"), "payload": payload, "marker": F.col("_cut.last")}).drop(content, "_cut")


def inject_loss(packets: DataFrame, lost: Column, key: str = "stream_id", order: str = "pkt_no") -> DataFrame:
    """Drop the packets that ``lost`` marks, and flag the next one delivered with ``gap``."""
    w = Window.partitionBy(key).orderBy(order)
    marked = packets.withColumn("_lost", lost).withColumn("gap", F.coalesce(F.lag("_lost").over(w), F.lit(False)))
    return marked.where(~F.col("_lost")).drop("_lost")
