"""Command line: receive a live stream and print its statistics.

    python -m streamloom.cli ADDRESS PORT [--duration S] [--jitter-depth N] [--rcvbuf MB] [--out PATH] [--land PATH]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from streamloom.operators.frames import event_totals
from streamloom.sources import udp
from streamloom.streaming.receive import receive


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("address")
    p.add_argument("port", type=int)
    p.add_argument("--duration", type=float, default=None, help="seconds; without it until stopped")
    p.add_argument("--jitter-depth", type=int, default=64)
    p.add_argument("--rcvbuf", type=int, default=0, help="MB")
    p.add_argument("--out", default=None, help="folder for frame events")
    p.add_argument("--land", default=None, help="folder where datagrams are kept first, so that a restart can go on")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("streamloom").getOrCreate()
    udp.register(spark)
    source = spark.readStream.format("rtp_udp").option("host", a.address).option("port", a.port)
    if a.rcvbuf:
        source = source.option("rcvbuf", a.rcvbuf << 20)
    datagrams = source.load()
    landing = udp.land(datagrams, a.land) if a.land else None
    events = receive(udp.landed(spark, a.land) if a.land else datagrams, a.jitter_depth)

    def show(batch, _):
        if a.out:
            batch.write.mode("append").parquet(a.out)
        event_totals(batch).show(truncate=False)
        batch.where("kind = 'stats'").select("stream_id", F.col("offset").alias("late"), F.col("len").alias("duplicate"), F.col("pid").alias("net_lost")).show()

    writer = events.writeStream.foreachBatch(show).outputMode("append")
    q = (writer.option("checkpointLocation", f"{a.land}/receiving") if a.land else writer).start()
    q.awaitTermination(a.duration) if a.duration else q.awaitTermination()
    if landing:  # what has come is worked off before the end
        landing.stop()
        q.processAllAvailable()
    q.stop()


if __name__ == "__main__":
    main()
