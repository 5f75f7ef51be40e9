"""A deterministic packet relation from the ``events`` table, with loss, jitter and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamloom.functions.integer import floordiv

STREAMS, FRAME = 8, 20


def sent_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet of every stream as sent: seq_ext, size, time, frame edges."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    seq = F.row_number().over(Window.partitionBy("stream_id").orderBy("event_id")).cast("bigint")
    # Microseconds by the written time, whatever the session's zone is.
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    p = e.withColumn("stream_id", F.pmod("user_id", F.lit(STREAMS)).cast("bigint")).withColumn("seq_ext", seq)
    return p.select(
        "stream_id", "seq_ext", "event_id", (F.lit(1) + F.floor("value")).cast("bigint").alias("size"),
        (floordiv(micros * 9, 100_000) % (1 << 32)).cast("bigint").alias("rtp_ts"),
        F.when(F.col("seq_ext") % FRAME == 1, 2).otherwise(0).cast("bigint").alias("mh"), (F.col("seq_ext") % FRAME == 0).alias("marker"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrives: a packet in 37 is lost, arrival is shuffled, a packet in 53 comes twice."""
    kept = sent_packets(spark, sf_dir).where(F.col("event_id") % 37 != 0)
    key = (F.col("seq_ext") + F.col("event_id") * 7919 % 101).cast("bigint")
    once = kept.withColumns({"key": key, "dup": F.lit(0).cast("bigint")})
    twice = kept.where(F.col("event_id") % 53 == 0).withColumns({"key": key + 3, "dup": F.lit(1).cast("bigint")})
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy("key", "seq_ext", "dup")).cast("bigint")
    return once.unionByName(twice).withColumn("arrival_id", rank).drop("key", "dup")


#: The same in SQL: common table expressions ``sent`` and ``arr``.
SQL = f"""sent AS (SELECT *, CASE WHEN seq_ext % {FRAME} = 1 THEN 2 ELSE 0 END::BIGINT AS mh, seq_ext % {FRAME} = 0 AS marker FROM (
  SELECT user_id % {STREAMS} AS stream_id, row_number() OVER (PARTITION BY user_id % {STREAMS} ORDER BY event_id) AS seq_ext, event_id,
    (1 + floor(value))::BIGINT AS size, (epoch_us(ts) * 9 // 100000) % 4294967296 AS rtp_ts FROM events)),
kept AS (SELECT *, seq_ext + event_id * 7919 % 101 AS key FROM sent WHERE event_id % 37 <> 0),
arr AS (SELECT * EXCLUDE (key, dup), row_number() OVER (PARTITION BY stream_id ORDER BY key, seq_ext, dup) AS arrival_id FROM (
  SELECT *, 0 AS dup FROM kept UNION ALL SELECT * REPLACE (key + 3 AS key), 1 AS dup FROM kept WHERE event_id % 53 = 0))"""


def datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arrival_id, stream_id, data): RTP datagrams around the arrivals, some malformed, for decoding."""
    a = arrivals(spark, sf_dir)

    def hex_of(x, digits):
        return F.lpad(F.hex(x.cast("bigint")), digits, "0")

    e = F.col("event_id")
    csrc, ext, pad = e % 3, (e % 5 == 0).cast("bigint"), (e % 7 == 0).cast("bigint")
    version = F.when(e % 41 == 0, 1).otherwise(2)
    b0 = version * 64 + pad * 32 + ext * 16 + csrc
    b1 = F.col("marker").cast("int") * 128 + 96
    head = F.concat(hex_of(b0, 2), hex_of(b1, 2), hex_of(F.col("seq_ext") % 65536, 4), hex_of(F.col("rtp_ts"), 8), hex_of(F.col("stream_id"), 8))
    extension = F.when(ext == 1, "BEDE000200000000FFFFFFFF").otherwise("")
    ordb = F.when(e % 4 == 0, 128).otherwise(0)
    payload = F.concat(hex_of(F.col("mh") * 64, 2), hex_of(ordb, 2), F.lit("0000"), hex_of(e % 4096 * 1048576 + e * 31 % 1048576, 8), F.repeat(hex_of(e % 256, 2), (F.col("size") % 16).cast("int")))
    padding = F.when(pad == 1, F.when(e % 77 == 0, "FF").otherwise("00000003")).otherwise("")
    whole = F.concat(head, F.expr("repeat('00000009', cast(event_id % 3 as int))"), extension, payload, padding)
    return a.select("arrival_id", "stream_id", "event_id", F.unhex(F.when(e % 43 == 0, F.substring(whole, 1, 20)).otherwise(whole)).alias("data"))


#: Datagrams as upper-case hex in SQL, after the expressions above: ``dg``.
SQL_DATAGRAMS = """dg AS (SELECT arrival_id, stream_id, event_id, CASE WHEN event_id % 43 = 0 THEN substr(h, 1, 20) ELSE h END AS h FROM (SELECT *,
  printf('%02X%02X%04X%08X%08X', (CASE WHEN event_id % 41 = 0 THEN 1 ELSE 2 END * 64 + (event_id % 7 = 0)::INT * 32 + (event_id % 5 = 0)::INT * 16 + event_id % 3)::BIGINT, (marker::INT * 128 + 96)::BIGINT, seq_ext % 65536, rtp_ts, stream_id)
  || repeat('00000009', event_id % 3) || CASE WHEN event_id % 5 = 0 THEN 'BEDE000200000000FFFFFFFF' ELSE '' END
  || printf('%02X%02X0000%08X', mh * 64, CASE WHEN event_id % 4 = 0 THEN 128 ELSE 0 END::BIGINT, event_id % 4096 * 1048576 + event_id * 31 % 1048576) || repeat(printf('%02X', event_id % 256), size % 16)
  || CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 77 = 0 THEN 'FF' ELSE '00000003' END ELSE '' END AS h FROM arr))"""
