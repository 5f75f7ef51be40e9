"""A live UDP source: one datagram is one row.

UDP can't be replayed, so a stream should land its rows before anything that
must survive a restart; the reader keeps what it has handed out until the
batch is committed.
"""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

MAX_BYTES, MIN_BYTES = 9216, 12


def address(host: str | None) -> str:
    """The address to bind: any for none, 0.0.0.0 and *; else an IPv4 address in numbers."""
    if host in (None, "", "*", "0.0.0.0"):
        return "0.0.0.0"
    socket.inet_pton(socket.AF_INET, host)
    return host


class UdpReader(SimpleDataSourceStreamReader):
    """Options: host, port, rcvbuf (bytes), maxRows and maxWait (seconds) of a batch."""

    def __init__(self, options: dict):
        self.options, self.sock, self.kept = options, None, {}

    def _open(self) -> socket.socket:
        if self.sock is None:
            s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            if self.options.get("rcvbuf"):
                s.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, int(self.options["rcvbuf"]))
            s.bind((address(self.options.get("host")), int(self.options.get("port", 6000))))
            self.sock = s
        return self.sock

    def initialOffset(self) -> dict:
        return {"next": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """Datagrams of at least a fixed header, until the batch is full or its time is over."""
        s, rows, at = self._open(), [], start["next"]
        most, until = int(self.options.get("maxrows", 10000)), time.monotonic() + float(self.options.get("maxwait", 0.2))
        while len(rows) < most and (left := until - time.monotonic()) > 0:
            s.settimeout(left)
            try:
                data = s.recv(MAX_BYTES)
            except TimeoutError:
                break
            except InterruptedError:
                continue
            if len(data) >= MIN_BYTES:
                rows.append((at + len(rows), datetime.now(timezone.utc), data))
        end = at + len(rows)
        self.kept.update((r[0], r) for r in rows)
        return iter(rows), {"next": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.kept[k] for k in range(start["next"], end["next"]) if k in self.kept])

    def commit(self, end: dict) -> None:
        for k in [k for k in self.kept if k < end["next"]]:
            del self.kept[k]


SCHEMA = "arrival_id bigint, arrival_ts timestamp, data binary"


class UdpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rtp_udp"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return UdpReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``spark.readStream.format("rtp_udp")`` known."""
    spark.dataSource.register(UdpSource)


def land(datagrams: DataFrame, folder: str) -> StreamingQuery:
    """Write datagrams as they come to Parquet, from where they can be read again after a restart."""
    return datagrams.writeStream.format("parquet").option("path", f"{folder}/datagrams").option("checkpointLocation", f"{folder}/landing").start()


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """The landed datagrams as a replayable stream."""
    return spark.readStream.schema(SCHEMA).parquet(f"{folder}/datagrams")
