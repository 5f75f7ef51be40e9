"""The live path: datagrams to frame events with keyed state.

The jitter buffer and the frame machine of a stream are one stateful operator.
State is small and explicit: the head, the packets held back, and the frame
machine's own fields.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streamloom.functions.rtp import validate
from streamloom.operators.frames import FrameMachine
from streamloom.operators.reorder import DEPTH
from streamloom.schemas import FRAME_EVENTS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATS = ("late", "duplicate", "net_lost")


class JitterBuffer:
    """Arrivals of one stream in, packets in order out: (seq_ext, packet, gap)."""

    def __init__(self, depth: int = DEPTH):
        self.depth, self.head, self.held, self.last = depth, None, {}, None
        self.late = self.duplicate = self.net_lost = 0

    def _extend(self, seq: int) -> int:
        """The number nearest to the head that ends in these 16 bits."""
        return self.head + (seq - self.head + 32768) % 65536 - 32768

    def _pass(self, out: list) -> None:
        packet = self.held.pop(self.head, None)
        if packet is None:
            self.net_lost += 1
        else:
            out.append((self.head, packet, self.last is not None and self.head != self.last + 1))
            self.last = self.head
        self.head += 1

    def push(self, seq: int, packet: tuple) -> list[tuple]:
        out: list[tuple] = []
        if self.head is None:
            self.head = seq
        s = self._extend(seq)
        if s < self.head:
            self.late += 1
            return out
        while s - self.head >= self.depth:
            self._pass(out)
        if s in self.held:
            self.duplicate += 1
            return out
        self.held[s] = packet
        while self.head in self.held:
            self._pass(out)
        return out


class Receiver(StatefulProcessor):
    """Per stream key: reorder, then the frame machine; rows are FRAME_EVENTS.

    A ``stats`` event closes each batch of a stream: offset, len and pid hold
    what has been late, duplicate and lost so far.
    """

    def __init__(self, depth: int = DEPTH, **machine):
        self.depth, self.machine = depth, machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stream", "saved binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            buffer, machine, number = pickle.loads(self.state.get()[0])
            machine.accept_gap, machine.accept_point = self.machine.get("accept_gap"), self.machine.get("accept_point")
        else:
            buffer, machine, number = JitterBuffer(self.depth), FrameMachine(**self.machine), 0
        given: list[dict] = []
        for batch in rows:
            batch = batch.sort_values("arrival_id")
            for seq, marker, payload in zip(batch["seq"], batch["marker"], batch["payload"], strict=True):
                for _, (m, p), gap in buffer.push(int(seq), (bool(marker), bytes(payload))):
                    given += machine.feed(p, m, gap)
        given.append(machine.event("stats", offset=buffer.late, len=buffer.duplicate, pid=buffer.net_lost))
        out = pd.DataFrame([{"stream_id": key[0], "event_no": number + k} | e for k, e in enumerate(given)])
        self.state.update((pickle.dumps((buffer, machine, number + len(given))),))
        for c in ("offset", "len", "reason", "pid"):
            out[c] = out[c].astype("Int64" if c in ("offset", "pid") else "Int32")
        out["intact"] = out["intact"].astype("boolean")
        yield out[[f.split()[0] for f in FRAME_EVENTS.split(", ")]]

    def close(self) -> None:
        pass


def receive(datagrams: DataFrame, depth: int = DEPTH, by_ssrc: bool = True, **machine) -> DataFrame:
    """A streaming DataFrame of frame events from datagrams (arrival_id, data).

    Malformed datagrams are filtered before the shuffle.  Streams are kept
    apart by SSRC; without ``by_ssrc`` all packets are one stream.
    """
    datagrams.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    key = "ssrc" if by_ssrc else "cast(0 as bigint)"
    packets = validate(datagrams).selectExpr(f"{key} AS stream_id", "arrival_id", "cast(seq as int) AS seq", "marker", "payload")
    return packets.groupBy("stream_id").transformWithStateInPandas(Receiver(depth, **machine), FRAME_EVENTS, "Append", "None")
