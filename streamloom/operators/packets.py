"""Packet headers of whole frames: code-block byte ranges and the precinct log.

The bit cursor makes a precinct depend on the one before, so a frame is one
call; frames are independent and run in parallel, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.functions.codestream import Walk, geometry_signature, structure_of
from streamloom.operators.frames import _arrow
from streamloom.schemas import CODEBLOCK_SEGMENTS, PRECINCT_LOG

#: Frames whose rows are gathered together.
FRAMES = 256


UNSUPPORTED = (None, None, None, None, "unsupported", 0, 0, 0, "header", False)


def _walk(blob: bytes, signals: list[tuple[int, int]], flush: bool, log: list[tuple] | None, blocks: list[tuple] | None) -> None:
    """Append the log and the code-block rows of one frame, with its header at the front."""
    end = geometry_signature(blob)[1]
    header, found = structure_of(blob[:end]) if end else (None, None)
    if found is None:
        if log is not None:
            log.append(UNSUPPORTED)
        return
    w = Walk(found, header.sod_off, log, blocks)
    for offset, pid in sorted(signals):
        w.signal(offset, pid)
    good = w.advance(blob) if signals else True
    if flush and good:
        w.flush(blob)


def _frames(frames: DataFrame, ddl: str, logged: bool, flush: bool) -> DataFrame:
    """Rows of whole frames, as columns of an Arrow batch for each batch of frames."""
    schema = _arrow(ddl)
    rows = frames.select("stream_id", "frame_id", "blob", F.col("signals") if "signals" in frames.columns else F.lit(None).cast("array<struct<byte_offset:bigint,pid:bigint>>").alias("signals"))
    # The columns after the frame's own, and the step of a log.
    kinds = schema.types[3 if logged else 2 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, FRAMES):
                b = whole.slice(at, FRAMES)
                found, ends = [], [0]
                for blob, signals in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    _walk(blob or b"", [(s["byte_offset"], s["pid"]) for s in signals or []], flush, found if logged else None, None if logged else found)
                    ends.append(len(found))
                if not found:
                    continue
                sizes = np.diff(ends)
                of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                cols = [b.column(0).take(of), b.column(1).take(of)]
                if logged:
                    cols.append(pa.array(np.arange(len(found)) - np.repeat(ends[:-1], sizes), pa.int64()))
                cols += [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return rows.mapInArrow(run, ddl)


def codeblock_segments(frames: DataFrame, flush: bool = True) -> DataFrame:
    """CODEBLOCK_SEGMENTS of frames (stream_id, frame_id, blob, optionally signals)."""
    return _frames(frames, CODEBLOCK_SEGMENTS, False, flush)


def precinct_log(frames: DataFrame, flush: bool = True) -> DataFrame:
    """Every step of the walk: parsed, empty, failed, recovered or lost; frames without a structure have one row."""
    return _frames(frames, PRECINCT_LOG, True, flush)


def ready_precincts(log: DataFrame) -> DataFrame:
    """Precincts delivered, in progression order: (stream_id, frame_id, crp_idx, c, r, p)."""
    return log.where(F.col("status").isin("parsed", "empty")).select("stream_id", "frame_id", "step", "crp_idx", "c", "r", "p")


def precinct_stats(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters of the walk: parsed, bytes, failures, recoveries by outcome, skipped, and the last failure."""
    s, reason = F.col("status"), F.col("reason")
    order = F.struct("stream_id", "frame_id", "step")
    failed = F.when(s == "failed", order)
    last = F.max_by(F.struct("c", "r", "p", "crp_idx", F.col("byte_offset").alias("pos")), failed)
    done = s.isin("parsed", "empty")
    zero = F.lit(0).cast("bigint")
    agg = [
        F.count_if(done).alias("precincts_parsed"), F.sum(F.when(done, F.col("n_bytes")).otherwise(0)).alias("sum_precinct_bytes"), F.avg(F.when(done, F.col("n_bytes"))).alias("avg_precinct_bytes"),
        F.count_if(s == "failed").alias("failed_parses"), F.count_if(s == "recovered").alias("recoveries"), F.sum("skipped").cast("bigint").alias("skipped_precincts"),
        *[F.count_if((s == "lost") & (reason == r)).alias(f"recover_{r}") for r in ("no_signal", "bad_pid", "backward")], F.count_if("overrun").alias("overruns"),
        last.alias("last_failure"), F.max(zero).alias("snaps_with_drift"), F.max(zero).alias("max_drift"), F.max(zero).alias("sum_drift"),
    ]
    return log.groupBy(*(by or ["stream_id"])).agg(*agg)
