"""Sinks: codestream files, code-block logs, and per-batch tables of a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def log_lines(segments: DataFrame, log: DataFrame) -> DataFrame:
    """(stream_id, frame_id, line_no, line): "resolution,band,length" of each code-block, EMPTY*** and FAILURE."""
    blocks = segments.select("stream_id", "frame_id", "crp_idx", F.lit(1).alias("kind"), "b", "cb", F.concat_ws(",", "r", "b", "length").alias("line"))
    other = log.where(F.col("status").isin("empty", "failed")).select("stream_id", "frame_id", "crp_idx", F.lit(0).alias("kind"), F.lit(0).alias("b"), F.lit(0).alias("cb"), F.when(F.col("status") == "empty", "EMPTY***").otherwise("FAILURE").alias("line"))
    order = Window.partitionBy("stream_id", "frame_id").orderBy("crp_idx", "kind", "b", "cb")
    return blocks.unionByName(other).withColumn("line_no", F.row_number().over(order)).select("stream_id", "frame_id", "line_no", "line")


def write_logs(lines: DataFrame, path: str) -> None:
    """CSV-like text, one folder for each stream and frame, its lines in order."""
    dealt = lines.repartition("stream_id", "frame_id").sortWithinPartitions("stream_id", "frame_id", "line_no")
    dealt.select("stream_id", "frame_id", "line").write.partitionBy("stream_id", "frame_id").mode("append").text(path)


def write_frames(frames: DataFrame, path: str) -> None:
    """Ready frames with their bytes, as Parquet by stream; a frame is a row of ``blob``."""
    frames.select("stream_id", "frame_id", "blob").write.partitionBy("stream_id").mode("append").parquet(path)


def write_j2c(frames: DataFrame, folder: str) -> None:
    """Each ready frame as a file of its own, stream_id/out_NNNNN.j2c, below a folder that all executors have mounted.

    A file is written beside its name and renamed, so a task that is run again leaves whole files only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, frame, blob in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                path = Path(folder, str(stream), f"out_{frame:05d}.j2c")
                path.parent.mkdir(parents=True, exist_ok=True)
                part = path.with_suffix(f".{uuid.uuid4().hex}")
                part.write_bytes(blob or b"")
                part.replace(path)
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    frames.select("stream_id", "frame_id", "blob").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def by_kind(writers: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands the rows of each event kind to their writer, as callbacks."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for kind, write in writers.items():
                write(batch.where(F.col("kind") == kind), batch_id)
        finally:
            batch.unpersist()

    return run
