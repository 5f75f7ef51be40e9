"""What the training-data operators share: shipping, batching and packs.

A *pack* is a compressed group of whole documents written once to a shared
folder.  Multi-pass operators address documents by (pack, ordinal), so a pass
can send small keys to reducers and get the answers back by joining on the
pack, instead of moving texts with every key.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python pass turns into objects at a time.
SLICE_ROWS = 256


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    A cluster gets the package with ``--py-files`` or an image; this covers
    sessions whose workers see the driver's folder.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nulls: str = "") -> DataFrame:
    """Only the id and the text, under fixed names, so other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit(nulls)).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of few rows and about ``limit`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * limit / max(batch.nbytes, 1)) or 1))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        tidy()

    return df.mapInArrow(run, schema)


def tidy() -> None:
    """Give a task's freed memory back to the system, as Python workers live on for other stages."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a session that runs on this machine alone."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="streamloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_written: list[str] = []


def drop_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that this driver has written, but the first ``since`` and the last ``keep``; their results must have been stored."""
    jvm, end = spark.sparkContext._jvm, len(_written) - keep
    gone, _written[since:end] = _written[since:end], []
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, keep: int = 1) -> Iterator[None]:
    """Of the tables written inside, only the last ``keep`` stay; none if it fails."""
    since, left = len(_written), 0
    try:
        yield
        left = keep
    finally:
        drop_tables(spark, since, left)


#: Bytes that may be broadcast at once; what is larger, or of unknown size, is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def fits(rows: DataFrame, width: int | Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, of this many bytes each, may be broadcast; all of them are measured."""
    return (rows.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0) <= limit


def plain_size(rows: DataFrame) -> int:
    """Spark's estimate of a table's bytes, from file sizes, without reading it."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def free_name(names: list[str], wanted: str) -> str:
    """A column name that isn't taken."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    What has been written needs its shuffle files no more.  Spark's cleaner
    drops them when the driver's garbage, Python's handles first, is collected;
    that is asked for here, so that a query of several passes doesn't hold the
    files of all of them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that a pack gathers before it is closed, at least and at most; a longer text has a pack of its own.
PACK_BYTES, MAX_PACK_BYTES = 2 << 20, 32 << 20
#: Packs of a large corpus, beyond which they grow: so a key that every pack sends once stays a bounded group.
PACKS = 1 << 20


def pack_bytes(size: int) -> int:
    """The size of the packs of a corpus of this size."""
    return min(max(PACK_BYTES, size // PACKS), MAX_PACK_BYTES)


def make_packs(docs: DataFrame, name: str, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pack, size, data): whole rows, all columns, in groups ordered by ``order_col``, in the shared folder.

    ``size`` is the bytes of a pack's texts.  The table is written once, so its
    pack numbers hold for every later pass.
    """
    full = pack_bytes(plain_size(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seq, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.take(pc.sort_indices(rows, [(order_col, "ascending")])).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as w:
                w.write_table(rows)
            cols = [pa.array([first + seq], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["pack", "size", "data"])

        for b in slices(batches, limit=PACK_BYTES // 4):
            held.append(b)
            size += b.column(text_col).nbytes
            if size >= full:
                yield close()
                seq, held, size = seq + 1, [], 0
        if held:
            yield close()

    return materialize(map_arrow(docs, run, "pack long, size long, data binary"), name)


def open_pack(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return table.to_batches()[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and the n + 1 offsets of its rows; nulls are empty."""
    values = pc.fill_null(column, "").cast(pa.large_binary())
    raw, offsets = values.buffers()[2], np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_powers: dict[int, np.ndarray] = {}
#: An odd multiplier for rolling hashes, which only say what should meet: equal strings do.
BASE = 0x9E3779B97F4A7C15


def rolling(b: np.ndarray, width: int) -> np.ndarray:
    """Mixed hashes of every ``width`` neighbouring bytes, linear modulo 2**64: never a proof that two are equal."""
    n = len(b)
    if len(_powers.get(0, ())) < n + 1:
        for which, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            a = np.full(max(n + 1, 1 << 16), base, np.uint64)
            a[0] = 1
            _powers[which] = np.multiply.accumulate(a)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers[0][:n], out=total[1:])
    return mix((total[width:] - total[:-width]) * _powers[1][: n - width + 1])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Values that are hashed together, which bounds the memory that long texts take; words from LONG bytes on have a digest.
HASH_PIECE, LONG = 1 << 20, 256
_SEEDS = (np.uint64(0x632BE59BD9B4E019), np.uint64(0xA24BAED4963EE407))
_LANES = (np.uint64(1), np.uint64(0x9FB21C651E98DF25))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; the two kinds of ``which`` together are 128 bits.

    Eight bytes at a time pass through a one-to-one mixing, so words of up to
    eight bytes and one length differ for certain, and no linear relation holds
    between the hashes of longer ones.
    """
    out = np.empty(len(starts), np.uint64)
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    for lo in range(0, len(starts), HASH_PIECE):
        at, size = starts[lo : lo + HASH_PIECE], ends[lo : lo + HASH_PIECE] - starts[lo : lo + HASH_PIECE]

        def take(live: np.ndarray, k: int) -> np.ndarray:
            return (eight[at[live] + k].view("<u8").reshape(-1) & _KEEP[np.minimum(size[live] - k, 8)]) * _LANES[which]

        h = mix(mix(size.astype(np.uint64) + _SEEDS[which]) ^ take(np.arange(len(at)), 0))
        k, live = 8, np.flatnonzero((size > 8) & (size < LONG))
        while len(live):
            h[live] = mix(h[live] ^ take(live, k))
            k += 8
            live = live[size[live] > k]
        for i in np.flatnonzero(size >= LONG).tolist():
            digest = hashlib.blake2b(raw[at[i] : at[i] + size[i]], digest_size=16).digest()
            h[i] = int.from_bytes(digest[8 * which : 8 * which + 8], "little")
        out[lo : lo + len(at)] = h
    return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F))


def runs_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` neighbouring values, mixed at each doubling."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, HASH_PIECE):
        level, width, h, done = values[lo : lo + HASH_PIECE + size - 1], 1, None, 0
        m = len(level) - size + 1
        while True:
            if size & width:
                part = level[done : done + m]
                h = part if h is None else _join(h, part)
                done += width
            if width * 2 > size:
                break
            level, width = _join(level[:-width], level[width:]), width * 2
        out[lo : lo + m] = mix(h + np.uint64(size))
    return out


def pack_places(ordered: np.ndarray) -> bytes:
    """Ascending integers below 2**32: a first byte 0 and 16-bit gaps, 65535 being a step without an entry; or 1 and 32-bit places where those are shorter."""
    gaps = np.diff(ordered.astype(np.int64), prepend=0)
    steps = gaps // 65535
    if len(gaps) + int(steps.sum()) > 2 * len(gaps):
        return b"\1" + ordered.astype(np.uint32).tobytes()
    out = np.full(len(gaps) + int(steps.sum()), 65535, np.uint16)
    out[np.cumsum(steps + 1) - 1] = gaps % 65535
    return b"\0" + out.tobytes()


def unpack_places(data: bytes) -> np.ndarray:
    if data[:1] == b"\1":
        return np.frombuffer(data, np.uint32, offset=1).astype(np.int64)
    gaps = np.frombuffer(data, np.uint16, offset=1)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 65535]
