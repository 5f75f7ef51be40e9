"""Telephony audio columns: companded and ADPCM media, decoded with numpy.

Media are RIFF/WAVE containers with 8-bit mu-law or A-law samples or with IMA
ADPCM blocks.  Mu-law and A-law expand through tables of 256 samples; ADPCM
blocks are independent, so one numpy step decodes the same nibble of all
blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import id_text, map_arrow, slices

#: WAVE format tags.
ALAW, MULAW, IMA_ADPCM, PCM = 6, 7, 17, 1
CODECS = {"mulaw": MULAW, "alaw": ALAW, "adpcm": IMA_ADPCM}
RATE, UNIT = 8000, 64

#: The quantizer steps and the index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (a & 0x70) >> 4, (a & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = _mulaw_table(), _alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, size) bytes of IMA ADPCM mono blocks to (n, samples) 16-bit PCM.

    A block has its first sample (little-endian), a step index, a zero byte and
    then two nibbles a byte, low nibble first.  Indexes beyond the table are clamped.
    """
    n, size = blocks.shape
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2").astype(np.int32).reshape(n)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = head
    value = head
    for k in range(4, size):
        byte = blocks[:, k].astype(np.int32)
        for half in (0, 4):
            nib = byte >> half & 15
            step = STEPS[index]
            diff = (step >> 3) + np.where(nib & 4, step, 0) + np.where(nib & 2, step >> 1, 0) + np.where(nib & 1, step >> 2, 0)
            value = np.clip(value + np.where(nib & 8, -diff, diff), -32768, 32767)
            index = np.clip(index + INDEX_CHANGE[nib], 0, 88)
            out[2 * (k - 4) + 1 + (half == 4)] = value
    return out.T


def resample(pcm: np.ndarray, up: int = 2) -> np.ndarray:
    """Linear interpolation to ``up`` times the rate; the last sample is held."""
    x = pcm.astype(np.int32)
    after = np.append(x[1:], x[-1:])
    return np.stack([(x * (up - k) + after * k) // up for k in range(up)], axis=1).reshape(-1).astype(np.int16)


def wave(data: bytes, tag: int, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of one channel around the coded bytes."""
    if tag == IMA_ADPCM:
        per_block = 1 + 2 * (UNIT - 4)
        fmt = struct.pack("<HHIIHHHH", tag, 1, rate, rate * UNIT // per_block, UNIT, 4, 2, per_block)
        samples = len(data) // UNIT * per_block
    else:
        width = 2 if tag == PCM else 1
        fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * width, width, 8 * width, 0)
        samples = len(data) // width
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and coded bytes; ValueError for what is no such file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def expand(tag: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return MULAW_TABLE[raw]
    if tag == ALAW:
        return ALAW_TABLE[raw]
    if tag == IMA_ADPCM:
        return decode_adpcm(raw.reshape(-1, UNIT)).reshape(-1)
    if tag == PCM:
        return np.frombuffer(data, "<i2")
    raise ValueError(f"format tag {tag}")


def codec_of(payload: bytes) -> int:
    """The codec that a payload is stored with: by its checksum, so equal payloads agree."""
    return (MULAW, ALAW, IMA_ADPCM)[zlib.crc32(payload) % 3]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str | None = None) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as the samples of a telephony file.

    The UTF-8 bytes, padded with 0 to a positive multiple of 64, are the coded
    samples (or ADPCM blocks) themselves, so nothing is lost.  Null and empty
    text: 64 zero bytes.  ``codec`` fixes one codec; else the payload's checksum
    picks it.  Repeated rows give repeated rows.
    """
    fixed = CODECS[codec] if codec else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, media = [], []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                sizes.append(len(raw))
                payload = raw + bytes((-len(raw)) % UNIT or (0 if raw else UNIT))
                media.append(wave(payload, fixed or codec_of(payload)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, media binary")


def _features(tag: int, pcm: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"tag={tag};n={len(x)};peak={int(np.abs(x).max())};power={int((x * x).sum()) // len(x)};mean={int(x.sum()) // len(x)};zc={crossings}"


def read(media: DataFrame, up: int = 2, pcm: bool = False) -> DataFrame:
    """Read stored files back: the payload, and features of the samples in the resampled PCM file.

    With ``pcm`` that file comes along.  All ADPCM blocks of a slice are decoded
    together.  Null media give null columns, repeated rows repeated rows, and no
    rows none; a file of any length is one row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            files = [read_wave(m) if m is not None else None for m in b.column("media").to_pylist()]
            coded = [f[2] for f in files if f and f[0] == IMA_ADPCM]
            together = decode_adpcm(np.frombuffer(b"".join(coded), np.uint8).reshape(-1, UNIT)) if coded else None
            at, payloads, feats, pcms = 0, [], [], []
            for f in files:
                if f is None:
                    payloads.append(None), feats.append(None), pcms.append(None)
                    continue
                tag, rate, data = f
                if tag == IMA_ADPCM:
                    n = len(data) // UNIT
                    samples = together[at : at + n].reshape(-1)
                    at += n
                else:
                    samples = expand(tag, data)
                stored = wave(resample(samples, up).astype("<i2").tobytes(), PCM, rate * up)
                payloads.append(data)
                feats.append(_features(tag, expand(*read_wave(stored)[::2])))
                pcms.append(stored if pcm else None)
            cols = [b.column(0), b.column("n_bytes"), b.column("media"), pa.array(payloads, pa.binary()), pa.array(feats, pa.string())]
            names = ["doc_id", "n_bytes", "media", "payload", "feature"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(pcms, pa.binary())] * pcm, names=names + ["pcm"] * pcm)

    schema = "doc_id long, n_bytes long, media binary, payload binary, feature string" + ", pcm binary" * pcm
    return map_arrow(media.select("doc_id", "n_bytes", "media"), run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The digest columns of every document's stored and reread media, and of the PCM file stored from it."""
    back = read(store(docs), pcm=True)
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"))
