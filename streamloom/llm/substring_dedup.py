"""Substring deduplication of word windows with a count-min prefilter.

Pass one: every pack of documents adds its windows to count-min sketch rows
that are cut into ranges of cells; the ranges are merged and tell each pack
which of its windows hit only cells of count two or more.  A sketch never
underestimates, so no repeated window is lost.  Pass two: only those windows
are grouped, by 128-bit digests of their words, and all but the first of a
group removed.

All rows have the pack they belong to, and packs send a window once.  Packs and
ranges grow with the corpus, so a hot passage is one entry of each of at most
a few million packs, 28 bytes a window, and its windows are dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import make_packs, map_arrow, materialize, mix, open_pack, pack_places, runs_hash, text_bytes, unpack_places, words_hash

WINDOW, DEPTH = 20, 2
#: Cells of a sketch row for each window.
CELLS_EACH = 4
#: Cells of a range, which is one reducer's share, as powers of two: the least, the most, and the ranges from which it grows.
RANGE_BITS, MAX_RANGE_BITS, RANGES = 24, 28, 1 << 14
BIG = np.iinfo(np.int64).max


def find_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document ordinals of the words; no word crosses a document."""
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    step = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(starts):
        # A document's end inside a run of word bytes ends the word there.
        cuts = offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
        cuts = cuts[inside[cuts - 1] & inside[cuts]]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class Windows:
    """The words of a pack and the windows of ``size`` of them."""

    def __init__(self, batch: pa.RecordBatch, id_col: str, text_col: str, size: int):
        self.batch, self.size = batch, size
        raw, self.offsets = text_bytes(batch.column(text_col))
        self.raw = raw
        self.starts, self.ends, self.doc = find_words(raw, self.offsets)
        n = len(self.starts)
        self.at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :]) if n >= size else np.zeros(0, np.int64)
        ids = batch.column(id_col)
        self.ids = np.array([BIG if x is None else x for x in ids.to_pylist()], np.int64)

    def hashes(self, at: np.ndarray, which: int = 0) -> np.ndarray:
        return runs_hash(words_hash(self.raw, self.starts, self.ends, which), self.size)[at]

    def covered(self, at: np.ndarray) -> np.ndarray:
        """Which words the windows at these places cover."""
        step = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + self.size, -1)
        return np.cumsum(step[:-1]) > 0


def _cells(h: np.ndarray, row: int, ranges: int, bits: int) -> np.ndarray:
    return (mix(h + np.uint64(0x632BE59BD9B4E019 * (row + 1) & (2**64 - 1))) % np.uint64(ranges << bits)).astype(np.int64)


def _parts(order: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of one part in an order that sorts by part."""
    sorted_parts = part[order]
    cuts = np.flatnonzero(np.diff(sorted_parts)) + 1
    for piece in np.split(order, cuts):
        if len(piece):
            yield int(part[piece[0]]), piece


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


PART = pa.schema([("part", pa.int64()), ("pack", pa.int64()), ("data", pa.binary())])
ANSWER = pa.schema([("part", pa.int64()), ("pack", pa.int64()), ("data", pa.binary())])
SCHEMA = "part long, pack long, data binary"
#: First bytes of rows for reducers: to be solved, or an answer already.
GLOBAL, LOCAL = b"\0", b"\1"


def _sketch(packs: DataFrame, id_col: str, text_col: str, size: int, ranges: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, data in zip(b.column("pack").to_pylist(), b.column("data"), strict=True):
                w = Windows(open_pack(data.as_py()), id_col, text_col, size)
                if not len(w.at):
                    continue
                h = w.hashes(w.at)
                rows = []
                for row in range(DEPTH):
                    cells = np.sort(_cells(h, row, ranges, bits))
                    part = cells >> bits
                    for k, own in _parts(np.arange(len(cells)), part):
                        rows.append((row * ranges + k, pack, pack_places(cells[own] & ((1 << bits) - 1))))
                yield _rows(rows, PART)

    return map_arrow(packs, run, SCHEMA)


def _merge_sketches(bits: int):
    def run(table: pa.Table) -> pa.Table:
        """Counts of one range, up to two, from all packs; each pack's entries are answered bit by bit."""
        once, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        data = table.column("data").to_pylist()
        for d in data:
            cells = unpack_places(d)
            twice[cells[once[cells]]] = True
            twice[cells[1:][cells[1:] == cells[:-1]]] = True
            once[cells] = True
        answers = [np.packbits(twice[unpack_places(d)]).tobytes() for d in data]
        return pa.Table.from_arrays([table.column("part"), table.column("pack"), pa.array(answers, pa.binary())], schema=ANSWER)

    return run


def _with_answers(packs: DataFrame, answers: DataFrame) -> DataFrame:
    found = answers.groupBy("pack").agg(F.collect_list(F.struct("part", "data")).alias("answers"))
    return packs.join(found, "pack", "left")


def _repeated(w: Windows, answers: list[dict], ranges: int, bits: int) -> np.ndarray:
    """The windows all of whose cells count two or more."""
    by = {a["part"]: a["data"] for a in answers}
    h = w.hashes(w.at)
    keep = np.ones(len(h), bool)
    for row in range(DEPTH):
        cells = _cells(h, row, ranges, bits)
        order = np.argsort(cells, kind="stable")
        hit = np.zeros(len(h), bool)
        for k, own in _parts(order, cells >> bits):
            hit[own] = np.unpackbits(np.frombuffer(by[row * ranges + k], np.uint8), count=len(own)).astype(bool)
        keep &= hit
    return w.at[keep]


def _candidates(packs: DataFrame, id_col: str, text_col: str, size: int, ranges: int, bits: int) -> DataFrame:
    """Rows for the exact grouping; LOCAL ones have the windows that an earlier one of the same pack removes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, data, answers in zip(b.column("pack").to_pylist(), b.column("data"), b.column("answers").to_pylist(), strict=True):
                if not answers:
                    continue
                w = Windows(open_pack(data.as_py()), id_col, text_col, size)
                at = _repeated(w, answers, ranges, bits)
                if not len(at):
                    continue
                key = np.empty(len(at), [("a", np.uint64), ("b", np.uint64)])
                key["a"], key["b"] = w.hashes(at), w.hashes(at, 1)
                order = np.lexsort((at, key["b"], key["a"]))  # packs are in document order, so places are too
                same = np.append(False, key[order][1:] == key[order][:-1])
                rows = []
                if same.any():
                    rows.append((pack % ranges, pack, LOCAL + np.sort(at[order[same]]).astype(np.uint32).tobytes()))
                first = order[~same]
                part = (key["a"][first] % np.uint64(ranges)).astype(np.int64)
                for k, own in _parts(np.argsort(part, kind="stable"), part):
                    i = np.sort(first[own])  # by place: equal ids stand together, and the shuffle compresses them
                    rows.append((k, pack, b"".join([GLOBAL, key["a"][i].tobytes(), key["b"][i].tobytes(), w.ids[w.doc[at[i]]].tobytes(), at[i].astype(np.uint32).tobytes()])))
                yield _rows(rows, PART)

    return map_arrow(packs, run, SCHEMA)


def local_answers(table: pa.Table) -> tuple[list[tuple], list[int], list[bytes]]:
    """What packs have found out by themselves passes through; the other rows are left to solve."""
    rows, packs, data = [], [], []
    for p, d in zip(table.column("pack").to_pylist(), table.column("data").to_pylist(), strict=True):
        if d[:1] == LOCAL:
            rows.append((0, p, d[1:]))
        else:
            packs.append(p)
            data.append(d)
    return rows, packs, data


def _first_only(table: pa.Table) -> pa.Table:
    """Of each exact group all entries but the first by document go back to their packs."""
    rows, packs, data = local_answers(table)
    if not packs:
        return pa.Table.from_batches([_rows(rows, ANSWER)], schema=ANSWER)
    n = [len(d) // 28 for d in data]
    a, b, ids, at = (np.concatenate([np.frombuffer(d, t, m, 1 + at_ * m) for d, m in zip(data, n, strict=True)]) for t, at_ in ((np.uint64, 0), (np.uint64, 8), (np.int64, 16), (np.uint32, 24)))
    of = np.repeat(np.array(packs, np.int64), n)
    order = np.lexsort((of, ids, b, a))
    a, b = a[order], b[order]
    later = order[np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1]))]
    rows += [(0, p, np.sort(at[own]).tobytes()) for p, own in _parts(later[np.argsort(of[later], kind="stable")], of)]
    return pa.Table.from_batches([_rows(rows, ANSWER)] if rows else [], schema=ANSWER)


def removed_windows(packs: DataFrame, id_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """(part, pack, data): word places of the windows that start earlier elsewhere."""
    # Windows are as many as words, of about five bytes each; the estimate only sets the sketch's size.
    cells = (packs.agg(F.sum("size")).first()[0] or 0) // 5 * CELLS_EACH
    bits = min(max(RANGE_BITS, (cells // RANGES).bit_length()), MAX_RANGE_BITS)
    ranges = max(1, -(-cells >> bits))
    answers = materialize(_sketch(packs, id_col, text_col, size, ranges, bits).groupBy("part").applyInArrow(_merge_sketches(bits), SCHEMA), "sketch")
    found = _candidates(_with_answers(packs, answers), id_col, text_col, size, ranges, bits)
    return found.groupBy("part").applyInArrow(_first_only, SCHEMA)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """All columns of all rows, with ``kept`` (text), ``n_words`` and ``n_removed`` added.

    A word goes if a window of ``size`` words that covers it also starts
    earlier: in a document of a smaller id, or before it in the same document.
    Windows are judged on the input.  Null and empty texts have no words; texts
    shorter than a window keep all.  Rows of the same id are ordered by where
    they are stored; null ids come last.  Input columns of the new names are
    replaced.
    """
    docs = docs.drop("kept", "n_words", "n_removed")
    packs = make_packs(docs, "packs", id_col, text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["kept string", "n_words long", "n_removed long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, answers in zip(b.column("data"), b.column("answers").to_pylist(), strict=True):
                batch = open_pack(data.as_py())
                w = Windows(batch, id_col, text_col, size)
                at = [np.frombuffer(a["data"], np.uint32).astype(np.int64) for a in answers or []]
                gone = w.covered(np.concatenate(at)) if at else np.zeros(len(w.starts), bool)
                yield pa.RecordBatch.from_arrays(list(batch.columns) + [kept_texts(w, gone), *counts(w, gone)], names=[*batch.schema.names, "kept", "n_words", "n_removed"])

    return map_arrow(_with_answers(packs, removed_windows(packs, id_col, text_col, size)), run, schema)


def counts(w: Windows, gone: np.ndarray) -> list[pa.Array]:
    n = len(w.offsets) - 1
    return [pa.array(np.bincount(w.doc, minlength=n).astype(np.int64)), pa.array(np.bincount(w.doc[gone], minlength=n).astype(np.int64))]


def kept_texts(w: Windows, gone: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    s, e, doc = w.starts[~gone], w.ends[~gone], w.doc[~gone]
    sizes = e - s
    # Bytes of all kept words, each with a space before it unless it is its document's first.
    gap = np.append(0, (doc[1:] == doc[:-1]).astype(np.int64)) if len(s) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes + gap)
    out = np.full(int(ends[-1]) if len(s) else 0, 32, np.uint8)
    to = np.repeat(ends - sizes - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    source = np.repeat(s - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out[to] = w.raw[source]
    offsets = np.append(0, np.cumsum(np.bincount(doc, weights=sizes + gap, minlength=len(w.offsets) - 1))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())


def digest(docs: DataFrame) -> DataFrame:
    """n_words, n_removed and the kept words' hash of every row of ``documents``; null and empty text: 0, 0 and the hash of nothing."""
    rows = deduplicate(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i+19], ' ') ORDER BY doc_id, i) AS k FROM p),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 20)))) AS gone FROM h WHERE k > 1 GROUP BY doc_id),
r AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS m, list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM r"""
