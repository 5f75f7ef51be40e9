"""Removal of long byte strings that occur again, from merged Burrows-Wheeler transforms.

Shards.  Two equal windows have the same least gram hash inside, so each window
is dealt to the range of its least hash, together with all windows that could
equal it.  Windows whose least hash occurs once in the corpus are done; runs of
the others go to their range as short regions.

Merging.  In a range every source pack's regions form a shard, whose suffixes
are sorted among themselves only and give its transform.  The shards'
transforms are merged by iterative interleave refinement: an interleave of
shard numbers is dealt again by the symbol before each suffix, stably.  A
boundary that appears in round k has a common prefix of k - 1 symbols, which
gives the merged common-prefix array; its intervals are the repeats.  Symbols
are the ranks of blocks of ``BLOCK`` bytes, so a round advances by that many
bytes.  Nothing but the interleave tells whether suffixes of two shards agree.

A least hash that occurs very often would make a range large.  Its windows are
first counted by a hash of themselves, which loses none that is repeated; the
regions of the counted ones are made distinct before they are merged like all
others, so a passage that a third of the corpus has is merged once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import make_packs, map_arrow, materialize, mix, open_pack, rolling, text_bytes
from streamloom.llm.substring_dedup import ANSWER, PART, SCHEMA, _parts, _rows, _with_answers

LENGTH, GRAM, BLOCK = 400, 64, 100
#: A passage of about 50 words, whose repeats are reported beside those that are removed.
SHORTER = 300
#: Occurrences of a least hash from which windows are counted before they are sent.
HOT = 1024
#: Bytes of regions, and hashes, that a range should have.
RANGE_BYTES, RANGE_HASHES = 2 << 20, 2 << 20
#: Windows of a document that are looked at together.
PIECE = 1 << 20
#: Windows that are hashed at once, so that what is computed of them stays in a core's cache.
STEP = 1 << 14
#: Kinds of answers: starts of repeats of LENGTH bytes, of SHORTER bytes, and windows to look at again.
REMOVED, REPORTED, AGAIN = 0, 1, 2


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    fn, have = np.minimum if least else np.maximum, 1
    while have < width:
        step = min(have, width - have)
        x, have = fn(x[: len(x) - step], x[step:]), have + step
    return x


def _runs(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one least hash, each of one document: starts, ends, hashes; and the hashes of all places that are least somewhere.

    The documents lie end to end and are looked at STEP windows at a time; runs
    that a step cuts are joined again, so the result doesn't depend on it.
    """
    n, width = len(raw) - length + 1, length - gram + 1
    lo, hi = offsets[:-1], offsets[1:] - length + 1
    lo, hi = lo[hi > lo], hi[hi > lo]
    inside, opens = np.zeros(len(raw) + 1, np.int8), np.zeros(len(raw) + 1, bool)
    np.add.at(inside, lo, 1)
    np.add.at(inside, hi, -1)
    inside = np.cumsum(inside, dtype=np.int8) > 0
    # A run begins with its document and, so that regions stay bounded, with every piece of a long one.
    pieces = -(-(hi - lo) // PIECE)
    opens[np.repeat(lo, pieces) + PIECE * _flat(np.zeros(len(lo), np.int64), pieces)] = True
    opens[hi] = True
    pad = np.zeros(width - 1, np.uint64)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for at in range(0, n, STEP):
        h = rolling(raw[at : min(at + STEP, n) + length - 1], gram)
        least = _sliding(h, width, True)
        within = inside[at : at + len(least)]
        begins = np.flatnonzero(np.append(True, least[1:] != least[:-1]) | opens[at : at + len(least)])
        ends, live = np.append(begins[1:], len(least)), within[begins]
        begins, ends = begins[live], ends[live]
        values = least[begins]
        least[~within] = 0
        # A place is least in some window if the largest of its windows' minima is its own hash.
        places = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, False) == h)
        parts.append((begins + at, ends + at, values, places + at, h[places]))
    starts, ends, values, places, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.append(True, (starts[1:] != ends[:-1]) | (values[1:] != values[:-1]) | opens[starts[1:]])[: len(starts)]
    last = np.append(first[1:], True)[: len(starts)]
    # Steps overlap by a window, and a place is one.
    return starts[first], ends[last], values[first], hashes[np.unique(places, return_index=True)[1]]


class Pack:
    """The runs of all documents of a pack; places are bytes of the pack."""

    def __init__(self, batch: pa.RecordBatch, text_col: str, length: int, gram: int):
        self.raw, self.offsets = text_bytes(batch.column(text_col))
        self.starts, self.ends, self.least, self.places = _runs(self.raw, self.offsets, length, gram)

    def regions(self, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and bytes of the regions of runs of starts: to ``length`` bytes past the last start, within the document."""
        sizes = self.sizes(starts, ends, length)
        return sizes, self.raw[_flat(starts, sizes)]

    def sizes(self, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
        stop = self.offsets[np.searchsorted(self.offsets, starts, side="right")]
        return np.minimum(ends - 1 + length, stop) - starts


def _opened(batches: Iterator[pa.RecordBatch], text_col: str, shorter: int, gram: int) -> Iterator[tuple[int, Pack, list[dict]]]:
    for b in batches:
        answers = b.column("answers").to_pylist() if "answers" in b.schema.names else [None] * b.num_rows
        for pack, data, found in zip(b.column("pack").to_pylist(), b.column("data"), answers, strict=True):
            if found or "answers" not in b.schema.names:
                yield pack, Pack(open_pack(data.as_py()), text_col, shorter, gram), found or []


def _anchors(packs: DataFrame, text_col: str, shorter: int, gram: int, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, p, _ in _opened(batches, text_col, shorter, gram):
            values, counts = np.unique(p.places, return_counts=True)
            if len(values):
                part = (values % np.uint64(ranges)).astype(np.int64)
                yield _rows([(k, pack, values[i].tobytes() + counts[i].astype(np.uint32).tobytes()) for k, i in _parts(np.argsort(part, kind="stable"), part)], PART)

    return map_arrow(packs.select("pack", "data"), run, SCHEMA)


def _count_anchors(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """For every pack's hashes of this range 0: once in the corpus, 1: again, 2: very often."""
        data = table.column("data").to_pylist()
        n = [len(d) // 12 for d in data]
        values = np.concatenate([np.frombuffer(d, np.uint64, m) for d, m in zip(data, n, strict=True)])
        counts = np.concatenate([np.frombuffer(d, np.uint32, m, 8 * m) for d, m in zip(data, n, strict=True)])
        _, place = np.unique(values, return_inverse=True)
        total = np.bincount(place, weights=counts)[place]
        kind = ((total > 1).astype(np.uint8) + (total > hot)).astype(np.uint8)
        again = np.split(np.stack([values, kind.astype(np.uint64)], axis=1), np.cumsum(n)[:-1])
        out = [(0, p, x[x[:, 1] > 0].T.tobytes()) for p, x in zip(table.column("pack").to_pylist(), again, strict=True) if (x[:, 1] > 0).any()]
        return pa.Table.from_batches([_rows(out, ANSWER)] if out else [], schema=ANSWER)

    return run


def _spans(starts: np.ndarray) -> bytes:
    """Ascending window starts as runs: begins, then ends."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return np.concatenate([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + 1]).astype(np.uint32).tobytes() if len(starts) else b""


def _from_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    begins, ends = np.frombuffer(data, np.uint32).reshape(2, -1).astype(np.int64)
    return begins, ends


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1 and so on, sizes[i] of them, for every i."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


#: Columns of regions: least hash, start, number of starts, size, bytes; and of frequent windows: hash, times, places.
REGIONS, WINDOWS = ("<u8", "<u4", "<u4", "<u4", "u1"), ("<u8", "<u4", "<u4")


def _columns(kinds: tuple[str, ...], *columns: np.ndarray) -> bytes:
    """Columns of these kinds end to end, after their lengths."""
    return b"".join([np.array([len(c) for c in columns], "<u8").tobytes(), *(c.astype(k, copy=False).tobytes() for k, c in zip(kinds, columns, strict=True))])


def _from_columns(kinds: tuple[str, ...], data: bytes) -> list[np.ndarray]:
    out, at = [], 8 * len(kinds)
    for kind, n in zip(kinds, np.frombuffer(data, "<u8", len(kinds)).tolist(), strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def _regions(packs: DataFrame, text_col: str, length: int, shorter: int, gram: int, ranges: int) -> DataFrame:
    """Regions of repeated hashes by range; with part >= ranges, hashes of the windows of frequent ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for pack, p, answers in _opened(batches, text_col, shorter, gram):
            known = np.concatenate([np.frombuffer(a["data"], np.uint64).reshape(2, -1) for a in answers], axis=1)
            known = known[:, np.argsort(known[0])]
            at = np.minimum(np.searchsorted(known[0], p.least), known.shape[1] - 1)
            kind = np.where(known[0][at] == p.least, known[1][at], 0)
            rows = []
            i = np.flatnonzero(kind == 1)
            part = (mix(p.least[i]) % np.uint64(ranges)).astype(np.int64)
            i = i[np.argsort(part, kind="stable")]
            part = np.sort(part)
            s, e, v = p.starts[i], p.ends[i], p.least[i]
            sizes = p.sizes(s, e, length)
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
            for k, lo, hi in zip(part[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(part)).tolist(), strict=False):
                text = p.raw[_flat(s[lo:hi], sizes[lo:hi])]
                rows.append((k, pack, zip_.compress(_columns(REGIONS, v[lo:hi], s[lo:hi], (e - s)[lo:hi], sizes[lo:hi], text))))
            i = np.flatnonzero(kind == 2)
            if len(i):
                w = np.sort(_flat(p.starts[i], p.ends[i] - p.starts[i]))
                # Frequent windows, here or elsewhere, are one entry of a pack with the number of times.
                key, place, times = np.unique(_window_hashes(p.raw, w, shorter), return_inverse=True, return_counts=True)
                order = np.argsort(place, kind="stable")
                first = np.cumsum(times) - times
                part = (mix(key) % np.uint64(ranges)).astype(np.int64)
                for k, own in _parts(np.argsort(part, kind="stable"), part):
                    here = w[order[_flat(first[own], times[own])]]
                    rows.append((ranges + k, pack, zip_.compress(_columns(WINDOWS, key[own], times[own], here))))
            if rows:
                yield _rows(rows, PART)

    return map_arrow(packs, run, SCHEMA)


def _window_hashes(raw: np.ndarray, w: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at ascending places; they only say which may be equal."""
    out = np.empty(len(w), np.uint64)
    cuts = np.append(np.searchsorted(w, np.arange(0, len(raw) + 1, PIECE)), len(w))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if lo < hi:
            out[lo:hi] = rolling(raw[w[lo] : w[hi - 1] + length], length)[w[lo:hi] - w[lo]]
    return out


def _again(packs: DataFrame, text_col: str, length: int, shorter: int, gram: int) -> DataFrame:
    """(key, least, starts, text, pack, spans): the distinct regions of counted windows of each pack; spans are where they begin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, p, answers in _opened(batches, text_col, shorter, gram):
            marked = np.zeros(len(p.raw) + 1, bool)
            for a in answers:
                for lo, hi in zip(*(x.tolist() for x in _from_spans(a["data"])), strict=True):
                    marked[lo:hi] = True
            w = np.flatnonzero(marked)
            run_of = np.searchsorted(p.starts, w, side="right") - 1
            new = np.append(True, (w[1:] != w[:-1] + 1) | (run_of[1:] != run_of[:-1]))
            s, e = w[new], w[np.append(np.flatnonzero(new)[1:] - 1, len(w) - 1)] + 1
            least, found = p.least[run_of[new]], {}
            sizes, text = p.regions(s, e, length)
            ends = np.cumsum(sizes)
            for k, (lo, hi, m) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), (e - s).tolist(), strict=True)):
                found.setdefault((m, text[lo:hi].tobytes()), []).append(k)
            rows = [(hashlib.blake2b(t, digest_size=16, salt=m.to_bytes(8, "little")).digest(), int(least[k[0]].view(np.int64)), m, t, pack, s[k].astype(np.uint32).tobytes()) for (m, t), k in found.items()]
            yield _rows(rows, AGAIN_ROWS)

    return map_arrow(packs, run, "key binary, least long, starts long, text binary, pack long, places binary")


AGAIN_ROWS = pa.schema([("key", pa.binary()), ("least", pa.int64()), ("starts", pa.int64()), ("text", pa.binary()), ("pack", pa.int64()), ("places", pa.binary())])


def _deal(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by non-negative integers up to ``top``, and these in order: they are sorted with their places below them."""
    if max(top, len(key)) >= 1 << 32:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = key.astype(np.uint64)
    both <<= np.uint64(32)
    both |= np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & np.uint64(0xFFFFFFFF)).view(np.int64), (both >> np.uint64(32)).view(np.int64)


def block_ranks(padded: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Numbers from 0 of the blocks at these places: equal exactly for equal bytes.

    A hash groups the blocks and their bytes prove it; blocks that a hash
    confuses are told apart by their bytes.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    h = rolling(padded, block)[at]
    order = np.argsort(h)
    new = np.append(True, h[order[1:]] != h[order[:-1]])
    number = np.cumsum(new) - 1
    rank = np.empty(len(at), np.int64)
    rank[order] = number
    several = np.flatnonzero(~new)
    own, like = at[order[several]], at[order[np.flatnonzero(new)[number[several]]]]
    if block < 8:
        same = all((padded[own + k] == padded[like + k]).all() for k in range(block))
    else:
        eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([padded, np.zeros(8, np.uint8)]), 8)
        words = np.ascontiguousarray(eight).view("<u8").reshape(-1)
        same = all((words[own + k] == words[like + k]).all() for k in [*range(0, block - 7, 8), block - 8])
    if same:
        return rank
    rows = np.lib.stride_tricks.sliding_window_view(padded, block)[at]
    return np.unique(np.ascontiguousarray(rows).view(f"V{block}").reshape(-1), return_inverse=True)[1].reshape(-1).astype(np.int64)


class Shards:
    """The regions of a range as strings over blocks: region r has one string for each residue of the block size.

    A suffix is a byte of a region, followed by what is a block on; each string
    ends in an empty suffix.  Of a region of which only the first ``starts``
    suffixes are asked for, the strings without any of them are left out.  Rows
    are a region's suffixes in their order, and shards must be ascending.
    """

    def __init__(self, texts: np.ndarray, sizes: np.ndarray, shard: np.ndarray, block: int, starts: np.ndarray | None = None):
        strings = np.full(len(sizes), block) if starts is None else np.minimum(starts, block)
        # Block by block, the places of those strings, up to the one past the region.
        pieces = sizes // block + 1
        of = np.repeat(np.arange(len(sizes)), pieces)
        place = _flat(np.zeros(len(sizes), np.int64), pieces) * block
        width = np.minimum(strings[of], sizes[of] + 1 - place)
        at = _flat((np.cumsum(sizes) - sizes)[of] + place, width)
        rows = np.bincount(of, weights=width, minlength=len(sizes)).astype(np.int64)
        self.first = np.cumsum(rows) - rows
        live = at + block <= np.repeat(np.cumsum(sizes), rows)
        # Rank 0: the empty suffix and whatever has less than a block left; their order doesn't matter.
        self.symbol = np.zeros(len(at), np.int64)
        self.symbol[live] = block_ranks(texts, at[live], block) + 1
        self.shard, self.alphabet = np.repeat(shard, rows), int(self.symbol.max(initial=0))
        # The row before each in its string; before a first one stands an empty one, which has no symbol.
        self.before = np.full(len(at), -1)
        from_ = np.flatnonzero(live)
        self.before[from_ + np.repeat(strings, rows)[from_]] = from_
        self.before[self.before < 0] = np.flatnonzero(~live)

    def sort(self, rounds: int) -> np.ndarray:
        """Every shard's own suffix array by ``rounds`` symbols, one after the other.

        Rows are dealt by their first symbol in the order of what follows it.
        All keys begin with the shard's number, so suffixes of two shards are
        never compared by their symbols.
        """
        key, order = self.shard * (self.alphabet + 1) + self.symbol, np.arange(len(self.symbol))
        top = int(key.max(initial=0))
        for _ in range(rounds):
            order = self.before[order]
            order = order[_deal(key[order], top)[0]]
        return order


def interleave(before: np.ndarray, shard_of: np.ndarray, alphabet: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: (take, common), the merged order of their rows and the symbols that each row shares with the one before it.

    ``before`` are the transforms end to end and ``shard_of`` their shards.
    Round k refines an interleave by k - 1 symbols to one by k; intervals keep
    their places while they are divided, so a boundary's round is its common
    prefix plus one.  ``common`` is at most ``rounds``.
    """
    n = len(before)
    take, interval, common = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    # A shard's dealt rows are its own in order, so where each of them goes is told by its own transform.
    own, _ = _deal(shard_of * (alphabet + 1) + before, int(shard_of.max(initial=0)) * (alphabet + 1) + alphabet)
    goes = np.empty(n, np.int64)
    goes[own] = np.arange(n)
    for _ in range(rounds):
        deal, c = _deal(before[take], alphabet)
        source, take = interval[deal], goes[take[deal]]
        # All rows without a symbol before them are equal.
        new = source[1:] != source[:-1]
        new &= c[1:] != 0
        new |= c[1:] != c[:-1]
        # A boundary stays one in all later rounds.
        common[1:] += ~new
        interval[1:] = np.cumsum(new)
    return take, common


def merge_transforms(shards: Shards, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged suffix array and its common prefixes in symbols, from the shards' own transforms."""
    order = shards.sort(rounds)
    # The transform: the symbol before each suffix; a string's first suffix has none and stands for its empty one.
    take, common = interleave(shards.symbol[shards.before[order]], shards.shard[order], shards.alphabet, rounds)
    return order[take], common


def repeated_starts(least: np.ndarray, m: np.ndarray, sizes: np.ndarray, text: np.ndarray, copies: np.ndarray, shard: np.ndarray, length: int, shorter: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For the starts of distinct regions, m of each: whether their strings of ``length`` and of ``shorter`` bytes occur again.

    A region occurs ``copies`` times.  Those of a least hash of which each
    occurs again are repeated intervals by themselves and aren't transformed.
    """
    at, ends = np.cumsum(sizes) - sizes, np.cumsum(m)
    # A string of the full length must lie in the document.
    room = np.repeat(sizes, m) - (np.arange(int(m.sum())) - np.repeat(ends - m, m)) >= length
    short = np.repeat(copies > 1, m)
    long = short & room
    _, group = np.unique(least, return_inverse=True)
    i = np.flatnonzero(np.bincount(group, weights=copies == 1)[group] > 0)
    if len(i):
        i = i[np.argsort(shard[i], kind="stable")]
        _, number = np.unique(shard[i], return_inverse=True)
        s = Shards(text[_flat(at[i], sizes[i])], sizes[i], number, block, m[i])
        suffix, common = merge_transforms(s, length // block)
        starts, to = _flat(s.first, m[i]), _flat(ends[i] - m[i], m[i])
        weight = np.repeat(copies[i], m[i])
        place = np.empty(len(suffix), np.int64)
        place[suffix] = np.arange(len(suffix))
        for n, out, counted in ((shorter, short, np.ones(len(to), bool)), (length, long, room[to])):
            which = np.cumsum(common < n // block)[place[starts]]
            out[to] = counted & (np.bincount(which, weights=weight * counted)[which] > 1)
    return long, short


def _merge_regions(packs: list[int], data: list[bytes], length: int, shorter: int, block: int) -> list[tuple]:
    unzip = zstandard.ZstdDecompressor()
    parts = [_from_columns(REGIONS, unzip.decompress(d)) for d in data]
    least = np.concatenate([x[0] for x in parts])
    start, m, sizes = (np.concatenate([x[k] for x in parts]).astype(np.int64) for k in (1, 2, 3))
    text = np.concatenate([x[4] for x in parts])
    pack = np.repeat(np.arange(len(packs)), [len(x[0]) for x in parts])
    ends = np.cumsum(sizes)
    # Equal regions are one, with the number of times it occurs.
    known: dict[tuple, int] = {}
    same = np.array([known.setdefault((k, text[lo:hi].tobytes()), len(known)) for k, lo, hi in zip(m.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True)], np.int64)
    _, first, copies = np.unique(same, return_index=True, return_counts=True)
    at = ends - sizes
    long, short = repeated_starts(least[first], m[first], sizes[first], text[_flat(at[first], sizes[first])], copies, pack[first], length, shorter, block)
    out = []
    for kind, hit in ((REMOVED, long), (REPORTED, short)):
        begins, lengths, per = _hit_runs(hit, m[first])
        # Every occurrence of a region has the runs of the distinct one.
        n = per[same]
        which = _flat((np.cumsum(per) - per)[same], n)
        lo = np.repeat(start, n) + begins[which]
        hi, cuts = lo + lengths[which], np.searchsorted(np.repeat(pack, n), np.arange(len(packs) + 1)).tolist()
        spans = lo.astype(np.uint32), hi.astype(np.uint32)
        out += [(kind, p, spans[0][a:b].tobytes() + spans[1][a:b].tobytes()) for p, a, b in zip(packs, cuts[:-1], cuts[1:], strict=True) if a < b]
    return out


def _hit_runs(hit: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true flags of regions, m flags of each: their begins in the region, their lengths, and how many a region has."""
    heads = np.cumsum(m) - m
    new = np.append(True, ~hit[:-1])[: len(hit)]
    new[heads[m > 0]] = True
    at = np.flatnonzero(new & hit)
    last = np.append(new[1:] | ~hit[1:], True)[: len(hit)]
    of = np.searchsorted(heads, at, side="right") - 1
    return at - heads[of], np.flatnonzero(last & hit) + 1 - at, np.bincount(of, minlength=len(m))


def _count_windows(packs: list[int], data: list[bytes]) -> list[tuple]:
    unzip = zstandard.ZstdDecompressor()
    parts = [_from_columns(WINDOWS, unzip.decompress(d)) for d in data]
    key, times = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]).astype(np.int64)
    _, place = np.unique(key, return_inverse=True)
    again = np.bincount(place, weights=times)[place] > 1
    out, lo = [], 0
    for p, x in zip(packs, parts, strict=True):
        found = np.sort(x[2].astype(np.int64)[np.repeat(again[lo : lo + len(x[0])], x[1])])
        lo += len(x[0])
        if len(found):
            out.append((AGAIN, p, _spans(found)))
    return out


def _solve(ranges: int, length: int, shorter: int, block: int):
    def run(table: pa.Table) -> pa.Table:
        packs, data = table.column("pack").to_pylist(), table.column("data").to_pylist()
        out = _merge_regions(packs, data, length, shorter, block) if table.column("part")[0].as_py() < ranges else _count_windows(packs, data)
        return pa.Table.from_batches([_rows(out, ANSWER)] if out else [], schema=ANSWER)

    return run


VERDICTS = pa.schema([("key", pa.binary()), ("long", pa.binary()), ("short", pa.binary())])


def _solve_distinct(length: int, shorter: int, block: int):
    def run(table: pa.Table) -> pa.Table:
        """Of the distinct regions of a range: which starts are repeated, as bits."""
        keys, m, copies = table.column("key").to_pylist(), table.column("starts").to_numpy().astype(np.int64), table.column("copies").to_numpy().astype(np.int64)
        texts = table.column("text").to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        long, short = repeated_starts(table.column("least").to_numpy(), m, sizes, np.frombuffer(b"".join(texts), np.uint8), copies, table.column("shard").to_numpy(), length, shorter, block)
        cuts = np.cumsum(m)[:-1]
        rows = [(k, np.packbits(a).tobytes(), np.packbits(b).tobytes()) for k, a, b in zip(keys, np.split(long, cuts), np.split(short, cuts), strict=True)]
        return pa.Table.from_batches([_rows(rows, VERDICTS)])

    return run


def _frequent(packs: DataFrame, answers: DataFrame, text_col: str, length: int, shorter: int, gram: int, block: int) -> DataFrame:
    """Answers for the counted windows: their regions, made distinct over all packs before they are merged."""
    regions = materialize(_again(_with_answers(packs, answers).where(F.col("answers").isNotNull()), text_col, length, shorter, gram), "regions")
    distinct = regions.groupBy("key").agg(
        F.first("least").alias("least"), F.first("starts").alias("starts"), F.first("text").alias("text"), F.sum(F.octet_length("places") / 4).cast("long").alias("copies"), F.min("pack").alias("shard"))
    verdicts = materialize(distinct.groupBy("least").applyInArrow(_solve_distinct(length, shorter, block), "key binary, long binary, short binary"), "verdicts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for pack, m, places, *bits in zip(*(b.column(n).to_pylist() for n in ("pack", "starts", "places", "long", "short")), strict=True):
                at = np.frombuffer(places, np.uint32).astype(np.int64)
                for kind, x in zip((REMOVED, REPORTED), bits, strict=True):
                    hit = np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), count=m))
                    if len(hit):
                        rows.append((kind, pack, _spans(np.sort((at[:, None] + hit[None, :]).reshape(-1)))))
            if rows:
                yield _rows(rows, ANSWER)

    return map_arrow(regions.select("key", "pack", "starts", "places").join(verdicts, "key"), run, SCHEMA)


def repeated_windows(packs: DataFrame, text_col: str, length: int = LENGTH, shorter: int = SHORTER, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(part, pack, data): runs of the starts of repeated strings, as byte places of their pack; part tells their length."""
    size = packs.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, size * 3 // (shorter - gram + 2) // RANGE_HASHES + 1)
    anchors = _anchors(packs, text_col, shorter, gram, ranges)
    counted = materialize(anchors.groupBy("part").applyInArrow(_count_anchors(hot), SCHEMA), "anchors")
    again = counted.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    ranges = max(1, again // 16 * (2 * length) // RANGE_BYTES + 1)
    regions = _regions(_with_answers(packs, counted), text_col, length, shorter, gram, ranges)
    answers = materialize(regions.groupBy("part").applyInArrow(_solve(ranges, length, shorter, block), SCHEMA), "answers")
    found, later = answers.where(F.col("part") != AGAIN), answers.where(F.col("part") == AGAIN)
    if not later.limit(1).count():
        return found
    return found.unionByName(_frequent(packs, later, text_col, length, shorter, gram, block))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shorter: int | None = None, gram: int = GRAM, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """All columns of all rows, with ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans`` and ``n_repeated`` added.

    A byte goes if a string of ``length`` bytes that covers it also starts at
    another place of the corpus, in the same document or another one; overlaps
    count, and no string crosses documents.  Every occurrence goes, the first
    too.  ``n_repeated`` counts the bytes that strings of ``shorter`` bytes
    cover so; by default they are as long as those that go.  Null and empty
    texts have no bytes; texts shorter than a string keep all.  Each row is a
    document of its own, so a repeated row is a repeat, also for null ids.  The
    kept bytes may cut a character, so they are binary.  Input columns of the
    new names are replaced.  ``block`` divides both lengths.
    """
    shorter = shorter or length
    if length % block or shorter % block or gram > shorter or shorter > length:
        raise ValueError("block must divide the lengths, and gram must not exceed them")
    new = ("kept", "n_bytes", "n_removed", "n_spans", "n_repeated")
    docs = docs.drop(*new)
    packs = make_packs(docs, "packs", id_col, text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["kept binary", *(f"{n} long" for n in new[1:])])

    def covered(answers: list[dict], kind: int, size: int, n: int) -> np.ndarray:
        step = np.zeros(n + 1, np.int32)
        for a in answers:
            if a["part"] == kind:
                begins, ends = _from_spans(a["data"])
                np.add.at(step, begins, 1)
                np.add.at(step, ends - 1 + size, -1)
        return np.cumsum(step[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, answers in zip(b.column("data"), b.column("answers").to_pylist(), strict=True):
                batch = open_pack(data.as_py())
                raw, offsets = text_bytes(batch.column(text_col))
                gone = covered(answers or [], REMOVED, length, len(raw))
                total, near = (np.append(0, np.cumsum(x)) for x in (gone, covered(answers or [], REPORTED, shorter, len(raw))))
                sizes = np.diff(offsets)
                removed, repeated = (x[offsets[1:]] - x[offsets[:-1]] for x in (total, near))
                # Removed runs begin where the byte before is kept or belongs to another document.
                opens = gone & ~np.append(False, gone[:-1])
                heads = offsets[:-1][sizes > 0]
                opens[heads] = gone[heads]
                opened = np.append(0, np.cumsum(opens))
                kept, ends = raw[~gone], np.append(0, np.cumsum(sizes - removed)).astype(np.int64)
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())]).cast(pa.binary())
                cols = [texts, *(pa.array(x.astype(np.int64)) for x in (sizes, removed, opened[offsets[1:]] - opened[offsets[:-1]], repeated))]
                yield pa.RecordBatch.from_arrays(list(batch.columns) + cols, names=[*batch.schema.names, *new])

    return map_arrow(_with_answers(packs, repeated_windows(packs, text_col, length, shorter, gram, block, hot)), run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """n_bytes, n_removed, n_spans and the kept bytes' hash of every row of ``documents``.

    ``n_repeated`` also counts what strings of SHORTER bytes cover, which is
    about 50 words: such passages stay, but are told.  Null and empty texts: all
    counts 0 and the hash of no bytes.
    """
    rows = remove_repeats(docs.select("doc_id", "text"), shorter=SHORTER)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")
