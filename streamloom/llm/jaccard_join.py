"""N-gram Jaccard self-join by chosen paths.

Each run samples shared tokens: a set of n shingles follows each of its tokens
1 / (similarity * n) times on average, by a hash, so similar sets follow the
same ones.  All runs share one hash of a token: what they ask for together is
a whole number of paths and a chance of one more.  Sets that meet nobody leave;
a bucket that is still large is split again by a second and third token.  Small
buckets are compared by brute force.  The number of runs follows from the
target recall.

Equal sets are one class beforehand.  Classes are dealt to chunks by their most
frequent path.  The chunks of a path are compared with each other, and two
chunks of different paths once if many of their classes follow a common one;
other paths compare just their own members.  A pair counts in one of these places only.  So a large
group of near copies, which meets on every run, costs its own pairs once; they
are counted in blocks and never emitted.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import fits, free_name, id_text, map_arrow, materialize, mix, runs_hash, slices, text_bytes, words_hash
from streamloom.llm.components import components
from streamloom.llm.substring_dedup import find_words

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999999
#: Common paths that a pair must have to be compared: texts with just a passage in common mostly have fewer.
MEETINGS = 3
SEED = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that may be broadcast to find texts.
BROADCAST_BYTES = 16 << 20
#: Buckets beyond this are split by another token; deeper tokens are sampled this much more densely, so a split loses little.
BUCKET, DEPTH, DENSER = 1024, 3, 3.0
#: Members of a large bucket that are looked at, on average, to see whether it can be split.
PROBE = 64
#: Classes of a chunk, and shingles of them all, on average.
CHUNK, CHUNK_SHINGLES = 2048, 1 << 21
OTHER = re.compile(r"[\W_]+")
#: What OTHER takes of ASCII, for texts of that alone.
ASCII_OTHER = {c: " " for c in range(128) if OTHER.match(chr(c))}
#: Values that meet in fewer than one of so many pairs are counted pair by pair, at most so many pairs at once; others by a product of matrices.
RARE, PAIRS = 128, 1 << 20


def runs_for(recall: float) -> int:
    """Least number of runs after which a pair at the threshold has ``MEETINGS`` common paths with this probability.

    A run leads such a pair along one common path at least on average.  The
    number is a sum of independent choices, of one a shared token, and a
    Poisson number of that mean is small more often.
    """
    runs = 1
    while math.exp(-runs) * sum(runs**k / math.factorial(k) for k in range(MEETINGS)) > 1 - recall:
        runs += 1
    return runs


@functools.cache
def _is_word() -> np.ndarray:
    """For every character whether it belongs to a word: what OTHER doesn't take."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def _words(text: str) -> str:
    """The text in lower case, with blanks for what is in no word."""
    text = text.lower()
    if text.isascii():
        return text.translate(ASCII_OTHER)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(_is_word()[points], points, np.uint32(32)).tobytes().decode("utf-32-le")


def shingle_sets(texts: list[str], n: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text.

    Words are lower-case runs of letters and digits.  A text of fewer than n
    words, but at least one, has one shingle of all of them.
    """
    raw, offsets = text_bytes(pa.array([_words(t) for t in texts], pa.string()))
    starts, ends, doc = find_words(raw, offsets)
    words = words_hash(raw, starts, ends)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    size = np.diff(first)
    # Of a document with n words, the runs that start at all but its last n - 1.
    runs = runs_hash(words, n)
    sets = [runs[a : a + k - n + 1] if k >= n else runs[:0] for a, k in zip(first.tolist(), size.tolist(), strict=False)]
    for k in range(1, n):
        own = np.flatnonzero(size == k)
        for i, h in zip(own.tolist(), runs_hash(words[first[own][:, None] + np.arange(k)].ravel(), k)[::k], strict=True):
            sets[i] = np.array([h])
    for h in sets:
        h = np.sort(h)
        yield h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def _class(hashes: np.ndarray) -> bytes | None:
    """16 bytes that stand for a set; none for the empty set."""
    if not len(hashes):
        return None
    return hashlib.blake2b(hashes, digest_size=16).digest()


def _follow(hashes: np.ndarray, seeds: np.ndarray, rate: float) -> list[np.ndarray]:
    """For each seed the paths that a set follows."""
    bound = min(2**64 - 1, int(2**64 * rate / len(hashes)))
    out = []
    for s in seeds:
        t = mix(hashes ^ s)
        out.append(t[t <= np.uint64(bound)])
    return out


def _paths(hashes: np.ndarray, rate: float) -> np.ndarray:
    """The paths that a set follows in all runs: each token has ``rate`` by the set's size, whole ones and one more by a hash.

    A smaller set follows all that a larger one does along their shared tokens.
    """
    each, part = divmod(rate / len(hashes), 1)
    t = mix(hashes ^ SEED)
    more = t[mix(t ^ np.uint64(each)) <= np.uint64(min(2**64 - 1, int(2**64 * part)))]
    return np.concatenate([*(mix(t + np.uint64(k)) for k in range(int(each))), mix(more + np.uint64(each))])


def _classify(docs: DataFrame, n: int, similarity: float, runs: int) -> DataFrame:
    """doc_id, cid, size and paths of the first level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cids, sizes, paths = [], [], []
            for h in shingle_sets(b.column(1).to_pylist(), n):
                cids.append(_class(h))
                sizes.append(len(h))
                paths.append(_paths(h, runs / similarity).view(np.int64) if len(h) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], names=["doc_id", "cid", "size", "paths"])

    return map_arrow(docs, run, "doc_id long, cid binary, size long, paths array<long>")


def _with_class(docs: DataFrame, text_col: str, n: int, name: str) -> DataFrame:
    """Add the cid of every row."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cids = [_class(h) for h in shingle_sets([t or "" for t in b.column(at).to_pylist()], n)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cids, pa.binary())], names=[*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, run, f"{schema}, `{name}` binary")


def _texts(docs: DataFrame, wanted: DataFrame, width: int | Column = 64) -> DataFrame:
    """The text of one document of each wanted class: (text, and the columns of ``wanted`` but ``rep``).

    Wanted rows are broadcast if all of them, of ``width`` bytes each, are few bytes; else joined by a shuffle.
    """
    if fits(wanted, width, BROADCAST_BYTES):
        wanted = F.broadcast(wanted)
    return docs.join(wanted, docs["doc_id"] == wanted["rep"]).drop("doc_id", "rep")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cid, hashes (binary) of the classes in ``wanted`` (cid, rep)."""
    rows = _texts(docs, wanted).select("text", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes = list(shingle_sets(b.column(0).to_pylist(), n))
            keep = [i for i, (h, c) in enumerate(zip(hashes, b.column(1).to_pylist(), strict=True)) if _class(h) == c]  # else another row of that id
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(keep, pa.int64())), pa.array([hashes[i].tobytes() for i in keep], pa.binary())], names=["cid", "hashes"])

    return map_arrow(rows, run, "cid binary, hashes binary").dropDuplicates(["cid"])


def _split(docs: DataFrame, classes: DataFrame, members: DataFrame, n: int, similarity: float) -> DataFrame:
    """(parent, path, cid): members of large buckets follow further tokens."""
    wanted = materialize(members.groupBy("cid").agg(F.collect_list("path").alias("parents")).join(classes.select("cid", "rep"), "cid"), "parents")
    rows = _texts(docs, wanted, F.size("parents") * 8 + 64).select("text", "cid", "parents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple[int, int, bytes]] = []
            for h, cid, parents in zip(shingle_sets(b.column(0).to_pylist(), n), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if _class(h) == cid:
                    seeds = mix(np.array(parents, np.int64).view(np.uint64))
                    for p, found in zip(parents, _follow(h, seeds, DENSER / similarity), strict=True):
                        out += [(p, k, cid) for k in found.view(np.int64).tolist()]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["parent", "path", "cid"])

    return map_arrow(rows, run, "parent long, path long, cid binary").distinct()


def _sized(paths: DataFrame) -> DataFrame:
    """(path, cid, n) of the paths that two classes and more follow.

    The counts are written first: a join with them can then split a hot path,
    which it couldn't in the tasks that count.
    """
    counts = materialize(paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    return materialize(paths.join(counts, "path").select("path", "cid", "n"), "level")


def _buckets(paths: DataFrame, docs: DataFrame, classes: DataFrame, n: int, similarity: float) -> DataFrame:
    """(path, cid, n): the final buckets of two classes and more.

    A large bucket gives way to its children, unless its members are mostly
    alike, so that no token splits them: then one child holds over half of a
    bounded sample of them.  That only decides where pairs are met, not which.
    """
    done, sized = [], paths
    for depth in range(DEPTH):
        large = materialize(sized.where(F.col("n") > BUCKET), "large")
        done.append(sized.where(F.col("n") <= BUCKET))
        if not large.limit(1).count():
            return _all(done)
        if depth == DEPTH - 1:
            done.append(large)
            return _all(done)
        probe = materialize(large.where(F.pmod(F.xxhash64("cid", "path"), F.ceil(F.col("n") / F.lit(PROBE))) == 0), "probe")
        first = _split(docs, classes, probe, n, similarity).groupBy("parent", "path").count().groupBy("parent").agg(F.max("count").alias("most"))
        sizes = probe.groupBy(F.col("path").alias("parent")).agg(F.count("*").alias("whole"))
        alike = materialize(sizes.join(first, "parent").where("most * 2 > whole").select(F.col("parent").alias("path")), "alike")
        done.append(large.join(alike, "path", "left_semi"))
        sized = _sized(materialize(_split(docs, classes, large.join(alike, "path", "left_anti"), n, similarity).select("path", "cid").distinct(), "children"))
    return _all(done)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select("path", "cid", "n")
    for f in frames[1:]:
        out = out.unionByName(f.select("path", "cid", "n"))
    return out


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each array of ``a`` shares with each of ``b``; the arrays have no repeats."""
    out = np.zeros((len(a), len(b)), np.float32)
    if not a or not b:
        return out
    va, vb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(va, vb)
    if not len(both):
        return out
    ca, cb = np.searchsorted(both, va), np.searchsorted(both, vb)
    ka, kb = both[np.minimum(ca, len(both) - 1)] == va, both[np.minimum(cb, len(both) - 1)] == vb
    ra, ca, rb, cb = ra[ka], ca[ka], rb[kb], cb[kb]
    na, nb = np.bincount(ca, minlength=len(both)), np.bincount(cb, minlength=len(both))
    often = na * nb * RARE >= len(a) * len(b)
    _add_pairs(out, ra, ca, rb, cb, nb, ~often)
    both = np.flatnonzero(often)
    ka, kb = often[ca], often[cb]
    ra, ca, rb, cb = ra[ka], np.searchsorted(both, ca[ka]), rb[kb], np.searchsorted(both, cb[kb])
    for lo in range(0, len(both), step := 1 << 10):
        hi = min(lo + step, len(both))
        ma, mb = np.zeros((len(a), hi - lo), np.float32), np.zeros((len(b), hi - lo), np.float32)
        ia, ib = (ca >= lo) & (ca < hi), (cb >= lo) & (cb < hi)
        ma[ra[ia], ca[ia] - lo] = 1
        mb[rb[ib], cb[ib] - lo] = 1
        out += ma @ mb.T
    return out


def _add_pairs(out: np.ndarray, ra: np.ndarray, ca: np.ndarray, rb: np.ndarray, cb: np.ndarray, nb: np.ndarray, which: np.ndarray) -> None:
    """Add one to ``out`` for every pair of rows and each of the values ``which`` they share; ``nb`` counts the rows of a value in b."""
    rb = rb[np.argsort(cb, kind="stable")]
    first = np.cumsum(nb) - nb
    keep = which[ca]
    ra, ca = ra[keep], ca[keep]
    done = np.append(0, np.cumsum(nb[ca]))
    flat, lo = out.reshape(-1), 0
    while lo < len(ca):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PAIRS, side="right")) - 1)
        times = nb[ca[lo:hi]]
        at = np.arange(done[hi] - done[lo]) + np.repeat(first[ca[lo:hi]] - (done[lo:hi] - done[lo]), times)
        np.add.at(flat, np.repeat(ra[lo:hi] * len(out[0]), times) + rb[at], np.float32(1))
        lo = hi


class Side:
    """Classes of one side of a comparison, as columns."""

    def __init__(self, rows: list[dict]):
        self.cids = [r["cid"] for r in rows]
        self.primary = np.array([r["primary"] for r in rows], np.int64)
        self.narrow, self.wide, self.paths = ([np.array(r[k], np.int64) for r in rows] for k in ("narrow", "wide", "paths"))
        if "hashes" in rows[0]:
            self.copies = np.array([r["copies"] for r in rows], np.int64)
            self.sets = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
            self.sizes = np.array([len(s) for s in self.sets])


def _meets(a: Side, b: Side, wide: int | None) -> np.ndarray:
    """The pairs that this comparison counts: every pair with enough common paths has one such place."""
    near = (a.primary[:, None] == b.primary[None, :]) | (_common(a.narrow, b.narrow) > 0)
    if wide is not None:
        near = ~near & ~(_common([x[x < wide] for x in a.wide], [x[x < wide] for x in b.wide]) > 0)
    if near.any():
        near &= _common(a.paths, b.paths) >= MEETINGS
    return np.triu(near, 1) if a is b else near


def _sides(rows: list[dict]) -> tuple[Side, Side, int | None]:
    left, right = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
    if not left:
        left, right = right, []
    a = Side(left)
    return a, Side(right) if right else a, rows[0]["path"]


def _few(rows: list[dict]) -> bool | None:
    """For two classes, whether they are a pair to compare here; None for more."""
    if len(rows) != 2:
        return None
    x, y = rows
    near = x["primary"] == y["primary"] or not set(x["narrow"]).isdisjoint(y["narrow"])
    path = x["path"]
    if path is not None:
        near = not near and min(set(x["wide"]) & set(y["wide"])) == path
    return near and len(set(x["paths"]) & set(y["paths"])) >= MEETINGS


def _needed(rows: list[dict]) -> list[tuple]:
    """(unit, side, path, cid) of the classes with somebody to be compared with."""
    if len(rows) < 2 or (few := _few(rows)) is False:
        return []
    if few:
        return [(r["unit"], r["side"], r["path"], r["cid"]) for r in rows]
    a, b, wide = _sides(rows)
    meets = _meets(a, b, wide)
    i, j = np.flatnonzero(meets.any(axis=1)), np.flatnonzero(meets.any(axis=0))
    unit = rows[0]["unit"]
    if a is b:
        side = {r["cid"]: r["side"] for r in rows}
        return [(unit, side[a.cids[k]], wide, a.cids[k]) for k in np.union1d(i, j)]
    return [(unit, 0, wide, a.cids[k]) for k in i] + [(unit, 1, wide, b.cids[k]) for k in j]


def _compare(rows: list[dict], similarity: float) -> list[tuple[bytes, bytes, int]]:
    """(cid, least linked cid or itself, documents linked) of the classes of one unit."""
    if len(rows) < 2:
        return []
    if len(rows) == 2:
        x, y = rows
        p, q = (np.frombuffer(r["hashes"], np.uint64) for r in rows)
        if not _few(rows):
            return []
        inter = len(np.intersect1d(p, q, assume_unique=True))
        if inter < similarity * (len(p) + len(q) - inter) - 1e-6:
            return []
        return [(x["cid"], x["cid"], y["copies"]), (y["cid"], x["cid"], x["copies"])]
    a, b, wide = _sides(rows)
    meets = _meets(a, b, wide)
    rows_, cols = np.flatnonzero(meets.any(axis=1)), np.flatnonzero(meets.any(axis=0))
    inter = _common([a.sets[i] for i in rows_], [b.sets[j] for j in cols])
    # A few rows at a time: matrices of two chunks are large.
    bands = [slice(k, k + 256) for k in range(0, len(rows_), 256)]
    linked = meets[np.ix_(rows_, cols)]
    for k in bands:
        linked[k] &= inter[k] >= similarity * (a.sizes[rows_[k]][:, None] + b.sizes[cols][None, :] - inter[k]) - 1e-6
    del inter, meets
    if not linked.any():
        return []
    # Both sides are nodes; of one chunk with itself the halves of the matrix are.
    m = len(a.cids)
    nodes, copies = (a.cids, a.copies) if b is a else (a.cids + b.cids, np.concatenate([a.copies, b.copies]))
    cols = cols if b is a else cols + m
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, rows_, linked @ copies[cols])
    np.add.at(links, cols, linked.T @ copies[rows_])
    # Local components: labels fall to the least neighbour until nothing changes.
    label = np.arange(len(nodes), dtype=np.int32)
    none = np.int32(len(nodes))
    while True:
        old = label.copy()
        for k in bands:
            np.minimum.at(label, rows_[k], np.where(linked[k], label[cols][None, :], none).min(axis=1))
            np.minimum.at(label, cols, np.where(linked[k], label[rows_[k]][:, None], none).min(axis=0))
        label = label[label]
        if (label == old).all():
            break
    return [(nodes[k], nodes[label[k]], int(links[k])) for k in np.flatnonzero(links)]


def _each_unit(rows: DataFrame, groups: int, fn, schema: str, types: tuple) -> DataFrame:
    """Units in groups of many, so that small ones share a call; a unit has two chunks at most."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        units: dict[int, list[dict]] = {}
        for r in table.drop_columns(["part"]).to_pylist():
            units.setdefault(r["unit"], []).append(r)
        out = [x for u in units.values() for x in fn(u)]
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return rows.withColumn("part", F.pmod("unit", F.lit(groups))).groupBy("part").applyInArrow(run, schema)


def _units(members: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the comparisons (unit, side, path, cid), and the classes' keys for them.

    Chunk pairs have a null path, block pairs of a wide path have it.
    members: path, cid, n; classes: cid, copies, size, paths.
    """
    # Both sides are written first, so that the join with the counts can split a hot path.
    primary = materialize(members.groupBy("cid").agg(F.max(F.struct("n", "path"))["path"].alias("primary")), "primary")
    weighed = primary.join(classes.select("cid", "size"), "cid").groupBy("primary").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    held = materialize(weighed.select("primary", F.ceil(F.greatest(F.col("n") / F.lit(CHUNK), F.col("s") / F.lit(CHUNK_SHINGLES))).alias("chunks")), "held")
    primary = primary.join(held, "primary").select("cid", "primary", F.pmod(F.xxhash64("cid"), F.col("chunks")).alias("block"))
    primary = materialize(primary.withColumn("chunk", F.xxhash64("primary", "block")), "blocks")
    # Classes of one primary path are compared in its own chunks, so a path is of use only for classes of different ones.
    # Its chunks are counted before they are listed, so no list is long.  It is narrow if comparing those chunks
    # ships little more than comparing its members by themselves, in blocks.
    sizes = primary.groupBy("chunk").agg(F.count("*").alias("size"))
    reach = members.join(primary, "cid").groupBy("path", "primary", "chunk").agg(F.count("*").alias("k"))
    reach = materialize(reach.join(sizes, "chunk"), "reach")
    per_primary = reach.groupBy("path", "primary").agg(F.count("*").alias("c"), F.sum("size").alias("s"), F.sum("k").alias("k"))
    per_path = per_primary.groupBy("path").agg(F.count("*").alias("primaries"), F.sum("k").alias("n"), (F.sum("s") * F.sum("c") - F.sum(F.col("s") * F.col("c"))).alias("cost"))
    narrow = F.col("cost") <= 4 * F.col("n") * F.ceil(F.col("n") / F.lit(CHUNK))
    per_path = materialize(per_path.where("primaries > 1").select("path", narrow.alias("is_narrow")), "wide")
    wide = per_path.where("not is_narrow").select("path")
    lists = reach.join(per_path.where("is_narrow"), "path").groupBy("path", "primary").agg(F.collect_list("chunk").alias("c"))
    lists = lists.groupBy("path").agg(F.collect_list(F.struct("primary", "c")).alias("g")).select(F.explode("g").alias("a"), "g").select("a", F.explode("g").alias("b")).where("a.primary < b.primary")
    cross = lists.select(F.explode("a.c").alias("x"), "b.c").select("x", F.explode("c").alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    blocks = primary.select("primary", "block", "chunk").distinct()
    other = blocks.select("primary", F.col("chunk").alias("y"))
    own = blocks.select("primary", F.col("chunk").alias("x")).join(other, "primary").where("x <= y").select("x", "y")
    pairs = cross.unionByName(own).distinct().withColumn("unit", F.xxhash64("x", "y"))
    marked = members.join(wide.withColumn("is_wide", F.lit(True)), "path", "left")
    paths = marked.groupBy("cid").agg(F.collect_set(F.when(F.col("is_wide").isNull(), F.col("path"))).alias("narrow"), F.collect_set(F.when(F.col("is_wide"), F.col("path"))).alias("wide"))
    full = materialize(classes.drop("size").join(primary.select("cid", "primary", "chunk"), "cid").join(paths, "cid"), "classes")
    ends = pairs.select("unit", F.col("x").alias("chunk"), F.lit(0).alias("side")).unionByName(pairs.where("x < y").select("unit", F.col("y").alias("chunk"), F.lit(1).alias("side")))
    near = primary.select("chunk", "cid").join(ends, "chunk").select("unit", "side", F.lit(None).cast("long").alias("path"), "cid")
    # Blocks of a wide path: every pair of blocks meets once.
    in_wide = members.join(wide, "path").select("path", "cid", "n", F.ceil(F.col("n") / F.lit(CHUNK)).alias("blocks"))
    in_wide = in_wide.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    dealt = in_wide.select("path", "cid", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    unit = F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other"))
    return near.unionByName(dealt.select(unit.alias("unit"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "path", "cid")), full.drop("chunk")


def _linked(named: DataFrame, n: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, cid of every row, and cid, rep, copies, links, root of every set: linked sets have one root.

    named: doc_id, text; no null id.
    """
    found = materialize(_classify(named, n, similarity, runs_for(recall)), "paths")
    by_set = found.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("paths").alias("paths"))
    by_set = materialize(by_set, "sets")
    level = _sized(by_set.select(F.explode(F.array_distinct("paths")).alias("path"), "cid"))
    known = level.groupBy("cid").agg(F.collect_set("path").alias("paths"))
    classes = materialize(by_set.drop("paths").join(known, "cid"), "active")
    members = materialize(_buckets(level, named, classes, n, similarity), "buckets")
    units, keys = _units(members, classes.select("cid", "copies", "size", "paths"))
    groups = max(8, classes.count() // 500)
    # First the paths alone tell who has somebody alike; only those classes' sets are shipped.
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    needed = materialize(_each_unit(units.join(keys.drop("copies"), "cid"), groups, _needed, "unit long, side int, path long, cid binary", kinds), "needed")
    sets = materialize(_sets(named, classes.select("cid", "rep").join(needed.select("cid").distinct(), "cid"), n), "hashes")
    rows = needed.join(keys, "cid").join(sets, "cid")
    links = materialize(_each_unit(rows, groups, lambda u: _compare(u, similarity), "u binary, v binary, links long", (pa.binary(), pa.binary(), pa.int64())), "links")
    roots = components(links.select("u", "v"))
    counts = links.groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    whole = by_set.select("cid", "rep", "copies").join(counts, "cid", "left").join(roots.withColumnsRenamed({"u": "cid", "v": "root"}), "cid", "left")
    whole = whole.withColumn("root", F.coalesce("root", "cid"))
    return found.select("doc_id", "cid"), whole


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) of every row.

    Two documents are linked if the Jaccard similarity of their sets of word
    n-grams is at least ``similarity``.  ``n_links`` counts the other documents
    that a document is linked to, copies included; ``class_id`` is the least id
    of all documents that links lead to, its own if there are none.  Texts
    without a word (null, empty) have no set and no links.  Rows with a null id
    take no part: their class is null, with 0 links.  Rows of one id count as
    documents of their own and each get a row.
    """
    docs = id_text(docs, id_col, text_col)
    found, whole = _linked(docs.where(F.col("doc_id").isNotNull()), n, similarity, recall)
    least = whole.groupBy("root").agg(F.min("rep").alias("class_id"))
    labels = whole.join(least, "root").select("cid", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    out = found.join(labels, "cid", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.unionByName(docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row of ``docs`` for each class of linked sets, one that has the least id; a row goes only if an equal or linked text stays.

    Rows of one id stay apart if their texts aren't linked.  Rows without a
    word stay, equal ones of one id once; rows with a null id stay.
    """
    texts = id_text(docs, id_col, text_col)
    found, whole = _linked(texts.where(F.col("doc_id").isNotNull()), n, similarity, recall)
    kept, cid, again, own, text = (free_name(docs.columns, x) for x in ("_kept", "_cid", "_again", "_set", "_text"))
    least = whole.groupBy("root").agg(F.min(F.struct("rep", "cid")).alias("k")).select(F.col("k.rep").alias(kept), F.col("k.cid").alias(cid))
    wordless = found.where(F.col("cid").isNull()).select(F.col("doc_id").alias(kept), F.col("cid").alias(cid)).distinct()
    stay = materialize(least.unionByName(wordless), "kept")
    often = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(again)), "again")
    key = F.col(id_col).cast("long")
    named = docs.where(key.isNotNull())
    # Ids are measured like all that is broadcast; only many of them need the documents shuffled.
    ids = materialize(stay.select(kept).distinct(), "ids")
    one = named.join(F.broadcast(ids) if fits(ids, 32, BROADCAST_BYTES) else ids, key == F.col(kept), "left_semi").join(often, key == F.col(again), "left_anti")
    # Only rows of repeated ids must be told apart by their sets.
    some = _with_class(named.join(often, key == F.col(again), "left_semi"), text_col, n, own)
    some = some.join(stay, (key == F.col(kept)) & F.col(own).eqNullSafe(F.col(cid)), "left_semi")
    some = some.withColumn(text, F.when(F.col(own).isNull(), F.coalesce(F.col(text_col), F.lit("")))).dropDuplicates([id_col, own, text]).select(docs.columns)
    return one.unionByName(some).unionByName(docs.where(key.isNull()))


ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE k >= 0.8 * (a.n + b.n - k) - 1e-6),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT r.x AS doc_id, min(r.y) AS class_id, (SELECT count(*) FROM e WHERE e.x = r.x)::BIGINT AS n_links FROM r GROUP BY r.x"""
