"""The operators on repeats and pairs, against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

from streamloom.llm import common, decontaminate, jaccard_join, substring_dedup, suffix_dedup
from streamloom.llm import queries as q
from streamloom.llm.components import components

WORDS = [f"w{k}" for k in range(40)]
LINE = "the same common line of just a few words in very many texts"


def corpus():
    random.seed(5)
    base = [" ".join(random.choice(WORDS) + str(random.randrange(9)) for _ in range(random.randrange(5, 160))) for _ in range(40)]
    near = []
    for t in base[:20]:
        w = t.split()
        for _ in range(2):
            v = list(w)
            v[random.randrange(len(v))] = "edit"
            near.append(" ".join(v))
    odd = [None, "", " ", "one", "one", "a b c d", "a b c d e", "x " * 900, "é" * 500, "q" * 450, "tab\tand\nline"]
    rows = base + base[:6] + near + odd + [f"{t} {LINE} {k}" for k, t in enumerate(base[20:])]
    rows = [(k * 3, t) for k, t in enumerate(rows)]
    return rows + [rows[0], (None, base[1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns of the operators' own names must not disturb them.
    return spark.createDataFrame(corpus(), "doc_id long, text string").selectExpr("*", "'c' AS kept", "1 AS n_removed", "2L AS pack", "'h' AS h").repartition(3)


def slow_repeats(data, length):
    """For each text which bytes strings cover that start at several places of the corpus."""
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append(gone)
    return out


@pytest.mark.parametrize(("length", "shorter", "gram", "block", "hot"), [(400, 300, 64, 100, 1024), (400, None, 64, 100, 2), (24, 16, 8, 8, 1000), (24, 20, 8, 4, 3), (24, 8, 8, 8, 1)])
def test_suffixes(docs, length, shorter, gram, block, hot):
    """Every case against brute force, with hashes counted as frequent from few occurrences on."""
    data = [(t or "").encode() for _, t in corpus()]
    want = []
    for (i, _), b, gone, near in zip(corpus(), data, slow_repeats(data, length), slow_repeats(data, shorter or length), strict=True):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((-1 if i is None else i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept, sum(near)))
    got = suffix_dedup.remove_repeats(docs, length=length, shorter=shorter, gram=gram, block=block, hot=hot).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.n_repeated) for r in got) == sorted(want)


def slow_merge(strings, rounds):
    """Suffixes of all strings in order of their first symbols, and how many each shares with the one before."""
    found = sorted((tuple(s[k : k + rounds]), j, k) for j, s in enumerate(strings) for k in range(len(s) + 1))
    common = [0] + [next((i for i, (a, b) in enumerate(zip(x[0], y[0], strict=False)) if a != b), min(len(x[0]), len(y[0]))) if x[0] != y[0] else rounds for x, y in zip(found, found[1:], strict=False)]
    return [x[0] for x in found], common


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.text("ab", min_size=1, max_size=12), min_size=1, max_size=3), min_size=1, max_size=4), st.integers(1, 5))
def test_merged_transforms(shards, rounds):
    """The interleave alone gives the order and the common prefixes of suffixes of different shards."""
    texts = [t for s in shards for t in s]
    sizes = np.array([len(t) for t in texts])
    s = suffix_dedup.Shards(np.frombuffer("".join(texts).encode(), np.uint8), sizes, np.repeat(np.arange(len(shards)), [len(x) for x in shards]), 1)
    order, common = suffix_dedup.merge_transforms(s, rounds)
    of = np.searchsorted(s.first, order, side="right") - 1
    # Symbols are ordered by their ranks; a string's symbols are those of its places but the last, empty one.
    ranked = [s.symbol[at : at + n].tolist() for at, n in zip(s.first.tolist(), sizes.tolist(), strict=True)]
    got = [tuple(ranked[j][k - s.first[j] : k - s.first[j] + rounds]) for j, k in zip(of.tolist(), order.tolist(), strict=True)]
    want, prefix = slow_merge(ranked, rounds)
    assert got == want
    # Whether neighbours share all symbols is what repeats are read from; a text's end equals another text's end.
    assert [min(a, rounds) for a in common.tolist()] == [0 if k == 0 else b for k, b in enumerate(prefix)]


def test_repeats_come_from_the_merge(docs, monkeypatch):
    """Without the interleave no repeat across shards is found: shards are sorted by themselves only."""
    one = np.frombuffer(b"abcabdabc", np.uint8)
    apart = suffix_dedup.Shards(np.concatenate([one, one]), np.array([9, 9]), np.array([0, 1]), 1)
    order = apart.sort(3)
    assert apart.shard[order].tolist() == sorted(apart.shard.tolist())
    def case():
        return suffix_dedup.repeated_starts(*(np.array(x) for x in ([1, 1], [4, 3], [10, 9])), np.frombuffer(b"xabcdefghiabcdefghi", np.uint8), np.array([1, 1]), np.array([0, 1]), 7, 7, 1)[0]

    assert case().tolist() == [False, True, True, True, True, True, True]
    monkeypatch.setattr(suffix_dedup, "interleave", lambda before, shard, alphabet, rounds: (np.arange(len(before)), np.zeros(len(before), np.int64)))
    assert not case().any()


def test_only_what_is_asked_for_is_transformed(monkeypatch):
    """Rows of a transform are the starts and what follows them by blocks; regions that all occur again have none."""
    rng, rows, interleave = np.random.default_rng(2), [], suffix_dedup.interleave

    def counted(before, *rest):
        rows.append(len(before))
        return interleave(before, *rest)

    monkeypatch.setattr(suffix_dedup, "interleave", counted)
    one, other = rng.integers(0, 256, (2, 409)).astype(np.uint8)
    other[5:405] = one[5:405]
    case = [np.array([1, 1]), np.array([10, 10]), np.array([409, 409]), np.concatenate([one, other])]
    long, short = suffix_dedup.repeated_starts(*case, np.array([1, 1]), np.array([0, 1]), 400, 300, 100)
    assert np.flatnonzero(long).tolist() == [5, 15] and np.flatnonzero(short).tolist() == [5, 6, 7, 8, 9, 15, 16, 17, 18, 19]
    # Ten starts of each, four blocks and an end.
    assert rows == [2 * 10 * 5]
    long, short = suffix_dedup.repeated_starts(*case, np.array([2, 3]), np.array([0, 1]), 400, 300, 100)
    assert long.all() and short.all() and len(rows) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), max_size=6), st.integers(1, 9), st.integers(1, 9), st.integers(1, 30), st.integers(1, 30))
def test_runs_do_not_depend_on_steps(texts, gram, more, step, piece):
    """Runs of least hashes, and the places of these, against a look at each window."""
    length, raw = gram + more, np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix_dedup, "STEP", step)
        m.setattr(suffix_dedup, "PIECE", piece)
        starts, ends, least, places = suffix_dedup._runs(raw, offsets, length, gram)
    runs, seen = [], set()
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for k in range(lo, hi - length + 1):
            h = suffix_dedup.rolling(raw[k : k + length], gram).tolist()
            seen |= {(k + j, x) for j, x in enumerate(h) if x == min(h)}
            if runs and runs[-1][1:] == [k, min(h)] and (k - lo) % piece:
                runs[-1][1] += 1
            else:
                runs.append([k, k + 1, min(h)])
    assert [list(x) for x in zip(starts.tolist(), ends.tolist(), least.tolist(), strict=True)] == runs
    assert places.tolist() == [x for _, x in sorted(seen)]


def test_deal():
    """Orders are stable, also of integers that don't fit beside their places."""
    for key in ([], [3, 1, 3, 0, 1], [2**32, 5, 2**40, 5, 0]):
        order, got = suffix_dedup._deal(np.array(key, np.int64), max(key, default=0))
        assert order.tolist() == sorted(range(len(key)), key=lambda k: key[k]) and got.tolist() == sorted(key)


THUE = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_words_that_linear_hashes_confuse(spark):
    """Two words of 2048 letters that every polynomial hash modulo 2**64 takes for one are told apart."""
    tail = [f"w{k}" for k in range(19)]
    df = spark.createDataFrame([(1, " ".join([THUE, *tail])), (2, " ".join([MORSE, *tail]))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.digest(df).collect()] == [0, 0]
    few = [(1, " ".join([THUE, *tail[:4]])), (2, " ".join([MORSE, *tail[:4]]))]
    assert [r.n_links for r in jaccard_join.join(spark.createDataFrame(few, "doc_id long, text string")).collect()] == [0, 0]
    data = [(THUE + "x" * 9).encode(), (MORSE + "x" * 9).encode()]
    df = spark.createDataFrame([(k, b.decode()) for k, b in enumerate(data)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df, length=1024, gram=64, block=1024).collect()}
    assert got == {k: sum(g) for k, g in enumerate(slow_repeats(data, 1024))}
    padded = np.frombuffer(data[0][:2048] + data[1][:2048], np.uint8)
    assert len(set(suffix_dedup.block_ranks(padded, np.array([0, 2048, 0]), 2048).tolist())) == 2


def test_suffix_parameters(docs):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, length=400, block=64)
    assert suffix_dedup.digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [20, 3])
def test_windows(docs, size):
    data = sorted(((float("inf") if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in corpus()), key=lambda x: x[0])
    seen, want = set(), []
    for i, w in data:
        gone = set()
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone.update(range(k, k + size))
            seen.add(key)
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup.deduplicate(docs, size=size).collect()
    assert Counter((float("inf") if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == Counter(want)
    assert {c for c in got[0].asDict()} == {"doc_id", "text", "pack", "h", "kept", "n_words", "n_removed"}


def test_windows_of_nothing(docs):
    assert substring_dedup.digest(docs.limit(0)).count() == 0


def shingles(text, n=5):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_join(docs):
    rows = [(i, shingles(t)) for i, t in corpus() if i is not None]
    near = defaultdict(set)
    for a, (_, x) in enumerate(rows):
        for b, (_, y) in enumerate(rows):
            if a != b and x and y and len(x & y) >= 0.8 * len(x | y):
                near[a].add(b)
    want = Counter()
    for a, (i, _) in enumerate(rows):
        seen, stack = {a}, [a]
        while stack:
            for b in near[stack.pop()] - seen:
                seen.add(b)
                stack.append(b)
        want[i, min(rows[b][0] for b in seen), len(near[a])] += 1
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(docs).collect())
    assert {k: v for k, v in got.items() if k[0] is not None} == dict(want)
    assert got[None, None, 0] == 2
    kept = jaccard_join.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({k[1] for k in want})
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_keep_one_of_repeated_ids(spark):
    """Rows of one id with different texts: each goes only if an equal or linked text stays."""
    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(5, x), (5, y), (2, y + " end"), (7, z), (7, z + " end"), (7, z), (8, x + " end"), (9, ""), (9, None), (9, " "), (9, "one"), (1, "two words"), (1, "two words"), (1, "one"), (None, x)]
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS kept")).collect()
    assert len(got[0]) == 3
    texts = Counter((r.doc_id, r.text or "") for r in got)
    (last,) = [k for k in texts if k[0] == 7]
    assert last[1] in (z, z + " end")
    assert texts == Counter({k: 1 for k in [(5, x), (2, y + " end"), last, (9, ""), (9, " "), (1, "two words"), (1, "one"), (None, x)]})


def test_join_of_large_buckets(spark, monkeypatch):
    """Small limits drive large groups through splitting, blocks and chunk pairs."""
    for k, v in {"BUCKET": 12, "CHUNK": 5, "BROADCAST_BYTES": 100}.items():
        monkeypatch.setattr(jaccard_join, k, v)
    base = [random.choice(WORDS) + str(random.randrange(99)) for _ in range(150)]
    rows = []
    for k in range(60):
        w = list(base)
        w[random.randrange(150)] = f"e{k}{random.random()}"
        rows.append((k, " ".join(w)))
    for k in range(60, 130):
        rows.append((k, " ".join([f"u{random.random()}" for _ in range(40)] + LINE.split() * 3)))
    sets = {k: shingles(t) for k, t in rows}
    links = {k: sum(j != k and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]) for j in sets) for k in sets}
    got = {r.doc_id: r for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.n_links for k, r in got.items()} == links
    assert sum(links.values()) > 1000


@pytest.mark.parametrize("rare", [1, 128, 10**9])
def test_common_values(monkeypatch, rare):
    """Pair by pair, by matrices and by both: the same counts."""
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    monkeypatch.setattr(jaccard_join, "PAIRS", 50)
    rng = np.random.default_rng(2)
    a, b = ([np.unique(rng.zipf(1.3, rng.integers(0, 60)) % 500).astype(np.uint64) for _ in range(k)] for k in (70, 33))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert jaccard_join._common(a, b).tolist() == want
    assert jaccard_join._common(a, a).tolist() == [[len(np.intersect1d(x, y)) for y in a] for x in a]
    assert not jaccard_join._common(a, [x + np.uint64(500) for x in b]).any()


def test_rare_common_values_cost_their_pairs():
    """60000 values that two classes of either side share: products of matrices of all of them take many seconds."""
    values = np.random.default_rng(3).permutation(np.repeat(np.arange(60_000, dtype=np.uint64), 2)).reshape(2000, 60)
    sets = [np.unique(x) for x in values]
    before = time.process_time()
    got = jaccard_join._common(sets, sets)
    assert time.process_time() - before < 2
    assert got.diagonal().tolist() == [len(x) for x in sets]
    assert got.sum() == sum(int((k * k).sum()) for k in [np.unique(np.concatenate(sets), return_counts=True)[1]])


def test_paths_of_all_runs_cost_one_pass(monkeypatch):
    """A set of 2000 shingles is hashed about twice, not once a run, and follows as many paths as runs ask for."""
    hashed = []
    monkeypatch.setattr(jaccard_join, "mix", lambda h: (hashed.append(np.size(h)), common.mix(h))[1])
    tokens = common.mix(np.arange(1, 200_001, dtype=np.uint64))
    found = [len(np.unique(jaccard_join._paths(x, 25))) for x in np.split(tokens, 100)]
    assert 23 < np.mean(found) < 27
    assert sum(hashed) < 3 * len(tokens)


@pytest.mark.parametrize("n", [1, 4, 5, 20, 300])
def test_similar_sets_share_paths(n):
    """A pair at the threshold has 20 common paths on average, and all that the larger set follows along shared tokens."""
    shared = []
    for k in range(300):
        whole = common.mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(1000 * k))
        part = whole[: -(-4 * n // 5)]
        small, large = (set(jaccard_join._paths(x, 20 / 0.8).tolist()) for x in (part, whole))
        shared.append(len(small & large))
    assert min(shared) >= jaccard_join.MEETINGS and np.mean(shared) > 19


def test_words_of_every_character():
    """The table of word characters is what the expression leaves, and texts of ASCII alone agree."""
    for c in [*range(0x3000), *range(0x1D400, 0x1D800), 0x10FFFF]:
        for text in (f"A{chr(c)}b", f"A{chr(c)}b\u00e9"):
            assert jaccard_join._words(text).split(" ") == [x or "" for x in jaccard_join.OTHER.sub(" ", text.lower()).split(" ")]


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, 1), (7, 3), (3, 9), (9, 7), (5, 7)]
    got = {(r.u, r.v) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(k, 100) for k in range(101, 141)} | {(5, 3), (7, 3), (9, 3)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_containment(spark):
    item = " ".join(f"Item{k}" for k in range(30))
    w = item.split()
    few = w[:]
    few[3] = "other"
    half = w[:15]
    rows = [(1, "pre " * 50 + item.upper() + " post" * 50), (2, "x; " + ", ".join(few) + "."), (3, " ".join(half)), (4, None), (5, ""), (1, item), (None, item), (6, "Item1 Item2"), (7, "long " * 5000 + item)]
    items = [(10, item), (11, "too short it is"), (12, None), (10, item), (13, "a b c d e"), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS item_id", "'w' AS w")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.find(docs, bench).collect()}
    n = 26
    assert got == {(1, 10, n, n), (2, 10, n - 4, n), (7, 10, n, n)}
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, bench).collect()) == ["3", "4", "5", "6", "None"]
    assert decontaminate.find(docs.limit(0), bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_sketches_of_documents(spark):
    """A document's sketch of a size class is what it has up to the class's largest item hash; classes have their own."""
    items = [(k, " ".join(f"i{k}w{j}" for j in range(5 + 9 * k))) for k in range(8)]
    bench = spark.createDataFrame(items, "item_id long, text string").select("item_id", decontaminate.words(F.col("text")).alias("w"))
    sketch = decontaminate.sketches(bench).collect()
    sizes = {k: len(t.split()) - 4 for k, t in items}
    tops = {}
    for r in sketch:
        assert r.size_class == (sizes[r.item_id] - 1).bit_length()
        tops[r.size_class] = max(tops.get(r.size_class, r.h), r.h)
    for k, m in sizes.items():
        most = 1 << (m - 1).bit_length()
        assert sum(r.item_id == k for r in sketch) == min(m, most - -(-most * 4 // 5) + 1)
    docs = spark.createDataFrame([(1, " ".join(t for _, t in items)), (2, "a b c")], "doc_id long, text string").select("doc_id", decontaminate.words(F.col("text")).alias("w"))
    got = {(r.size_class, r.h) for r in decontaminate.document_sketches(docs, tops).collect()}
    hashes = {r.h for r in decontaminate._shingles(docs, "doc_id", 5).collect()}
    assert got == {(c, h) for c, top in tops.items() for h in hashes if h <= top}
    assert {(r.size_class, r.h) for r in sketch} <= got and decontaminate.document_sketches(docs, {}).count() == 0


def test_containment_beyond_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST", 1)
    compare(q.op4_decontamination(spark, sf), q.oracle_sql()["op4_decontamination"], sf)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    compare(q.queries()[name](spark, sf), q.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query_has_a_row_for_each_input(spark, sf, name):
    got = q.queries()[name](spark, sf)
    table = "pages" if name.startswith("op1_") else "documents"
    if not name.startswith("op4_"):
        assert got.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_digest_of_suffixes(spark, sf):
    got = {r.doc_id: r for r in q.op3_suffix_dedup(spark, sf).collect()}
    data = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = 400
    seen = Counter(b[k : k + n] for b in data.values() for k in range(len(b) - n + 1))
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), sum(gone), hashlib.sha256(kept).hexdigest())


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    from streamloom.llm import common

    rng = np.random.default_rng(1)
    raw = rng.integers(0, 4, 20000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 19000, 300))
    ends = starts + rng.integers(0, 600, 300)
    for which in (0, 1):
        whole = common.words_hash(raw, starts, ends, which)
        runs = common.runs_hash(whole, 20)
        assert len(set(whole.tolist())) == len({raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)})
        monkeypatch.setattr(common, "HASH_PIECE", 64)
        assert (common.words_hash(raw, starts, ends, which) == whole).all() and (common.runs_hash(whole, 20) == runs).all()
        monkeypatch.undo()
        assert (common.runs_hash(whole[50:90], 20) == runs[50:71]).all() and not len(common.runs_hash(whole[:19], 20))
    for top in (10**5, 10**7, 2**32):
        places = np.sort(rng.integers(0, top, 500))
        assert (common.unpack_places(common.pack_places(places)) == places).all()
    assert not len(common.unpack_places(common.pack_places(places[:0])))


def test_very_long_texts(spark):
    text = " ".join(f"word{k % 50021}" for k in range(400_000))
    rows = [(1, text), (2, text + " end"), (3, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.digest(df).collect()}
    assert got[1].n_words == 400_000 and got[1].n_removed == 400_000 - 50021 and got[2].n_removed == 400_000
    got = {r.doc_id: r for r in suffix_dedup.digest(df).collect()}
    assert got[1].n_removed == len(text) and got[2].n_removed == len(text) + 1 and got[3].n_removed == 3_000_000
    got = {r.doc_id: r for r in jaccard_join.join(df).collect()}
    assert [got[k].class_id for k in (1, 2, 3)] == [1, 1, 3]
