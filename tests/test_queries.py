import pytest
from oracle import compare

from streamloom import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count()


def test_entry_lists_all(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 8


def slow_signature(data):
    h = 1469598103934665603
    for x in data:
        h = (h ^ x) * 1099511628211 % 2**64
    return f"{h:016x}"


def test_whole_signatures(spark, tmp_path):
    """Texts that differ only past byte 64 have signatures of their own."""
    rows = [(1, "x" * 64), (2, "x" * 64 + "a"), (3, "x" * 64 + "b"), (4, "é" * 5000 + "end"), (5, ""), (6, None), (7, "x" * 64 + "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.sig for r in QUERIES["fnv_signature"](spark, str(tmp_path)).collect()}
    assert got == {k: slow_signature((t or "").encode()) for k, t in rows}
    assert len(set(got.values())) == 5


def test_scup_of_short_texts(spark, tmp_path):
    rows = [(k, None if k == 7 else "x" * (5 * (k % 10)) + "yz") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.scup for r in QUERIES["scup_lengths"](spark, str(tmp_path)).collect()}
    cut = {k: (t or "").encode()[: 10 + k % 20] for k, t in rows}
    assert got == {k: b[-1] * 16 + b[-2] % 16 if len(b) == 10 + k % 20 else None for k, b in cut.items()}
    assert None in got.values() and any(v is not None and len(rows[k][1]) < 40 for k, v in got.items())


def test_every_chunk_looks_for_its_signal(spark, sf):
    chunks = QUERIES["frame_assembly"](spark, sf).selectExpr("stream_id", "frame_id", "offset + size div 2").collect()
    signals = {}
    for r in QUERIES["resync_offsets"](spark, sf).collect():
        signals.setdefault((r.stream_id, r.frame_id), []).append((r.byte_offset, r.pid))
    want = [(*c, *min((x for x in signals.get(tuple(c[:2]), []) if x[0] > c[2]), default=(None, None))) for c in chunks]
    got = QUERIES["next_signal_asof"](spark, sf).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
