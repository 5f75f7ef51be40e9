"""Every stage of the pipeline against brute force on what the stage before kept."""

import re

import corpus_pipeline
from test_dedup_operators import shingles

from streamloom.llm import bpe


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "tokens"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], sf).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "tokens":
            assert kept[-1].schema == docs.schema
    rows = [{r.doc_id: r for r in k.collect()} for k in kept]
    # Language: most stays, and nothing without letters.
    assert len(rows[1]) > 0.9 * len(rows[0]) and all(re.search(r"[^\W\d_]", r.text) for r in rows[1].values())
    # One document of each class stays.
    sets = {k: shingles(r.text) for k, r in rows[1].items()}
    ids = sorted(sets)
    lead = {k: k for k in ids}

    def root(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root(a) != root(b):
                lead[max(root(a), root(b))] = min(root(a), root(b))
    assert sorted(rows[2]) == [k for k in ids if root(k) == k]
    # Repeated windows go.
    seen = set()
    for k in sorted(rows[2]):
        w = re.findall(r"[^\x20\x09-\x0D]+", rows[2][k].text)
        gone = set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            gone |= set(range(i, i + 20)) if key in seen else set()
            seen.add(key)
        want = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else rows[2][k].text
        assert rows[3][k].text == want and rows[3][k].n_chars == (len(want) if gone else rows[2][k].n_chars)
    # Documents with a benchmark item go.
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [k for k, r in rows[3].items() if not any(len(x & shingles(r.text)) >= 0.8 * len(x) for x in items)]
    assert sorted(rows[4]) == sorted(clean)
    coder = bpe.encoder(bpe.default_vocabulary())
    for k, r in rows[5].items():
        assert bytes(r.ids_le) == next(coder.encode([rows[4][k].text]))[0]
    assert sorted(rows[5]) == sorted(rows[4])
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == {k: r.ids_sha256 for k, r in rows[5].items()}


def test_null_ids_are_decontaminated(spark, tmp_path):
    item = " ".join(f"item{k}" for k in range(30))
    spark.createDataFrame([(10, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, item), (2, "fine"), (None, f"a {item} b"), (None, "clean " * 9), (None, "clean " * 9), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang").repartition(3)
    got = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((k or 0, t or "") for k, t in rows if item not in (t or ""))
    named = corpus_pipeline.decontamination(spark, docs.where("doc_id IS NOT NULL"), str(tmp_path))
    assert [r.doc_id for r in named.collect()] == [2]
