"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from streamloom.llm import bpe, decontaminate, html_text, jaccard_join, langid, media, sharding, substring_dedup, suffix_dedup, token_counts

LONG = " ".join(f"the word{k % 997} of {k}" for k in range(60_000))
ROWS = [(1, "the quick brown fox jumps over the lazy dog and runs away"), (1, "the quick brown fox jumps over the lazy dog and runs away"), (2, None), (3, ""), (4, " \t\n"), (5, "x" * 30_000), (6, LONG), (7, "1 2 3 !"),
        (None, "a text without an id that nobody else has"), (None, None), (8, LONG), (9, "the quick brown fox jumps over the lazy cat and runs away")]
#: Names that the operators give to their own columns.
CLASH = "doc_id text lang source n_chars pack size data answers part key cid paths kept n_words n_removed n_bytes n_spans n_repeated h w i item_id size_class slot shard _slot _hit _row _kept _cid _again _set _text rejected score lang_pred ids_le n_tokens decoded media payload feature pcm rep root u v".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.select(*[F.col(c) if c in df.columns else F.lit(c).alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "quick brown fox jumps over the lazy dog"), (1, "quick brown fox jumps over the lazy dog"), (4, "two words")], "item_id long, text string").withColumns({"h": F.lit(1), "doc_id": F.lit(2)})


WHOLE = {
    "op1": lambda d: html_text.extract(d, "doc_id", "text"), "op2": token_counts.count_tokens, "op3": suffix_dedup.remove_repeats, "op5": sharding.assign, "op6": substring_dedup.deduplicate, "op7": jaccard_join.join,
    "op8": lambda d: media.read(media.store(d), pcm=True), "op9": bpe.encode, "op10": lambda d: langid.classify(d, {"de": b"der die das und " * 9, "en": b"the of and a " * 9}, keep=True)}


@pytest.mark.parametrize("name", WHOLE)
def test_a_row_for_each_row(docs, name):
    got = WHOLE[name](docs)
    rows = got.collect()
    ids = Counter(r[0] for r in rows)
    assert ids == Counter(k for k, _ in ROWS)
    assert len(set(got.columns)) == len(got.columns)
    same = [r for r in rows if r[0] == 1]
    assert same[0] == same[1]
    empty = WHOLE[name](docs.limit(0))
    assert empty.columns == got.columns and empty.count() == 0


def test_results_of_odd_texts(docs):
    by = {r.doc_id: r for r in token_counts.count_tokens(docs).collect()}
    assert by[2].n_tokens == by[3].n_tokens == 0 and by[6].n_tokens > 200_000
    by = {r.doc_id: r for r in html_text.extract(docs, "doc_id", "text").withColumnRenamed("page_id", "doc_id").collect()}
    assert by[2].text == by[3].text == by[4].text == "" and by[6].text == LONG
    by = {r.doc_id: r for r in suffix_dedup.digest(docs).collect()}
    assert (by[2].n_bytes, by[2].n_removed, by[2].n_spans) == (0, 0, 0) and by[6].n_removed == by[8].n_removed == len(LONG) and by[5].n_removed == 30_000 and by[1].n_removed == 0
    by = {r.doc_id: r for r in substring_dedup.digest(docs).collect()}
    assert by[2].n_words == by[4].n_words == 0 and by[6].n_removed == 0 and by[8].n_removed == by[8].n_words == 240_000
    by = {r.doc_id: r for r in jaccard_join.join(docs).collect()}
    assert (by[6].class_id, by[8].class_id, by[6].n_links) == (6, 6, 1) and by[1].n_links == 1 and by[2].n_links == by[3].n_links == 0
    by = {r.doc_id: r for r in bpe.encode(docs).collect()}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 0 and by[6].n_tokens == by[8].n_tokens > 200_000
    by = {r.doc_id: r for r in media.digest(docs).collect()}
    assert by[2].payload_bytes == by[3].payload_bytes == 64 and by[6].n_bytes == len(LONG) and by[6].media_sha256 == by[8].media_sha256
    by = {r.doc_id: r for r in WHOLE["op10"](docs).collect()}
    assert {by[k].lang_pred for k in (2, 3, 4, 7)} == {"und"} and by[6].lang_pred == by[8].lang_pred == "en" and by[6].text == LONG


def test_items_in_odd_texts(docs, items):
    assert [tuple(r)[:3] for r in decontaminate.find(docs, items).collect()] == [(1, 1, 4)]
    for kept in (decontaminate.clean(docs, items), decontaminate.clean(docs, items, nulls=True)):
        assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(k for k, _ in ROWS if k != 1)
    assert decontaminate.clean(docs.limit(0), items).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == len(ROWS)


def test_placement_of_a_clashing_table(docs, tmp_path):
    sharding.write(docs, str(tmp_path / "s"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == len(ROWS)


@pytest.fixture(scope="module")
def folder(spark, items, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    items.select("item_id", "text").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


#: Documents that each stage keeps of ROWS, by id.
KEPT = {"near_duplicates": [None, None, 1, 2, 3, 4, 5, 6, 7, 9], "repeated_passages": [k for k, _ in ROWS], "decontamination": [k for k, _ in ROWS if k != 1]}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_of_odd_tables(docs, folder, spark, sf, name, stage):
    if name == "language_id":  # learns from rows that aren't held out
        given = spark.read.parquet(f"{sf}/documents.parquet").select([F.col(c) for c in ("doc_id", "text", "lang", "source", "n_chars")])
        odd = docs.select(given.columns).withColumn("lang", F.lit(None).cast("string"))
        got = stage(spark, given.unionByName(odd).withColumn("rejected", F.lit(7)), folder)
        assert got.columns == [*given.columns, "rejected"] and not got.where("text IS NULL OR text RLIKE '^[^a-zA-Z]*$'").count()
        assert got.where("doc_id IN (6, 8) AND lang IS NULL").count() <= 2
    else:
        got = stage(spark, docs, folder)
    if name in KEPT:
        assert got.columns == docs.columns
        assert Counter(r.doc_id for r in got.collect()) == Counter(KEPT[name])
    if name == "repeated_passages":
        by = {r.doc_id: r for r in got.collect()}
        assert by[6].text == LONG and by[8].text == "" and by[4].text == " \t\n" and by[2].text is None
    if name == "tokens":
        assert got.count() == len(ROWS) and got.where("doc_id = 2").first().n_tokens == 0
    empty = stage(spark, docs.limit(0), folder)
    assert empty.columns == got.columns[: len(empty.columns)] or name == "language_id"
    assert empty.count() == 0


def test_pipeline_of_an_empty_table(docs, folder, spark, tmp_path):
    docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_very_long_word(spark):
    word = "internationalisation" * 15_000
    df = spark.createDataFrame([(1, word)], "doc_id long, text string")
    (r,) = bpe.encode(df).collect()
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(bpe.default_vocabulary()).encode(word, add_special_tokens=False).ids
    assert r.n_tokens == len(want) and bytes(r.ids_le) == b"".join(x.to_bytes(4, "little") for x in want)
    assert token_counts.count_tokens(df).first().n_tokens > 15_000 and re.fullmatch(r"\w+", word)
    assert substring_dedup.digest(df).first().n_words == 1 and jaccard_join.join(df).first().n_links == 0
