"""Benchmark decontamination: short test items inside long documents.

Test items are partitioned by size.  A partition's items have MinHash sketches
of their smallest shingle hashes, just so many that a document with the asked
containment must hold at least one (it lacks fewer shingles than the sketch
has).  The largest hash in a partition's sketches is its threshold; a document
is sketched once for each partition, by its shingle hashes up to the
threshold, and the sketches of one partition are joined, so the search loses
nothing: its recall is 1, which the SQL over all pairs confirms.  Candidates
are verified by the exact containment of their word shingles.  Only DataFrame
operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.common import BROADCAST_BYTES, fits, free_name, id_text, materialize

WORDS, CONTAINMENT = 5, 0.8
#: Bytes of a side that may be broadcast; larger sketches are joined by a shuffle.
BROADCAST = BROADCAST_BYTES


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _places(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.size("w") - n))


def _shingles(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """(id, hash) of every word n-gram, in order of place; shorter texts have none."""
    found = rows.where(F.size("w") >= n).select(id_col, "w", _places(n).alias("i"))
    return found.select(id_col, F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(n)]).alias("h"))


def _exact(n: int) -> Column:
    """The distinct word n-grams themselves."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))


def sketches(items: DataFrame, n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, size_class, h): each item's smallest hashes, as many as its size class needs.

    Class k has items of up to ``2**k`` distinct shingles.  An item that is
    contained enough lacks at most ``m - ceil(containment * m)`` of its m
    shingles; a sketch of one more can't be lacking whole.
    """
    hashes = _shingles(items, "item_id", n).groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    hashes = hashes.withColumn("size_class", F.ceil(F.log2(F.size("hs"))).cast("int"))
    most = F.pow(F.lit(2.0), F.col("size_class")).cast("long")
    keep = (most - F.ceil(most * F.lit(containment) - 1e-9) + 1).cast("int")
    return hashes.select("item_id", "size_class", F.explode(F.slice("hs", F.lit(1), keep)).alias("h"))


def document_sketches(rows: DataFrame, tops: dict[int, int], n: int = WORDS) -> DataFrame:
    """(doc_id, size_class, h): of every class the document's shingle hashes up to the class's threshold."""
    order = sorted(tops, key=lambda k: -tops[k])
    found = _shingles(rows, "doc_id", n)
    if not order:
        return found.select("doc_id", F.lit(0).alias("size_class"), "h").limit(0)
    # The classes with a threshold of at least h are the first ones in falling order.
    many = sum((F.when(F.col("h") <= F.lit(tops[k]), 1).otherwise(0) for k in order), F.lit(0))
    near = found.where(F.col("h") <= F.lit(tops[order[0]]))
    return near.select("doc_id", F.explode(F.slice(F.array(*[F.lit(k) for k in order]), F.lit(1), many)).alias("size_class"), "h")


def _small(rows: DataFrame, width: int | Column = 48) -> DataFrame:
    """The rows, to be broadcast if all of them are few bytes."""
    return F.broadcast(rows) if fits(rows, width, BROADCAST) else rows


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document and item it contains.

    Containment is the part of the item's distinct word n-grams that the
    document has.  Items and documents of fewer than n words, null and empty
    texts match nothing; null ids are not reported.  A repeated row of a
    document counts once.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.coalesce("text", F.lit(""))).alias("w"))
    items = items.where(F.col("item_id").isNotNull()).dropDuplicates()
    texts = id_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    rows = texts.select("doc_id", words(F.col("text")).alias("w"))
    sketch = materialize(sketches(items, n, containment), "items")
    # One threshold for each size class, which are at most 31.
    tops = {x.size_class: x.top for x in sketch.groupBy("size_class").agg(F.max("h").alias("top")).collect()}
    whole = items.where(F.size("w") >= n)
    small = fits(whole, F.octet_length(F.array_join("w", " ")) * n + F.size("w") * 16 * n, BROADCAST)
    whole = whole.select("item_id", _exact(n).alias("item"))
    whole = F.broadcast(whole) if small else whole
    met = document_sketches(rows, tops, n).join(_small(sketch), ["size_class", "h"]).select("doc_id", "item_id").distinct()
    met = materialize(met, "met")
    # Candidates are written and measured; only many of them need the texts shuffled, which are split into words after that.
    found = texts.join(_small(met), "doc_id").select("doc_id", "item_id", words(F.col("text")).alias("w"))
    checked = found.join(whole, "item_id").select("doc_id", "item_id", "item", _exact(n).alias("doc"))
    shared = checked.select("doc_id", "item_id", F.size(F.array_intersect("item", "doc")).cast("long").alias("n_shared"), F.size("item").cast("long").alias("n_item"))
    shared = shared.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return shared.where(F.col("n_shared") >= F.ceil(F.col("n_item") * F.lit(containment) - 1e-9)).dropDuplicates(["doc_id", "item_id"])


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", nulls: bool = False, **options) -> DataFrame:
    """The documents that contain no item, with all their columns.

    Rows with a null id stay unsearched; with ``nulls`` they are searched as
    well, each by itself.
    """
    name, row = free_name(docs.columns, "_hit"), free_name(docs.columns, "_row")
    hit = materialize(find(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias(name)).distinct(), "hit")
    kept = docs.join(_small(hit), docs[id_col] == F.col(name), "left_anti")
    if not nulls:
        return kept
    # Written, so that the row keys stay as they are.
    rows = materialize(docs.where(F.col(id_col).isNull()).withColumn(row, F.monotonically_increasing_id()), "nameless")
    if not rows.limit(1).count():
        return kept
    nameless = clean(rows, items, id_col=row, **options)
    return kept.where(F.col(id_col).isNotNull()).unionByName(nameless.drop(row))


ORACLE = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, n_item::BIGINT AS n_item, count(*)::DOUBLE / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= ceil(n_item * 0.8 - 1e-9)"""
