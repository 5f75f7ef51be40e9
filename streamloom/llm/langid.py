"""Language identification by compression.

One zstandard raw-content dictionary per language is cut from a bounded sample
of labelled texts.  A text is encoded with every dictionary; the language whose
dictionary gives the fewest bytes wins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.common import map_arrow, slices

#: Bounds of the training sample: rows of a language, bytes of the lines kept of them, bytes of a dictionary.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 800, 4 << 20, 1 << 20
#: Lines of a sample are cut after this many characters.
LINE = 1000
#: Texts are encoded in blocks of this many bytes, each against the plain dictionary.
BLOCK_BYTES = 4096
#: Least (second - best) / second for a sure decision, for texts of any length; the README has the error rates.
MIN_MARGIN = 0.01
LEVEL = 3
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case letters; everything between words is one space."""
    return OTHER.sub(" ", text.lower())


def held_out(doc_id: F.Column) -> F.Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 4) == 2


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language from at most ``rows`` rows of each language.

    The rows with the smallest hash of the id are the sample; only ids are
    ranked, and the bounded list of ids then picks the texts.  Of all lines of
    their whole texts those with the smallest hashes are kept, about
    ``sample_bytes`` of a language.  Rows with a null language or text, or
    without a letter, are not learned from.
    """
    rows_ = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows_ = rows_.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # Only ids whose hash is under about four times the share needed are ranked, so ranking doesn't grow.
    share = rows_.groupBy("lang").agg((F.lit(4.0 * rows) / F.count("*")).alias("share"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows_.select("doc_id", "lang").join(F.broadcast(share), "lang").where(part < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id"))
    picks = near.select("doc_id", "lang", rank.alias("rank")).where(F.col("rank") <= rows)
    sample = rows_.join(F.broadcast(picks.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi")
    # One text for each id, however often it is repeated; lines are distinct, and dealt out by their own hashes.
    texts = sample.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    lines = texts.select("lang", F.explode(F.regexp_extract_all("text", F.lit(rf"[^\n]{{1,{LINE}}}"), F.lit(0))).alias("line")).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("line"), "line").rowsBetween(Window.unboundedPreceding, -1)
    kept = lines.withColumn("before", F.coalesce(F.sum(F.octet_length("line").cast("long")).over(order), F.lit(0))).where(F.col("before") < sample_bytes)
    found: dict[str, set[str]] = {}
    for r in kept.select("lang", "line").collect():
        if LETTER.search(r.line):
            found.setdefault(r.lang, set()).add(plain(r.line))
    return _dictionaries(_own_lines(found, dict_bytes), dict_bytes)


def _dictionaries(lines: dict[str, set[str]], dict_bytes: int) -> dict[str, bytes]:
    """The lines of each language in the order of their checksums, so any cut is a fair sample."""
    return {k: " ".join(sorted(v, key=lambda x: (zlib.crc32(x.encode()), x))).encode()[-dict_bytes:] for k, v in sorted(lines.items()) if v}


def _own_lines(found: dict[str, set[str]], dict_bytes: int) -> dict[str, set[str]]:
    """Lines that dictionaries made without them also take for their language.

    Texts quote passages of other languages; each half of the lines is judged
    by the other half, and what doesn't fit goes.  A language that would lose
    all its lines keeps them.
    """
    half = [{k: {x for x in v if zlib.crc32(x.encode()) % 2 == h} for k, v in found.items()} for h in (0, 1)]
    kept: dict[str, set[str]] = {k: set() for k in found}
    for h in (0, 1):
        judge = Model(_dictionaries(half[1 - h], dict_bytes))
        for lang, lines in half[h].items():
            kept[lang] |= {x for x in lines if judge.predict(x)[0] == lang}
    return {k: v or found[k] for k, v in kept.items()}


class Model:
    """Digested dictionaries, built once in each Python worker task."""

    def __init__(self, dicts: dict[str, bytes]):
        self.langs = list(dicts)
        self.coders = []
        for data in dicts.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))

    def sizes(self, text: str) -> list[int]:
        raw = plain(text).encode()
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not LETTER.search(text):
            return "und", 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else 2 * best
        return self.langs[order[0]], min(1.0, max(0.0, (second - best) / second))


def classify(docs: DataFrame, dicts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
             keep: bool = False, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Add ``lang_pred``, ``score`` (the margin, 0 to 1) and ``rejected``.

    Without ``keep`` only the id goes along.  Null or empty text and text
    without a letter: ``und``, score 0, rejected.  A tie goes to the first
    language by name; it has the narrowest margin, 0, and is rejected.  Texts of
    any length are encoded whole, in blocks.  Repeated rows each get their row,
    and no rows none; input columns named like the new ones are replaced.
    """
    new = ("lang_pred", "score", "rejected")
    rows = docs.drop(*new) if keep else docs.select(F.col(id_col), F.col(text_col))
    own = rows.schema.names
    at = own.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(dicts)
        for b in slices(batches):
            out = [model.predict(t) for t in b.column(at).to_pylist()]
            cols = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                    pa.array([x[0] == "und" or x[1] < min_margin for x in out], pa.bool_())]
            kept = [(n, b.column(i)) for i, n in enumerate(own) if keep or n != text_col]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + cols, names=[n for n, _ in kept] + list(new))

    fields = [f for f in rows.schema.fields if keep or f.name != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_arrow(rows, run, schema + ", lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fit on the labelled rows that aren't held out, then classify every row."""
    return classify(docs, fit(docs.where(~held_out(F.col("doc_id")))), **options)
