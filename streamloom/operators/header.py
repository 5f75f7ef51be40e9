"""Main headers: binary segments to nested rows, and geometry signatures, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_type

from streamloom.functions.codestream import geometry_signature, parse_main_header, signature, unsupported
from streamloom.schemas import MAIN_HEADER


def _header_type() -> pa.DataType:
    return to_arrow_type(StructType.fromDDL(f"header {MAIN_HEADER}")["header"].dataType)


def parse_headers(rows: DataFrame, data: str = "data") -> DataFrame:
    """Add ``header``, the decoded main header of a binary column, and ``unsupported``, why it has no structure.

    Malformed and null input gives a header that isn't valid.
    """
    rows = rows.drop("header", "unsupported")
    names = rows.columns
    at = names.index(data)

    kind = _header_type()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse_main_header(x) for x in b.column(at).to_pylist()]
            cols = [pa.array([h.row() for h in found], kind), pa.array([unsupported(h) for h in found], pa.string())]
            yield pa.RecordBatch.from_arrays(list(b.columns) + cols, names=[*names, "header", "unsupported"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, header {MAIN_HEADER}, unsupported string")


def signatures(rows: DataFrame, data: str = "data") -> DataFrame:
    """Add ``geom_sig`` (16 hex digits, null if malformed) and ``sod_off``."""
    rows = rows.drop("geom_sig", "sod_off")
    names = rows.columns
    at = names.index(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [geometry_signature(x or b"") for x in b.column(at).to_pylist()]
            cols = [pa.array([f"{s:016x}" if s else None for s, _ in found], pa.string()), pa.array([o for _, o in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(list(b.columns) + cols, names=[*names, "geom_sig", "sod_off"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, geom_sig string, sod_off bigint")


def byte_signatures(rows: DataFrame, data: str = "data") -> DataFrame:
    """Add ``sig`` (16 hex digits), the signature of all bytes of a binary column of any length; null for null."""
    rows = rows.drop("sig")
    names = rows.columns
    at = names.index(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = [f"{signature(x.as_py()):016x}" if x.is_valid else None for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigs, pa.string())], names=[*names, "sig"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, sig string")


def component_codings(headers: DataFrame) -> DataFrame:
    """(…, c, nl, cbw, cbh, cbs, transform): the resolved coding of every component, one row each."""
    others = [c for c in headers.columns if c not in ("header", "unsupported")]
    k = headers.where("header.valid").select(*others, F.explode("header.cocs").alias("k"))
    return k.select(*others, *[F.col(f"k.{n}").alias(n) for n in ("c", "nl", "cbw", "cbh", "cbs", "transform")])


def segments_table(headers: DataFrame) -> DataFrame:
    """One row of debugging figures per header: sizes, levels, progression, warnings."""
    h = "header."
    return headers.select(
        *[c for c in headers.columns if c not in ("header",)], F.col(h + "valid").alias("valid"), F.col(h + "sod_off").alias("sod"), F.col(h + "geom_sig").alias("geom_sig"),
        F.col(h + "siz.xsiz").alias("xsiz"), F.col(h + "siz.ysiz").alias("ysiz"), F.col(h + "siz.csiz").alias("csiz"), F.col(h + "cod.nl").alias("nl"),
        F.col(h + "cod.progression_order").alias("progression"), F.col(h + "ccap15").alias("ccap15"), F.array_join(h + "warnings", "; ").alias("warnings"))
