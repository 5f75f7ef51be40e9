"""Small constructed inputs and derived relations that queries and tests share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A main header: 64 x 64, three components, one level in both directions, precincts of 32 x 32, PCRL.
HEADER = bytes.fromhex(
    "ff4fff51002f0000000000400000004000000000000000000000004000000040"
    "00000000000000000003070101070101070101ff52000e010300010001050048"
    "015555ff72000600000140ff5c00072040404040ff90000a0000000000000001ff93")
COMMENT = bytes.fromhex("ff640008000172617465")
SOT_AT = HEADER.index(b"\xff\x90")
VARIANTS = {
    "pcrl": HEADER, "comment": HEADER[:SOT_AT] + COMMENT + HEADER[SOT_AT:],
    "prcl": HEADER.replace(bytes.fromhex("ff52000e0103"), bytes.fromhex("ff52000e0105")),
    "wide": HEADER.replace(bytes.fromhex("00400000004000000000"), bytes.fromhex("00800000004000000000"), 1).replace(bytes.fromhex("0000004000000040" + "0" * 16 + "0003"), bytes.fromhex("0000008000000040" + "0" * 16 + "0003")),
}
EOC = b"\xff\xd9"
#: Frames: all precincts empty; or eight code-blocks of two bytes in the first one.
EMPTY = HEADER + bytes(15) + EOC
ONE_HT = HEADER + bytes.fromhex("e2c58b162c58b100101112131415161718191a1b1c1d1e1f") + bytes(14) + EOC


def geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEOMETRY rows from the distinct sizes of ``part``: an epoch for each, of several tiles, levels and directions."""
    s = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("bigint").alias("s")).distinct()
    prec = "transform(sequence(0, 3), r -> struct(cast(5 + r % 2 as int) AS prw, cast(5 as int) AS prh))"
    sub = "cast(CASE WHEN c = 0 THEN 1 ELSE 1 + s % 2 END as int)"
    return s.selectExpr(
        "s AS epoch", "64 + 8 * s AS xsiz", "48 + 6 * s AS ysiz", "s % 3 AS xosiz", "s % 2 AS yosiz", "160L AS xtsiz", "120L AS ytsiz", "0L AS xtosiz", "0L AS ytosiz", "3 AS progression",
        "transform(sequence(1, 3), l -> cast(1 + (s + l) % 3 as int)) AS types",
        f"transform(sequence(0, 2), c -> struct(c, {sub} AS xr, {sub} AS yr, cast(1 + s % 3 as int) AS nl, 4 AS cbw, 3 AS cbh, {prec} AS prec)) AS comps")


#: The same and all that follows from it, in SQL.
SQL_GEOMETRY = """g AS (SELECT DISTINCT p_size::BIGINT AS s FROM part),
t AS (SELECT *, greatest(t % ntx * 160, xo) AS x0, least((t % ntx + 1) * 160, xs) AS x1, greatest(t // ntx * 120, yo) AS y0, least((t // ntx + 1) * 120, ys) AS y1 FROM (
  SELECT s AS epoch, s, 64 + 8 * s AS xs, 48 + 6 * s AS ys, s % 3 AS xo, s % 2 AS yo, (64 + 8 * s + 159) // 160 AS ntx, unnest(range(((64 + 8 * s + 159) // 160) * ((48 + 6 * s + 119) // 120))) AS t FROM g)),
tc AS (SELECT *, (x0 + sub - 1) // sub AS tcx0, (x1 + sub - 1) // sub AS tcx1, (y0 + sub - 1) // sub AS tcy0, (y1 + sub - 1) // sub AS tcy1, 1 + s % 3 AS nl,
  [1 + (s + 1) % 3, 1 + (s + 2) % 3, 1 + (s + 3) % 3] AS ty FROM (SELECT *, CASE WHEN c = 0 THEN 1 ELSE 1 + s % 2 END AS sub FROM t, (SELECT unnest(range(3)) AS c))),
r0 AS (SELECT *, len(list_filter(ty[1:(nl - r)], lambda x: x <> 3)) AS dx, len(list_filter(ty[1:(nl - r)], lambda x: x <> 2)) AS dy, CASE WHEN r = 0 THEN 0 ELSE ty[nl - r + 1] END AS dir, (1::BIGINT << (5 + r % 2)::BIGINT) AS pw, 32::BIGINT AS ph
  FROM (SELECT *, unnest(range(nl + 1)) AS r FROM tc)),
r1 AS (SELECT *, (tcx0 + (1 << dx) - 1) // (1 << dx) AS rx0, (tcx1 + (1 << dx) - 1) // (1 << dx) AS rx1, (tcy0 + (1 << dy) - 1) // (1 << dy) AS ry0, (tcy1 + (1 << dy) - 1) // (1 << dy) AS ry1 FROM r0),
r2 AS (SELECT *, CASE WHEN rx1 > rx0 THEN (rx1 + pw - 1) // pw - rx0 // pw ELSE 0 END AS npw, CASE WHEN ry1 > ry0 THEN (ry1 + ph - 1) // ph - ry0 // ph ELSE 0 END AS nph, CASE WHEN dir = 1 THEN 3 ELSE 1 END AS n_bands FROM r1),
p0 AS (SELECT *, p % npw + rx0 // pw AS gx, p // npw + ry0 // ph AS gy FROM (SELECT *, unnest(range(npw * nph)) AS p FROM r2 WHERE npw > 0 AND nph > 0)),
p1 AS (SELECT *, greatest(gx * pw, rx0) AS px0, least((gx + 1) * pw, rx1) AS px1, greatest(gy * ph, ry0) AS py0, least((gy + 1) * ph, ry1) AS py1,
  CASE WHEN gx * pw >= rx0 THEN greatest(gx * pw * sub * (1 << dx), x0) ELSE x0 END AS mx, CASE WHEN gy * ph >= ry0 THEN greatest(gy * ph * sub * (1 << dy), y0) ELSE y0 END AS my FROM p0),
pb AS (SELECT *, CASE WHEN pbx1 > pbx0 THEN (pbx1 + 15) // 16 - pbx0 // 16 ELSE 0 END AS ncbw, CASE WHEN pby1 > pby0 THEN (pby1 + 7) // 8 - pby0 // 8 ELSE 0 END AS ncbh FROM (
  SELECT *, (px0 - xob + sx - 1) // sx AS pbx0, (px1 - xob + sx - 1) // sx AS pbx1, (py0 - yob + sy - 1) // sy AS pby0, (py1 - yob + sy - 1) // sy AS pby1 FROM (
    SELECT *, CASE WHEN n_bands = 1 THEN 0 ELSE (b + 1) % 2 END AS xob, CASE WHEN n_bands = 1 THEN 0 ELSE (b + 1) // 2 END AS yob, CASE WHEN dir IN (1, 2) THEN 2 ELSE 1 END AS sx, CASE WHEN dir IN (1, 3) THEN 2 ELSE 1 END AS sy
    FROM (SELECT *, unnest(range(n_bands)) AS b FROM p1))))"""
