"""Codestream geometry as relations: tiles down to code-blocks, and the precinct order.

The input has a row for each stream epoch; all derived tables are keyed by it,
so every window is partitioned by epoch and nothing collapses to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.enums import SUPPORTED_PROGRESSIONS, Progression, Split
from streamloom.functions.integer import ceildiv, direction_depth, floordiv

GEOMETRY = (
    "epoch bigint, xsiz bigint, ysiz bigint, xosiz bigint, yosiz bigint, xtsiz bigint, ytsiz bigint, xtosiz bigint, ytosiz bigint, "
    "progression int, types array<int>, comps array<struct<c:int,xr:int,yr:int,nl:int,cbw:int,cbh:int,prec:array<struct<prw:int,prh:int>>>>")


def from_headers(headers: DataFrame) -> DataFrame:
    """GEOMETRY rows from (epoch, header) of valid, supported main headers."""
    h = headers.where(F.col("header.valid") & F.col("header.cod.progression_order").isin([int(p) for p in SUPPORTED_PROGRESSIONS]))
    comp = F.zip_with(
        F.col("header.siz.comps"), F.col("header.cocs"),
        lambda s, k: F.struct(k["c"].alias("c"), s["xr"].alias("xr"), s["yr"].alias("yr"), k["nl"].alias("nl"), k["cbw"].alias("cbw"), k["cbh"].alias("cbh"), k["prec"].alias("prec")))
    sizes = [F.col(f"header.siz.{n}").alias(n) for n in ("xsiz", "ysiz", "xosiz", "yosiz", "xtsiz", "ytsiz", "xtosiz", "ytosiz")]
    types = F.transform(F.slice("header.dfs.levels", 2, 32), lambda x: x["type"])
    return h.select("epoch", *sizes, F.col("header.cod.progression_order").alias("progression"), types.alias("types"), comp.alias("comps"))


def overlay(defaults: DataFrame, overrides: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Component coding parameters: the override where there is one, else the default, field by field."""
    o = overrides.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return defaults.join(o, keys, "left").select(*[c for c in defaults.columns if c not in values], *[F.coalesce(f"_{v}", v).alias(v) for v in values])


def tiles(g: DataFrame) -> DataFrame:
    """The full grid of tiles, clipped to the image."""
    ntx, nty = ceildiv(F.col("xsiz") - F.col("xtosiz"), F.col("xtsiz")), ceildiv(F.col("ysiz") - F.col("ytosiz"), F.col("ytsiz"))
    t = g.withColumn("ntx", ntx).withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), ntx * nty - 1)))
    p, q = F.col("t") % F.col("ntx"), floordiv(F.col("t"), F.col("ntx"))
    return t.withColumns({
        "x0": F.greatest(F.col("xtosiz") + p * F.col("xtsiz"), "xosiz"), "x1": F.least(F.col("xtosiz") + (p + 1) * F.col("xtsiz"), "xsiz"),
        "y0": F.greatest(F.col("ytosiz") + q * F.col("ytsiz"), "yosiz"), "y1": F.least(F.col("ytosiz") + (q + 1) * F.col("ytsiz"), "ysiz")})


def tile_components(g: DataFrame) -> DataFrame:
    t = tiles(g).withColumn("k", F.explode("comps"))
    s = {"x": F.col("k.xr"), "y": F.col("k.yr")}
    rect = {f"tc{n}": ceildiv(n, s[n[0]].cast("bigint")) for n in ("x0", "y0", "x1", "y1")}
    return t.withColumns({"c": F.col("k.c").cast("bigint"), "nl": F.col("k.nl").cast("bigint")} | rect)


def _pow2(e: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), e.cast("int"))


def resolutions(g: DataFrame) -> DataFrame:
    """Resolution rectangles, precinct counts, direction and number of bands."""
    r = tile_components(g).withColumn("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nl"))))
    r = r.withColumns({
        "dx": direction_depth(F.col("types"), (F.col("nl") - F.col("r")).cast("int"), Split.VERT), "dy": direction_depth(F.col("types"), (F.col("nl") - F.col("r")).cast("int"), Split.HORZ),
        "dir": F.when(F.col("r") == 0, 0).otherwise(F.get("types", (F.col("nl") - F.col("r")).cast("int"))).cast("bigint"),
        "pw": _pow2(F.get("k.prec", F.col("r").cast("int"))["prw"]), "ph": _pow2(F.get("k.prec", F.col("r").cast("int"))["prh"])})
    r = r.withColumns({f"r{n}": ceildiv(f"tc{n}", _pow2(F.col(d))) for n, d in (("x0", "dx"), ("y0", "dy"), ("x1", "dx"), ("y1", "dy"))})
    count = {f"np{a}": F.when(F.col(f"r{b}1") > F.col(f"r{b}0"), ceildiv(f"r{b}1", F.col(p)) - floordiv(F.col(f"r{b}0"), F.col(p))).otherwise(F.lit(0)).cast("bigint") for a, b, p in (("w", "x", "pw"), ("h", "y", "ph"))}
    return r.withColumns(count | {"n_bands": F.when(F.col("dir") == Split.BOTH, 3).otherwise(1).cast("bigint")})


def _bands(r: DataFrame) -> DataFrame:
    b = r.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bands") - 1)))
    i = F.when(F.col("n_bands") == 1, 0).otherwise(F.col("b") + 1)
    return b.withColumns({"xob": (i % 2).cast("bigint"), "yob": floordiv(i, 2)})


def bands(g: DataFrame) -> DataFrame:
    """Sub-band rectangles."""
    b = _bands(resolutions(g)).withColumn("nb", F.when(F.col("r") == 0, F.col("nl")).otherwise(F.col("nl") - F.col("r") + 1))
    half = _pow2(F.greatest(F.col("nb") - 1, F.lit(0)))

    def both(n: str, off: str) -> Column:
        return ceildiv(F.col(f"tc{n}") - half * F.col(off), _pow2(F.col("nb")))

    # Resolution 1 of a component whose first split goes one way: its low band is what the next resolution leaves.
    one = F.get("types", (F.col("nl") - 1).cast("int"))
    depth = {a: direction_depth(F.col("types"), (F.col("nl") - 1).cast("int"), s) for a, s in (("x", Split.VERT), ("y", Split.HORZ))}

    def next_res(n: str) -> Column:
        return ceildiv(f"tc{n}", _pow2(depth[n[0]]))

    def value(n: str) -> Column:
        off = "xob" if n[0] == "x" else "yob"
        way = Split.HORZ if n[0] == "x" else Split.VERT
        halved = floordiv(F.col(f"r{n}") + 1, 2)
        rest = next_res(n) - (F.when(one == way, F.col(f"r{n}")).otherwise(F.lit(0)) if n[1] == "1" else F.lit(0))
        return (
            F.when(F.col("dir") == Split.BOTH, both(n, off))
            .when(F.col("dir") != 0, F.when(F.col("dir") == way, halved).otherwise(F.col(f"r{n}")))
            .when(one != Split.BOTH, rest)
            .otherwise(both(n, off))).cast("bigint")

    return b.withColumns({f"b{n}": value(n) for n in ("x0", "y0", "x1", "y1")})


def precincts(g: DataFrame) -> DataFrame:
    """Precinct rectangles by (epoch, t, c, r, p)."""
    r = resolutions(g).where((F.col("npw") > 0) & (F.col("nph") > 0))
    p = r.withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("npw") * F.col("nph") - 1)))
    gx = F.col("p") % F.col("npw") + floordiv(F.col("rx0"), F.col("pw"))
    gy = floordiv(F.col("p"), F.col("npw")) + floordiv(F.col("ry0"), F.col("ph"))
    return p.withColumns({"gx": gx, "gy": gy}).withColumns({
        "px0": F.greatest(F.col("gx") * F.col("pw"), "rx0"), "px1": F.least((F.col("gx") + 1) * F.col("pw"), "rx1"),
        "py0": F.greatest(F.col("gy") * F.col("ph"), "ry0"), "py1": F.least((F.col("gy") + 1) * F.col("ph"), "ry1")})


def precinct_bands(g: DataFrame) -> DataFrame:
    """The part of each band in a precinct, and its grid of code-blocks."""
    b = _bands(precincts(g))
    sx = F.when(F.col("dir").isin(int(Split.BOTH), int(Split.HORZ)), 2).otherwise(1).cast("bigint")
    sy = F.when(F.col("dir").isin(int(Split.BOTH), int(Split.VERT)), 2).otherwise(1).cast("bigint")
    b = b.withColumns({f"pb{n}": ceildiv(F.col(f"p{n}") - F.col("xob" if n[0] == "x" else "yob"), sx if n[0] == "x" else sy) for n in ("x0", "y0", "x1", "y1")})
    b = b.withColumns({"cbw": _pow2(F.col("k.cbw")), "cbh": _pow2(F.col("k.cbh"))})
    n = {f"ncb{a}": F.when(F.col(f"pb{d}1") > F.col(f"pb{d}0"), ceildiv(f"pb{d}1", F.col(f"cb{a}")) - floordiv(F.col(f"pb{d}0"), F.col(f"cb{a}"))).otherwise(F.lit(0)).cast("bigint") for a, d in (("w", "x"), ("h", "y"))}
    return b.withColumns(n)


def codeblocks(g: DataFrame) -> DataFrame:
    """Code-block rectangles, each band by its own grid."""
    b = precinct_bands(g).where((F.col("ncbw") > 0) & (F.col("ncbh") > 0))
    k = b.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ncbw") * F.col("ncbh") - 1)))
    x = F.col("cb") % F.col("ncbw") + floordiv(F.col("pbx0"), F.col("cbw"))
    y = floordiv(F.col("cb"), F.col("ncbw")) + floordiv(F.col("pby0"), F.col("cbh"))
    return k.withColumns({
        "cx0": F.greatest(x * F.col("cbw"), "pbx0"), "cx1": F.least((x + 1) * F.col("cbw"), "pbx1"),
        "cy0": F.greatest(y * F.col("cbh"), "pby0"), "cy1": F.least((y + 1) * F.col("cbh"), "pby1")})


def grid_steps(g: DataFrame) -> DataFrame:
    """Least precinct exponents over components and resolutions, as steps, and the largest number of resolutions."""
    k = g.select("epoch", F.explode("comps").alias("k"))
    r = k.select("epoch", F.col("k.nl").alias("nl"), F.explode(F.slice("k.prec", F.lit(1), F.col("k.nl") + 1)).alias("s"))
    out = r.groupBy("epoch").agg(F.min("s.prw").alias("w"), F.min("s.prh").alias("h"), (F.max("nl") + 1).cast("bigint").alias("max_resolutions"))
    return out.select("epoch", _pow2(F.col("w")).alias("step_x"), _pow2(F.col("h")).alias("step_y"), "max_resolutions")


def positions(g: DataFrame) -> DataFrame:
    """Precincts with the place on the reference grid where the progression meets them.

    A precinct is met where a multiple of its size, brought to the grid, lies;
    one that begins before its resolution is met at the tile's edge.  So the
    walk over the grid, with its test of divisibility, is a projection.
    """
    def met(grid: str, size: str, res: str, sub: str, depth: str, edge: str) -> Column:
        at = F.col(grid) * F.col(size) * F.col(f"k.{sub}") * _pow2(F.col(depth))
        return F.when(F.col(grid) * F.col(size) >= F.col(res), F.greatest(at, F.col(edge))).otherwise(F.col(edge))

    return precincts(g).withColumns({"x": met("gx", "pw", "rx0", "xr", "dx", "x0"), "y": met("gy", "ph", "ry0", "yr", "dy", "y0")})


def crp(g: DataFrame, progression: Progression | None = None) -> DataFrame:
    """(epoch, t, crp_idx, c, r, p): precincts in progression order, per epoch and tile.

    The progression is the geometry's own, or the one given for all; epochs of
    another one than PCRL and PRCL have no rows.
    """
    order = F.lit(int(progression)) if progression is not None else F.col("progression")
    at = positions(g).withColumn("_o", order).where(F.col("_o").isin([int(p) for p in SUPPORTED_PROGRESSIONS]))
    first, second = F.when(F.col("_o") == Progression.PCRL, F.col("c")).otherwise(F.col("r")), F.when(F.col("_o") == Progression.PCRL, F.col("r")).otherwise(F.col("c"))
    w = Window.partitionBy("epoch", "t").orderBy("y", "x", first, second, "p")
    # Within a component's resolution the order of places is the order of numbers.
    return at.select("epoch", "t", (F.row_number().over(w) - 1).cast("bigint").alias("crp_idx"), "c", "r", "p")


def crp_by_grid(g: DataFrame, progression: Progression) -> DataFrame:
    """The same by a walk of the grid: every place, component and resolution, kept where divisible.

    For checks of ``crp``; the grid is much larger than the precincts.
    """
    r = resolutions(g).join(grid_steps(g), "epoch")
    places = r
    for a in "xy":
        step = F.col(f"step_{a}")
        marks = F.sequence(ceildiv(F.col(f"{a}0"), step) * step, F.greatest(F.col(f"{a}1") - 1, ceildiv(F.col(f"{a}0"), step) * step), step)
        places = places.withColumn(f"_{a}", F.explode(F.array_distinct(F.concat(F.array(F.col(f"{a}0")), marks))))

    def hit(a: str, d: str, size: str) -> Column:
        span = F.col(size) * _pow2(F.col(d))
        return (F.pmod(F.col(f"_{a}"), span * F.col(f"k.{a}r")) == 0) | ((F.col(f"_{a}") == F.col(f"{a}0")) & (F.pmod(F.col(f"r{a}0") * _pow2(F.col(d)), span) != 0))

    kept = places.where((F.col("npw") > 0) & (F.col("nph") > 0) & (F.col("_x") < F.col("x1")) & (F.col("_y") < F.col("y1")) & hit("x", "dx", "pw") & hit("y", "dy", "ph"))
    p = F.row_number().over(Window.partitionBy("epoch", "t", "c", "r").orderBy("_y", "_x")) - 1
    inner = ("c", "r") if progression == Progression.PCRL else ("r", "c")
    order = F.row_number().over(Window.partitionBy("epoch", "t").orderBy("_y", "_x", *inner)) - 1
    return kept.select("epoch", "t", order.cast("bigint").alias("crp_idx"), "c", "r", p.cast("bigint").alias("p"))


def pid_index(order: DataFrame, components: int = 3) -> DataFrame:
    """(epoch, c, s, pid, crp_idx): a component's precincts in order are its packet identifiers."""
    first = order.where("t = 0")
    s = (F.row_number().over(Window.partitionBy("epoch", "c").orderBy("crp_idx")) - 1).cast("bigint")
    return first.select("epoch", "c", s.alias("s"), "crp_idx").withColumn("pid", (F.col("c") + F.col("s") * components).cast("bigint"))


def resolve_pids(signals: DataFrame, index: DataFrame, components: int = 3) -> DataFrame:
    """Signals (epoch, pid, …) with their ``crp_idx``; null for identifiers out of range."""
    by = index.select("epoch", F.col("pid").alias("_pid"), F.col("epoch").alias("_epoch"), "crp_idx").drop("epoch")
    return signals.join(by, (F.col("epoch") == F.col("_epoch")) & (F.col("pid") == F.col("_pid")), "left").drop("_epoch", "_pid")
