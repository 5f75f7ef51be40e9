"""The operators as queries over the star schema's tables, with their SQL.

Packets come from ``events``, geometries from ``part``, codestream bytes from
``documents``; see the modules of derived relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.enums import Progression, dimension
from streamloom.functions import integer, rtp
from streamloom.operators import frames, geometry, header, packets, reorder, stats
from streamloom.plans.fixtures import EMPTY, EOC, HEADER, ONE_HT, SQL_GEOMETRY, VARIANTS, geometries
from streamloom.plans.packet_stream import FRAME, SQL, SQL_DATAGRAMS, arrivals, datagrams, sent_packets
from streamloom.sources import sinks
from streamloom.sources.files import inject_loss, packetize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(n).cast("bigint").alias(n) for n in names])


BYTE = "('0x' || substr(h, 2 * ({0}) + 1, {1}))::BIGINT"


def _be(at, n):
    return BYTE.format(at, 2 * n)


SQL_RTP = f"""WITH {SQL}, {SQL_DATAGRAMS},
f AS (SELECT *, length(h) // 2 AS n, {_be(0, 1)} AS b0 FROM dg),
v AS (SELECT *, b0 // 64 AS version, CASE WHEN b0 // 32 % 2 = 1 THEN {_be("n - 1", 1)} ELSE 0 END AS pad_len, 12 + b0 % 16 * 4 AS base FROM f),
w AS (SELECT *, CASE WHEN b0 // 16 % 2 = 0 THEN base WHEN n >= base + 4 THEN base + 4 + {_be("base + 2", 2)} * 4 END AS hdr_len FROM v),
d AS (SELECT *, CASE WHEN n < 12 THEN 'short' WHEN version <> 2 THEN 'version' WHEN hdr_len IS NULL OR hdr_len > n THEN 'header' WHEN pad_len > n - hdr_len THEN 'padding' WHEN n - pad_len > 9216 THEN 'oversize' WHEN n - pad_len - hdr_len < 8 THEN 'payload' END AS drop_reason FROM w)
"""


@query(SQL_RTP + f"""SELECT stream_id, arrival_id, version, {_be(1, 1)} >= 128 AS marker, {_be(1, 1)} % 128 AS pt, {_be(2, 2)} AS seq, {_be(4, 4)} AS rtp_ts, {_be(8, 4)} AS ssrc, hdr_len, pad_len,
n - hdr_len - pad_len AS payload_len, {_be("hdr_len", 1)} // 64 AS mh, {_be("hdr_len + 1", 1)} >= 128 AS ordb, {_be("hdr_len + 4", 4)} // 1048576 AS pos, {_be("hdr_len + 4", 4)} % 1048576 AS pid FROM d WHERE drop_reason IS NULL""")
def rtp_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rtp.validate(datagrams(spark, sf_dir)).withColumn("ph", rtp.sub_header(F.col("payload"))).withColumn("payload_len", F.length("payload"))
    return d.select("stream_id", "arrival_id", "version", "marker", "pt", "seq", "rtp_ts", "ssrc", F.col("hdr_len").cast("bigint").alias("hdr_len"), F.col("pad_len").cast("bigint").alias("pad_len"),
                    F.col("payload_len").cast("bigint").alias("payload_len"), F.col("ph.mh").cast("bigint").alias("mh"), F.col("ph.ordb").alias("ordb"), F.col("ph.pos").cast("bigint").alias("pos"), F.col("ph.pid").cast("bigint").alias("pid"))


@query(SQL_RTP + "SELECT stream_id, coalesce(drop_reason, 'ok') AS verdict, count(*) AS n FROM d GROUP BY ALL")
def rtp_validate(spark, sf_dir):
    return rtp.decode(datagrams(spark, sf_dir)).groupBy("stream_id", F.coalesce("drop_reason", F.lit("ok")).alias("verdict")).agg(F.count("*").alias("n"))


SQL_T1 = f"""WITH {SQL},
c0 AS (SELECT *, first_value(seq_ext) OVER w AS f, row_number() OVER (PARTITION BY stream_id, seq_ext ORDER BY arrival_id) AS copy,
  max(seq_ext) OVER (PARTITION BY stream_id ORDER BY arrival_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM arr WINDOW w AS (PARTITION BY stream_id ORDER BY arrival_id)),
c AS (SELECT *, CASE WHEN seq_ext < f OR coalesce(ahead, seq_ext) >= seq_ext + 64 THEN 'late' WHEN copy > 1 THEN 'duplicate' ELSE 'accepted' END AS status FROM c0),
acc AS (SELECT *, coalesce(seq_ext <> lag(seq_ext) OVER w + 1, false) AS gap, max(seq_ext) OVER (PARTITION BY stream_id) AS mx FROM c WHERE status = 'accepted' WINDOW w AS (PARTITION BY stream_id ORDER BY seq_ext)),
held AS (SELECT *, max(CASE WHEN gap AND seq_ext - 1 > mx - 64 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq_ext ROWS UNBOUNDED PRECEDING) AS h FROM acc),
o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq_ext) AS out_no FROM held WHERE h = 0),
fr AS (SELECT *, sum(CASE WHEN mh >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq_ext ROWS UNBOUNDED PRECEDING)::BIGINT AS frame_id FROM o),
ch AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY stream_id, frame_id ORDER BY seq_ext ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", row_number() OVER (PARTITION BY stream_id, frame_id ORDER BY seq_ext) - 1 AS chunk_no FROM fr),
fo AS (SELECT stream_id, frame_id, count(*) AS n_packets, sum(size)::BIGINT AS n_bytes, min(seq_ext) AS first_seq, CASE WHEN bool_or(gap AND mh = 0) THEN 1 WHEN NOT bool_or(marker) THEN 3 ELSE 0 END::BIGINT AS abort_reason FROM fr WHERE frame_id > 0 GROUP BY ALL),
sg AS (SELECT stream_id, frame_id, chunk_no, "offset" + event_id % 4096 AS byte_offset, event_id * 31 % 1048576 AS pid FROM ch WHERE event_id % 4 = 0)
"""


def _ordered(spark, sf_dir):
    return reorder.reorder(arrivals(spark, sf_dir))


def _numbered(spark, sf_dir):
    return frames.number_frames(_ordered(spark, sf_dir))


def _chunks(spark, sf_dir):
    e = F.col("event_id")
    return frames.chunk_offsets(_numbered(spark, sf_dir)).withColumns({"ordb": e % 4 == 0, "pos": e % 4096, "pid": e * 31 % 1048576})


def _signals(spark, sf_dir):
    return frames.resync_points(_chunks(spark, sf_dir))


@query(f"WITH {SQL} SELECT stream_id, seq_ext, event_id, size, rtp_ts, mh, marker FROM sent")
def sent_stream(spark, sf_dir):
    return sent_packets(spark, sf_dir)


@query(SQL_T1 + "SELECT stream_id, arrival_id, seq_ext, status FROM c")
def jitter_classify(spark, sf_dir):
    return reorder.classify(arrivals(spark, sf_dir)).select("stream_id", "arrival_id", "seq_ext", "status")


@query(SQL_T1 + "SELECT stream_id, seq_ext, event_id, gap, out_no FROM o")
def jitter_reorder(spark, sf_dir):
    return _ordered(spark, sf_dir).select("stream_id", "seq_ext", "event_id", "gap", "out_no")


@query(SQL_T1 + """, s AS (SELECT stream_id, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'late') AS late, arg_min(seq_ext, arrival_id) AS f0, max(seq_ext) AS m0 FROM c GROUP BY stream_id),
l AS (SELECT s.*, greatest(m0 - 64 - f0 + 1, 0) - (SELECT count(*) FROM c WHERE c.stream_id = s.stream_id AND status = 'accepted' AND seq_ext <= m0 - 64) AS lost FROM s)
SELECT stream_id, accepted, duplicate, late, lost AS net_lost, 0::BIGINT AS slot_busy, 0::BIGINT AS queue_full, lost AS total_drops FROM l""")
def loss_stats(spark, sf_dir):
    return reorder.loss_stats(arrivals(spark, sf_dir))


@query(f"WITH {SQL} SELECT stream_id, arrival_id, (seq_ext + 65000) % 65536 AS seq, seq_ext + 65000 AS seq_ext FROM arr")
def seq_unwrap(spark, sf_dir):
    wrapped = arrivals(spark, sf_dir).select("stream_id", "arrival_id", ((F.col("seq_ext") + 65000) % 65536).alias("seq"))
    return reorder.unwrap(wrapped)


@query(f"WITH {SQL}, k AS (SELECT * FROM sent WHERE event_id % 37 <> 0) SELECT stream_id, seq_ext, coalesce(seq_ext <> lag(seq_ext) OVER (PARTITION BY stream_id ORDER BY seq_ext) + 1, false) AS gap FROM k")
def gap_flags(spark, sf_dir):
    return frames.gap_flags(sent_packets(spark, sf_dir).where("event_id % 37 <> 0")).select("stream_id", "seq_ext", "gap")


@query(f"WITH {SQL}, k AS (SELECT *, event_id % 37 = 0 AS lost FROM sent), n AS (SELECT *, coalesce(lag(lost) OVER (PARTITION BY stream_id ORDER BY seq_ext), false) AS gap FROM k) SELECT stream_id, seq_ext, gap FROM n WHERE NOT lost")
def loss_injection(spark, sf_dir):
    return inject_loss(sent_packets(spark, sf_dir), F.col("event_id") % 37 == 0, order="seq_ext").select("stream_id", "seq_ext", "gap")


@query(SQL_T1 + 'SELECT stream_id, frame_id, chunk_no, seq_ext, size, "offset" FROM ch')
def frame_assembly(spark, sf_dir):
    return _chunks(spark, sf_dir).select("stream_id", "frame_id", "chunk_no", "seq_ext", "size", "offset")


@query(SQL_T1 + "SELECT *, abort_reason = 0 AS intact FROM fo")
def frame_outcomes(spark, sf_dir):
    return frames.outcomes(_numbered(spark, sf_dir))


@query(SQL_T1 + "SELECT stream_id, count(*) AS total_frames, count(*) FILTER (abort_reason <> 0) AS trunc_frames, count(*) FILTER (abort_reason = 0) AS ready_frames, sum(n_bytes)::BIGINT AS n_bytes FROM fo GROUP BY stream_id")
def frame_counts(spark, sf_dir):
    return frames.frame_counts(frames.outcomes(_numbered(spark, sf_dir)))


@query(SQL_T1 + "SELECT * FROM sg")
def resync_offsets(spark, sf_dir):
    return _signals(spark, sf_dir)


@query(SQL_T1 + """, fl AS (SELECT stream_id, frame_id, "offset" + size // 2 AS byte_offset FROM ch), sn AS (SELECT stream_id, frame_id, byte_offset, min(pid) AS pid FROM sg GROUP BY ALL)
SELECT fl.stream_id, fl.frame_id, fl.byte_offset, sn.byte_offset AS signal_offset, sn.pid AS signal_pid FROM fl ASOF LEFT JOIN sn ON fl.stream_id = sn.stream_id AND fl.frame_id = sn.frame_id AND fl.byte_offset < sn.byte_offset""")
def next_signal_asof(spark, sf_dir):
    """The middle of every chunk is a failure position."""
    c = _chunks(spark, sf_dir)
    failures = c.select("stream_id", "frame_id", F.expr("offset + size div 2").alias("byte_offset"))
    return frames.next_signal(failures, frames.resync_points(c))


@query(SQL_T1 + """SELECT sg.stream_id, sg.frame_id, sg.byte_offset, sg.pid, ch.chunk_no AS in_chunk, sg.byte_offset - ch."offset" AS "at" FROM sg
LEFT JOIN ch ON ch.stream_id = sg.stream_id AND ch.frame_id = sg.frame_id AND sg.byte_offset >= ch."offset" AND sg.byte_offset < ch."offset" + ch.size""")
def chunk_lookup(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return frames.locate(frames.resync_points(c).drop("chunk_no"), c)


@query(f"""WITH {SQL}, k AS (SELECT *, (rtp_ts - first_value(rtp_ts) OVER (PARTITION BY stream_id ORDER BY seq_ext) + 4294967296) % 4294967296 AS d FROM sent)
SELECT stream_id, d // 45000 AS interval_no, count(*) AS packets, sum(size)::BIGINT AS bytes, count(*) FILTER (marker) AS frames, count(*) FILTER (marker) * 2.0::DOUBLE AS frames_per_second FROM k GROUP BY ALL""")
def interval_stats(spark, sf_dir):
    return stats.interval_stats(sent_packets(spark, sf_dir))


@query(SQL_T1 + """, z AS (SELECT *, first_seq % 3 = 0 AS failed, abort_reason <> 0 AS neutral FROM fo),
i AS (SELECT *, sum(CASE WHEN NOT neutral AND NOT failed THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS isl FROM z)
SELECT stream_id, frame_id, sum(CASE WHEN NOT neutral AND failed THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, isl ORDER BY frame_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM i""")
def failure_streak(spark, sf_dir):
    f = frames.outcomes(_numbered(spark, sf_dir)).withColumns({"failed": F.col("first_seq") % 3 == 0, "neutral": F.col("abort_reason") != 0})
    return frames.failure_streaks(f).select("stream_id", "frame_id", "streak")


@query(SQL_T1 + """, z AS (SELECT stream_id, frame_id, n_bytes % 3 AS sig FROM fo), y AS (SELECT *, lag(sig) OVER (PARTITION BY stream_id ORDER BY frame_id) AS b FROM z)
SELECT stream_id, frame_id, sum(CASE WHEN b IS NULL OR b <> sig THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch_no, coalesce(b <> sig, false) AS relatch FROM y""")
def geometry_changes(spark, sf_dir):
    f = frames.outcomes(_numbered(spark, sf_dir)).withColumn("geom_sig", F.col("n_bytes") % 3)
    return frames.geometry_changes(f).select("stream_id", "frame_id", "epoch_no", "relatch")


G = f"WITH {SQL_GEOMETRY}\n"


@query(G + "SELECT epoch, t, x0, x1, y0, y1 FROM t")
def tile_grid(spark, sf_dir):
    return _longs(geometry.tiles(geometries(spark, sf_dir)), "epoch", "t", "x0", "x1", "y0", "y1")


@query(G + "SELECT epoch, t, c, nl, tcx0, tcx1, tcy0, tcy1 FROM tc")
def tile_components(spark, sf_dir):
    return _longs(geometry.tile_components(geometries(spark, sf_dir)), "epoch", "t", "c", "nl", "tcx0", "tcx1", "tcy0", "tcy1")


RES = ("epoch", "t", "c", "r")


@query(G + "SELECT epoch, t, c, r, dir::BIGINT AS dir, rx0, rx1, ry0, ry1, npw, nph, n_bands::BIGINT AS n_bands FROM r2")
def resolution_grid(spark, sf_dir):
    return _longs(geometry.resolutions(geometries(spark, sf_dir)), *RES, "dir", "rx0", "rx1", "ry0", "ry1", "npw", "nph", "n_bands")


@query(G + """, b0 AS (SELECT *, CASE WHEN n_bands = 1 THEN 0 ELSE (b + 1) % 2 END AS xob, CASE WHEN n_bands = 1 THEN 0 ELSE (b + 1) // 2 END AS yob, CASE WHEN r = 0 THEN nl ELSE nl - r + 1 END AS nb FROM (SELECT *, unnest(range(n_bands)) AS b FROM r2)),
n AS (SELECT epoch, t, c, rx0 AS nx0, rx1 AS nx1, ry0 AS ny0, ry1 AS ny1, dir AS ndir FROM r2 WHERE r = 1),
q AS (SELECT b0.*, n.* EXCLUDE (epoch, t, c), CASE WHEN nb > 0 THEN 1 << (nb - 1) ELSE 1 END AS hf, 1 << nb AS fl FROM b0 JOIN n USING (epoch, t, c))
SELECT epoch, t, c, r, b,
CASE WHEN dir = 1 OR (dir = 0 AND ndir = 1) THEN (tcx0 - hf * xob + fl - 1) // fl WHEN dir = 2 THEN (rx0 + 1) // 2 WHEN dir = 3 THEN rx0 ELSE nx0 END::BIGINT AS bx0,
CASE WHEN dir = 1 OR (dir = 0 AND ndir = 1) THEN (tcx1 - hf * xob + fl - 1) // fl WHEN dir = 2 THEN (rx1 + 1) // 2 WHEN dir = 3 THEN rx1 WHEN ndir = 2 THEN nx1 - rx1 ELSE nx1 END::BIGINT AS bx1,
CASE WHEN dir = 1 OR (dir = 0 AND ndir = 1) THEN (tcy0 - hf * yob + fl - 1) // fl WHEN dir = 3 THEN (ry0 + 1) // 2 WHEN dir = 2 THEN ry0 ELSE ny0 END::BIGINT AS by0,
CASE WHEN dir = 1 OR (dir = 0 AND ndir = 1) THEN (tcy1 - hf * yob + fl - 1) // fl WHEN dir = 3 THEN (ry1 + 1) // 2 WHEN dir = 2 THEN ry1 WHEN ndir = 3 THEN ny1 - ry1 ELSE ny1 END::BIGINT AS by1 FROM q""")
def band_rects(spark, sf_dir):
    return _longs(geometry.bands(geometries(spark, sf_dir)), *RES, "b", "bx0", "bx1", "by0", "by1")


@query(G + "SELECT epoch, t, c, r, p, px0, px1, py0, py1 FROM p1")
def precinct_rects(spark, sf_dir):
    return _longs(geometry.precincts(geometries(spark, sf_dir)), *RES, "p", "px0", "px1", "py0", "py1")


@query(G + "SELECT epoch, t, c, r, p, b, pbx0, pbx1, pby0, pby1, ncbw, ncbh FROM pb")
def precinct_bands(spark, sf_dir):
    return _longs(geometry.precinct_bands(geometries(spark, sf_dir)), *RES, "p", "b", "pbx0", "pbx1", "pby0", "pby1", "ncbw", "ncbh")


@query(G + """, k AS (SELECT *, cb % ncbw + pbx0 // 16 AS kx, cb // ncbw + pby0 // 8 AS ky FROM (SELECT *, unnest(range(ncbw * ncbh)) AS cb FROM pb WHERE ncbw > 0 AND ncbh > 0))
SELECT epoch, t, c, r, p, b, cb, greatest(kx * 16, pbx0) AS cx0, least((kx + 1) * 16, pbx1) AS cx1, greatest(ky * 8, pby0) AS cy0, least((ky + 1) * 8, pby1) AS cy1 FROM k""")
def codeblock_grid(spark, sf_dir):
    return _longs(geometry.codeblocks(geometries(spark, sf_dir)), *RES, "p", "b", "cb", "cx0", "cx1", "cy0", "cy1")


@query(G + "SELECT s AS epoch, 32::BIGINT AS step_x, 32::BIGINT AS step_y, 2 + s % 3 AS max_resolutions FROM g")
def grid_steps(spark, sf_dir):
    return _longs(geometry.grid_steps(geometries(spark, sf_dir)), "epoch", "step_x", "step_y", "max_resolutions")


CRP = "SELECT epoch, t, row_number() OVER (PARTITION BY epoch, t ORDER BY my, mx, {0}, p) - 1 AS crp_idx, c, r, p FROM p1"


@query(G + CRP.format("c, r"))
def crp_pcrl(spark, sf_dir):
    return geometry.crp(geometries(spark, sf_dir), Progression.PCRL)


@query(G + CRP.format("r, c"))
def crp_prcl(spark, sf_dir):
    return geometry.crp(geometries(spark, sf_dir), Progression.PRCL)


SQL_PID = G + f", crp AS ({CRP.format('c, r')}), px AS (SELECT epoch, c, row_number() OVER (PARTITION BY epoch, c ORDER BY crp_idx) - 1 AS s, crp_idx FROM crp WHERE t = 0), pi AS (SELECT *, c + s * 3 AS pid FROM px)\n"


@query(SQL_PID + "SELECT epoch, c, s, pid, crp_idx FROM pi")
def pid_index(spark, sf_dir):
    return geometry.pid_index(geometry.crp(geometries(spark, sf_dir), Progression.PCRL))


def _pids(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").cast("bigint").alias("k"), F.col("p_size").cast("bigint").alias("epoch"), F.pmod(F.col("p_partkey") * 7, F.lit(100)).cast("bigint").alias("pid"))


@query(SQL_PID + "SELECT p_partkey AS k, p_size::BIGINT AS epoch, p_partkey * 7 % 100 AS pid, (p_partkey * 7 % 100) % 3 AS c, (p_partkey * 7 % 100) // 3 AS s, pi.crp_idx FROM part LEFT JOIN pi ON pi.epoch = p_size AND pi.pid = p_partkey * 7 % 100")
def pid_resolve(spark, sf_dir):
    index = geometry.pid_index(geometry.crp(geometries(spark, sf_dir), Progression.PCRL))
    found = geometry.resolve_pids(_pids(spark, sf_dir), index)
    return _longs(found.withColumns({"c": integer.pid_component(F.col("pid")), "s": integer.pid_ordinal(F.col("pid"))}), "k", "epoch", "pid", "c", "s", "crp_idx")


@query("""WITH d AS (SELECT p_partkey AS k, c, p_size % 5 + 1 AS nl, p_size % 3 + 7 AS cbw FROM part, (SELECT unnest(range(3)) AS c)), o AS (SELECT p_partkey AS k, p_partkey % 3 AS c, p_size % 4 + 1 AS nl, NULL::BIGINT AS cbw FROM part WHERE p_partkey % 2 = 0)
SELECT d.k, d.c, coalesce(o.nl, d.nl)::BIGINT AS nl, coalesce(o.cbw, d.cbw)::BIGINT AS cbw FROM d LEFT JOIN o USING (k, c)""")
def coc_overlay(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey").cast("bigint").alias("k")
    defaults = part.select(k, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("c"), (F.col("p_size") % 5 + 1).cast("bigint").alias("nl"), (F.col("p_size") % 3 + 7).cast("bigint").alias("cbw"))
    some = part.where("p_partkey % 2 = 0").select(k, (F.col("p_partkey") % 3).cast("bigint").alias("c"), (F.col("p_size") % 4 + 1).cast("bigint").alias("nl"), F.lit(None).cast("bigint").alias("cbw"))
    return geometry.overlay(defaults, some, ["k", "c"], ["nl", "cbw"])


@query("""WITH k AS (SELECT p_partkey AS k, [1 + (p_size + 1) % 3, 1 + (p_size + 2) % 3, 1 + (p_size + 3) % 3, 1 + (p_size // 2) % 3, 1] AS ty, unnest(range(6)) AS lev FROM part)
SELECT k, lev AS level, len(list_filter(ty[1:lev], lambda x: x <> 3))::BIGINT AS hor_depth, len(list_filter(ty[1:lev], lambda x: x <> 2))::BIGINT AS ver_depth FROM k""")
def dfs_depths(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    s = F.col("p_size")
    ty = F.array(*[(1 + (s + i) % 3).cast("int") for i in (1, 2, 3)], (1 + integer.floordiv(s, 2) % 3).cast("int"), F.lit(1))
    lev = F.explode(F.sequence(F.lit(0), F.lit(5)))
    rows = part.select(F.col("p_partkey").cast("bigint").alias("k"), ty.alias("ty"), lev.alias("lev"))
    return rows.select("k", F.col("lev").cast("bigint").alias("level"), integer.direction_depth(F.col("ty"), F.col("lev"), 3).alias("hor_depth"), integer.direction_depth(F.col("ty"), F.col("lev"), 2).alias("ver_depth"))


@query("""SELECT o_orderkey AS k, length(bin(o_orderkey | 1))::BIGINT - 1 AS log2, (o_orderkey + 6) // 7 AS up, (o_custkey - o_orderkey + 32768 + 6553600000::BIGINT) % 65536 - 32768 AS diff FROM orders""")
def integer_functions(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey").cast("bigint")
    return o.select(k.alias("k"), integer.int_log2(k).cast("bigint").alias("log2"), integer.ceildiv(k, 7).alias("up"), rtp.serial_difference(F.col("o_custkey").cast("bigint"), k).cast("bigint").alias("diff"))


def _streams(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = F.unhex(F.lit(HEADER.hex()))
    return docs.select(F.col("doc_id").alias("stream_id"), F.concat(head, F.coalesce("text", F.lit("")).cast("binary")).alias("content"))


SQL_PACKETS = f"""WITH s AS (SELECT doc_id AS stream_id, '{HEADER.hex().upper()}' AS hd, hex(encode(coalesce(text, ''))) AS bd FROM documents),
p AS (SELECT *, unnest(range((length(bd) // 2 + 1399) // 1400 + 1)) AS pkt_no, (length(bd) // 2 + 1399) // 1400 AS last FROM s),
k AS (SELECT stream_id, pkt_no, pkt_no = last AS marker, CASE WHEN pkt_no = 0 THEN 'C000000000000000' || hd ELSE '0000000000000000' || substr(bd, (pkt_no - 1) * 2800 + 1, 2800) END AS x FROM p)
"""


@query(SQL_PACKETS + "SELECT stream_id, pkt_no, marker, (length(x) // 2)::BIGINT AS size, md5(x) AS payload_md5 FROM k")
def packetize_streams(spark, sf_dir):
    p = packetize(_streams(spark, sf_dir))
    return p.select("stream_id", "pkt_no", "marker", F.length("payload").cast("bigint").alias("size"), F.md5(F.hex("payload").cast("binary")).alias("payload_md5"))


@query(SQL_PACKETS + "SELECT s.stream_id, (SELECT count(*) FROM k WHERE k.stream_id = s.stream_id) AS n_chunks, md5(hd || bd) AS blob_md5, 0::BIGINT AS discontinuities FROM s")
def reassemble(spark, sf_dir):
    p = packetize(_streams(spark, sf_dir)).withColumns({"bytes": rtp.body(F.col("payload")), "frame_id": F.lit(1).cast("bigint")})
    c = frames.chunk_offsets(p.withColumn("size", F.length("bytes")), seq="pkt_no")
    return frames.assemble(c).select("stream_id", "n_chunks", F.md5(F.hex("blob").cast("binary")).alias("blob_md5"), "discontinuities")


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
l AS (SELECT doc_id, list_prepend(1469598103934665603::HUGEINT, list_transform(h, lambda b: ('0x' || b)::HUGEINT)) AS x FROM d)
SELECT doc_id, lower(lpad(to_hex(list_reduce(x, lambda a, b: xor(a, b) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT)::UBIGINT), 16, '0')) AS sig FROM l""")
def fnv_signature(spark, sf_dir):
    """Signatures of whole texts; null texts are empty."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    return header.byte_signatures(d, "b").select("doc_id", "sig")


@query("""WITH k AS (SELECT doc_id, hex(encode(text)) AS h, 10 + doc_id % 20 AS n FROM documents)
SELECT doc_id, CASE WHEN length(h) >= 2 * n THEN ('0x' || substr(h, 2 * n - 1, 2))::BIGINT * 16 + ('0x' || substr(h, 2 * n - 3, 2))::BIGINT % 16 END AS scup FROM k""")
def scup_lengths(spark, sf_dir):
    """A row for every document, null where the text is shorter than the segment."""
    b, n = F.col("b"), (F.lit(10) + F.col("doc_id") % 20).cast("int")
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("b"))
    return d.select("doc_id", F.when(F.length(b) >= n, integer.scup(b, n)).cast("bigint").alias("scup"))


def _headers(spark, sf_dir):
    """Header variants dealt to the parts, so that the decoder runs over a whole table; one in 17 is cut."""
    names = sorted(VARIANTS)
    pick = F.element_at(F.array(*[F.unhex(F.lit(VARIANTS[n].hex())) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("bigint").alias("epoch"), pick.alias("data"))
    return part.withColumn("data", F.when(F.col("epoch") % 17 == 0, F.substring("data", 1, 50)).otherwise(F.col("data")))


#: What the header variants must decode to, by key: constants of the fixtures.
SQL_HEADERS = """WITH e AS (SELECT p_partkey AS epoch, p_partkey % 4 AS v, p_partkey % 17 <> 0 AS ok FROM part),
k AS (SELECT *, CASE WHEN ok THEN CASE v WHEN 2 THEN '60cd4f4a64550d47' WHEN 3 THEN 'd95f993c31807015' ELSE '640a13c1793ac515' END END AS geom_sig, CASE WHEN NOT ok THEN 0 WHEN v = 0 THEN 108 ELSE 98 END AS sod FROM e)
"""


@query(SQL_HEADERS + """SELECT epoch, CASE WHEN NOT ok THEN 'header' END AS unsupported, ok AS valid, sod, geom_sig, CASE WHEN ok THEN CASE WHEN v = 3 THEN 128 ELSE 64 END END::BIGINT AS xsiz, CASE WHEN ok THEN 64 END::BIGINT AS ysiz,
CASE WHEN ok THEN 3 END AS csiz, CASE WHEN ok THEN 1 END AS nl, CASE WHEN ok THEN CASE WHEN v = 2 THEN 5 ELSE 3 END END AS progression, 0 AS ccap15, CASE WHEN ok AND v = 2 THEN 'CAP: PRCL without extended progression' ELSE '' END AS warnings FROM k""")
def header_parse(spark, sf_dir):
    return header.segments_table(header.parse_headers(_headers(spark, sf_dir)).drop("data"))


@query(SQL_HEADERS + "SELECT epoch, geom_sig, sod::BIGINT AS sod_off FROM k")
def header_signatures(spark, sf_dir):
    return header.signatures(_headers(spark, sf_dir)).select("epoch", "geom_sig", "sod_off")


@query(SQL_HEADERS + "SELECT epoch, c::INT AS c, 1 AS nl, 7 AS cbw, 2 AS cbh, 72 AS cbs, 1 AS transform FROM k, (SELECT unnest(range(3)) AS c) WHERE ok")
def component_codings(spark, sf_dir):
    return header.component_codings(header.parse_headers(_headers(spark, sf_dir)).drop("data"))


@query(SQL_HEADERS + """, p AS (SELECT epoch, v, c, r, gx, gy, CASE WHEN v = 3 THEN 4 ELSE 2 END // (2 - r) AS nx FROM k, (SELECT unnest(range(3)) AS c), (SELECT unnest(range(2)) AS r), (SELECT unnest(range(4)) AS gx), (SELECT unnest(range(2)) AS gy) WHERE ok)
SELECT epoch, 0::BIGINT AS t, row_number() OVER (PARTITION BY epoch ORDER BY gy * (2 - r), gx * (2 - r), CASE WHEN v = 2 THEN r ELSE c END, CASE WHEN v = 2 THEN c ELSE r END) - 1 AS crp_idx, c, r, gy * nx + gx AS p FROM p WHERE gx < nx AND gy < 2 // (2 - r)""")
def header_crp(spark, sf_dir):
    """Precinct orders of all decoded headers."""
    h = header.parse_headers(_headers(spark, sf_dir))
    return geometry.crp(geometry.from_headers(h.select("epoch", "header")))


@query("SELECT * FROM (VALUES ('LRCP', 0), ('RLCP', 1), ('RPCL', 2), ('PCRL', 3), ('CPRL', 4), ('PRCL', 5)) t(name, code)")
def progression_names(spark, sf_dir):
    return dimension(spark, Progression)


def _blobs(spark, sf_dir):
    """Frames dealt to the orders: all empty, one with blocks, cut after the header, and broken."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 64).cast("bigint").alias("stream_id"), F.col("o_orderkey").cast("bigint").alias("frame_id"))
    kinds = F.array(*[F.unhex(F.lit(b.hex())) for b in (EMPTY, ONE_HT, HEADER, HEADER + b"\xff\x7f" * 20)])
    return o.withColumn("blob", F.element_at(kinds, (F.col("frame_id") % 4 + 1).cast("int")))


@query("""SELECT o_custkey % 64 AS stream_id, o_orderkey AS frame_id, 0 AS crp_idx, 0 AS c, 0 AS r, 0 AS p, 0 AS b, cb::INT AS cb, true AS incl, 0 AS zbp, 1 AS npasses, 3 AS lblock, 2 AS len0, 0 AS len1, 2 AS length, (272 + 34 * cb)::INT AS scup, 106 + 2 * cb AS byte_offset
FROM orders, (SELECT unnest(range(8)) AS cb) WHERE o_orderkey % 4 = 1""")
def packet_parse(spark, sf_dir):
    return packets.codeblock_segments(_blobs(spark, sf_dir))


#: The precincts of the fixtures' header in order.
SQL_ORDER = """crp AS (SELECT row_number() OVER (ORDER BY gy * (2 - r), gx * (2 - r), c, r) - 1 AS i, c, r, gy * (r + 1) + gx AS p
  FROM (SELECT unnest(range(3)) AS c), (SELECT unnest(range(2)) AS r), (SELECT unnest(range(2)) AS gx), (SELECT unnest(range(2)) AS gy) WHERE gx <= r AND gy <= r)"""


@query(f"""WITH {SQL_ORDER}, o AS (SELECT o_custkey % 64 AS stream_id, o_orderkey AS frame_id, o_orderkey % 4 AS k FROM orders),
w AS (SELECT stream_id, frame_id, i AS step, i::INT AS crp_idx, c, r, p, CASE WHEN k = 1 AND i = 0 THEN 'parsed' ELSE 'empty' END AS status, CASE k WHEN 0 THEN 98 + i WHEN 1 THEN CASE WHEN i = 0 THEN 98 ELSE 121 + i END ELSE 98 END AS byte_offset,
  CASE WHEN k = 2 THEN 0 WHEN k = 1 AND i = 0 THEN 24 ELSE 1 END AS n_bytes, '' AS reason, k = 2 AS overrun FROM o, crp WHERE k < 3
  UNION ALL SELECT stream_id, frame_id, 0, 0, 0, 0, 0, 'failed', 98, 3, 'passes', false FROM o WHERE k = 3 UNION ALL SELECT stream_id, frame_id, 1, 0, NULL, NULL, NULL, 'lost', 101, 0, 'no_signal', false FROM o WHERE k = 3)
SELECT stream_id, frame_id, step, crp_idx, c::INT AS c, r::INT AS r, p::INT AS p, status, byte_offset::BIGINT AS byte_offset, n_bytes::BIGINT AS n_bytes, 0::INT AS skipped, reason, overrun FROM w""")
def precinct_walk(spark, sf_dir):
    return packets.precinct_log(_blobs(spark, sf_dir))


#: Signals of a broken frame: one that helps, an unknown precinct, one that is done, and two that are passed.
SIGNALS = ([(143, 7)], [(143, 300)], [(143, 0)], [(99, 7), (100, 8)])


def _broken(spark, sf_dir):
    """Frames whose first precinct can't be read, dealt to the orders, with signals."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 64).cast("bigint").alias("stream_id"), F.col("o_orderkey").cast("bigint").alias("frame_id"))
    kinds = ", ".join("array(" + ", ".join(f"struct({a}L AS byte_offset, {b}L AS pid)" for a, b in x) + ")" for x in SIGNALS)
    return o.withColumn("blob", F.unhex(F.lit((HEADER + b"\xff\x7f" * 20 + bytes(30) + EOC).hex()))).withColumn("signals", F.expr(f"element_at(array({kinds}), cast(frame_id % 4 + 1 as int))"))


SQL_BROKEN = f"""WITH {SQL_ORDER}, o AS (SELECT o_custkey % 64 AS stream_id, o_orderkey AS frame_id, o_orderkey % 4 AS k FROM orders),
w AS (SELECT stream_id, frame_id, 0 AS step, 0 AS crp_idx, 0 AS c, 0 AS r, 0 AS p, 'failed' AS status, 98 AS byte_offset, 3 AS n_bytes, 0 AS skipped, 'passes' AS reason FROM o
  UNION ALL SELECT stream_id, frame_id, 1, CASE WHEN k = 0 THEN 7 ELSE 1 END, NULL, NULL, NULL, CASE WHEN k = 0 THEN 'recovered' ELSE 'lost' END, 101, 0, CASE WHEN k = 0 THEN 6 ELSE 0 END, ['', 'bad_pid', 'backward', 'no_signal'][k + 1] FROM o
  UNION ALL SELECT stream_id, frame_id, i - 5, i, c, r, p, 'empty', 143 + i - 7, 1, 0, '' FROM o, crp WHERE k = 0 AND i >= 7)
"""


@query(SQL_BROKEN + "SELECT stream_id, frame_id, step::BIGINT AS step, crp_idx::INT AS crp_idx, c::INT AS c, r::INT AS r, p::INT AS p, status, byte_offset::BIGINT AS byte_offset, n_bytes::BIGINT AS n_bytes, skipped::INT AS skipped, reason, false AS overrun FROM w")
def precinct_recovery(spark, sf_dir):
    """The walk of frames that are broken at their first precinct, with signals to go on from."""
    return packets.precinct_log(_broken(spark, sf_dir))


@query(SQL_BROKEN + """, l AS (SELECT stream_id, max(frame_id) AS frame_id FROM w GROUP BY stream_id)
SELECT stream_id, count(*) FILTER (status = 'empty') AS precincts_parsed, count(*) FILTER (status = 'empty') AS sum_precinct_bytes, CASE WHEN count(*) FILTER (status = 'empty') > 0 THEN 1.0::DOUBLE END AS avg_precinct_bytes, count(*) FILTER (status = 'failed') AS failed_parses,
count(*) FILTER (status = 'recovered') AS recoveries, sum(skipped)::BIGINT AS skipped_precincts, count(*) FILTER (reason = 'no_signal') AS recover_no_signal, count(*) FILTER (reason = 'bad_pid') AS recover_bad_pid, count(*) FILTER (reason = 'backward') AS recover_backward,
0::BIGINT AS overruns, '0,0,0,0,98' AS last_failure, 0::BIGINT AS snaps_with_drift, 0::BIGINT AS max_drift, 0::BIGINT AS sum_drift FROM w GROUP BY stream_id""")
def recovery_stats(spark, sf_dir):
    s = packets.precinct_stats(packets.precinct_log(_broken(spark, sf_dir)))
    return s.withColumn("last_failure", F.concat_ws(",", *[F.col(f"last_failure.{n}") for n in ("c", "r", "p", "crp_idx", "pos")]))


@query("""WITH o AS (SELECT o_custkey % 64 AS stream_id, o_orderkey, o_orderkey % 4 AS k FROM orders), f AS (SELECT stream_id, frame_id, crp_idx, c, r, p FROM (SELECT stream_id, o_orderkey AS frame_id, unnest(range(15)) AS i FROM o WHERE k < 3)
JOIN (SELECT row_number() OVER (ORDER BY gy * (2 - r), gx * (2 - r), c, r) - 1 AS crp_idx, c, r, gy * (r + 1) + gx AS p FROM (SELECT unnest(range(3)) AS c), (SELECT unnest(range(2)) AS r), (SELECT unnest(range(2)) AS gx), (SELECT unnest(range(2)) AS gy) WHERE gx <= r AND gy <= r) ON crp_idx = i)
SELECT stream_id, frame_id, crp_idx AS step, crp_idx::INT AS crp_idx, c::INT AS c, r::INT AS r, p::INT AS p FROM f""")
def ready_precincts(spark, sf_dir):
    return packets.ready_precincts(packets.precinct_log(_blobs(spark, sf_dir)))


@query("""SELECT o_custkey % 64 AS stream_id, 15 * count(*) FILTER (o_orderkey % 4 < 3) AS precincts_parsed, (15 * count(*) FILTER (o_orderkey % 4 = 0) + 38 * count(*) FILTER (o_orderkey % 4 = 1))::BIGINT AS sum_precinct_bytes,
count(*) FILTER (o_orderkey % 4 = 3) AS failed_parses, 0::BIGINT AS recoveries, 0::BIGINT AS skipped_precincts, count(*) FILTER (o_orderkey % 4 = 3) AS recover_no_signal, 0::BIGINT AS recover_bad_pid, 0::BIGINT AS recover_backward, 15 * count(*) FILTER (o_orderkey % 4 = 2) AS overruns,
CASE WHEN count(*) FILTER (o_orderkey % 4 = 3) > 0 THEN 0 END AS last_crp_idx FROM orders GROUP BY ALL""")
def precinct_stats(spark, sf_dir):
    s = packets.precinct_stats(packets.precinct_log(_blobs(spark, sf_dir)))
    return s.withColumn("last_crp_idx", F.col("last_failure.crp_idx")).drop("avg_precinct_bytes", "snaps_with_drift", "max_drift", "sum_drift", "last_failure")


@query("""SELECT o_custkey % 64 AS stream_id, o_orderkey AS frame_id, CASE WHEN o_orderkey % 4 = 1 THEN CASE WHEN i < 8 THEN '0,0,2' ELSE 'EMPTY***' END WHEN o_orderkey % 4 = 3 THEN 'FAILURE' ELSE 'EMPTY***' END AS line, (i + 1)::INT AS line_no
FROM orders, (SELECT unnest(range(22)) AS i) WHERE i < CASE o_orderkey % 4 WHEN 1 THEN 22 WHEN 3 THEN 1 ELSE 15 END""")
def log_lines(spark, sf_dir):
    b = _blobs(spark, sf_dir)
    return sinks.log_lines(packets.codeblock_segments(b), packets.precinct_log(b))


def _stream_packets(spark, sf_dir):
    """Ordered packets whose payloads are frames of the fixtures: geometry flips, empty and broken bodies, real gaps."""
    o = frames.gap_flags(sent_packets(spark, sf_dir).where("event_id % 211 <> 0"))
    n = F.col("seq_ext")
    frame_no = F.floor((n - 1) / FRAME)
    head = F.when(frame_no % 7 < 4, F.unhex(F.lit("C000000000000000" + HEADER.hex()))).otherwise(F.unhex(F.lit("C000000000000000" + VARIANTS["wide"].hex())))
    body = F.when(frame_no % 23 < 12, F.unhex(F.lit("00" * 8 + "00" * 2))).otherwise(F.unhex(F.lit("00" * 8 + "ff7f")))
    return o.withColumn("payload", F.when(F.col("mh") > 0, head).otherwise(body))


#: The frame life of those packets: frames by their packets, streaks and latched headers by recursion over frames, events in order.
SQL_EVENTS = f"""WITH RECURSIVE {SQL}, k0 AS (SELECT *, coalesce(seq_ext <> lag(seq_ext) OVER w + 1, false) AS gap FROM sent WHERE event_id % 211 <> 0 WINDOW w AS (PARTITION BY stream_id ORDER BY seq_ext)),
fr AS (SELECT *, sum(CASE WHEN mh >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq_ext ROWS UNBOUNDED PRECEDING)::BIGINT AS frame_id FROM k0),
pk AS (SELECT *, CASE WHEN mh >= 1 THEN 98 ELSE 2 END AS n, seq_ext = min(seq_ext) OVER f AS opens FROM fr WHERE frame_id > 0 WINDOW f AS (PARTITION BY stream_id, frame_id)),
fm AS (SELECT stream_id, frame_id, min(seq_ext) AS s, min(seq_ext) FILTER (gap AND NOT opens) AS g, min(seq_ext) FILTER (marker) AS e, bool_or(gap AND opens) AS late FROM pk GROUP BY ALL),
fd AS (SELECT stream_id, frame_id, s, e, CASE WHEN e IS NULL OR g <= e THEN g END AS g, lead(s) OVER w AS ns, lead(late) OVER w AS nl, (s - 1) // {FRAME} % 7 < 4 AS variant, (s - 1) // {FRAME} % 23 >= 12 AS broken FROM fm WINDOW w AS (PARTITION BY stream_id ORDER BY frame_id)),
st AS (SELECT stream_id, frame_id, variant, CASE WHEN e IS NULL OR g IS NOT NULL THEN 0 WHEN broken THEN 1 ELSE 0 END AS streak, 0 AS relatch FROM fd WHERE frame_id = 1
  UNION ALL SELECT d.stream_id, d.frame_id, d.variant, CASE WHEN d.e IS NULL OR d.g IS NOT NULL THEN x.before WHEN d.broken THEN x.before + 1 ELSE 0 END, x.why FROM (
    SELECT st.stream_id, st.frame_id + 1 AS frame_id, CASE WHEN st.streak >= 4 THEN 2 WHEN fd.variant <> st.variant THEN 1 ELSE 0 END AS why, CASE WHEN st.streak >= 4 OR fd.variant <> st.variant THEN 0 ELSE st.streak END AS before
    FROM st JOIN fd ON fd.stream_id = st.stream_id AND fd.frame_id = st.frame_id + 1) x JOIN fd d USING (stream_id, frame_id)),
ev AS (
  SELECT stream_id, frame_id, pk.seq_ext AS tm, 2 AS o, 'chunk' AS kind, coalesce(sum(n) OVER (PARTITION BY stream_id, frame_id ORDER BY pk.seq_ext ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", n::BIGINT AS len, NULL::INT AS reason, NULL::BOOLEAN AS intact, 0 AS trunc, 0 AS total
    FROM pk JOIN fd USING (stream_id, frame_id) WHERE pk.seq_ext < coalesce(g, pk.seq_ext + 1) AND pk.seq_ext <= coalesce(e, pk.seq_ext)
  UNION ALL SELECT stream_id, frame_id, g, 0, 'abort', NULL, NULL, 1, NULL, 0, 0 FROM fd WHERE g IS NOT NULL
  UNION ALL SELECT stream_id, frame_id, ns, 0, 'abort', NULL, NULL, CASE WHEN nl THEN 1 ELSE 3 END, NULL, 0, 0 FROM fd WHERE g IS NULL AND e IS NULL AND ns IS NOT NULL
  UNION ALL SELECT stream_id, frame_id, coalesce(e, ns), 1, 'count', NULL, NULL, NULL, NULL, 1, 1 FROM fd WHERE (g IS NOT NULL OR e IS NULL) AND coalesce(e, ns) IS NOT NULL
  UNION ALL SELECT stream_id, frame_id, s, 3, 'relatch', NULL, NULL, relatch, NULL, 0, 0 FROM st JOIN fd USING (stream_id, frame_id) WHERE relatch > 0
  UNION ALL SELECT stream_id, frame_id, e, 4, 'ready', 0, (SELECT sum(n) FROM pk WHERE pk.stream_id = fd.stream_id AND pk.frame_id = fd.frame_id AND pk.seq_ext <= fd.e), NULL, true, broken::INT, 1 FROM fd WHERE g IS NULL AND e IS NOT NULL),
es AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY tm, o) - 1 AS event_no, frame_id, kind, "offset", len::INT AS len, reason::INT AS reason, intact::BOOLEAN AS intact, NULL::BIGINT AS pid, trunc::INT AS trunc, total::INT AS total FROM ev)
"""


@query(SQL_EVENTS + "SELECT * FROM es")
def relatch_events(spark, sf_dir):
    return frames.frame_events(_stream_packets(spark, sf_dir))


@query(SQL_EVENTS + """SELECT stream_id, sum(total)::BIGINT AS total_frames, sum(trunc)::BIGINT AS trunc_frames, count(*) FILTER (kind = 'ready') AS ready, count(*) FILTER (kind = 'ready' AND intact) AS intact, count(*) FILTER (kind = 'abort' AND reason = 1) AS abort_gap,
count(*) FILTER (kind = 'abort' AND reason = 2) AS abort_parse, count(*) FILTER (kind = 'abort' AND reason = 3) AS abort_missed_eoc, count(*) FILTER (kind = 'abort' AND reason = 4) AS abort_slab_cap, count(*) FILTER (kind = 'abort' AND reason = 5) AS abort_damaged_eoc, count(*) FILTER (kind = 'relatch') AS relatches FROM es GROUP BY stream_id""")
def event_totals(spark, sf_dir):
    return frames.event_totals(frames.frame_events(_stream_packets(spark, sf_dir)))


def _hex(x, digits):
    return F.lpad(F.hex(x.cast("bigint")), digits, "0")


def _varied_headers(spark, sf_dir):
    """A main header of its own for every order: sizes, levels, directions, steps, capabilities and an override of one component."""
    k = F.col("o_orderkey").cast("bigint")
    nl, nc = 1 + k % 5, 1 + k % 4
    types = [1 + (k + j) % 3 for j in range(5)]
    steps = 1 + sum((F.when(F.lit(j) < nl, F.when(t == 1, 3).otherwise(1)).otherwise(0) for j, t in enumerate(types)), F.lit(0))
    siz = F.concat(F.lit("FF51002F4000"), _hex(64 + k % 1000, 8), _hex(48 + k % 777, 8), F.lit("00" * 8), _hex(64 + k % 1000, 8), _hex(48 + k % 777, 8), F.lit("00" * 8 + "0003" + "070101" * 3))
    cap = F.concat(F.lit("FF50000A40020000"), _hex(k % 65536, 4), _hex(k * 7 % 65536, 4))
    cod = F.concat(F.lit("FF52"), _hex(13 + nl, 4), F.lit("01"), _hex(3 + k % 2 * 2, 2), _hex(1 + k % 9, 4), _hex(k % 2, 2), _hex(nl, 2), _hex(5 + k % 3, 2), _hex(k % 3, 2), F.lit("4801"), F.expr("repeat('55', cast(2 + o_orderkey % 5 as int))"))
    coc = F.concat(F.lit("FF53"), _hex(10 + nc, 4), _hex(k % 3, 2), F.lit("01"), _hex(nc, 2), F.lit("0600" + "4801"), F.expr("repeat('66', cast(2 + o_orderkey % 4 as int))"))
    dfs = F.concat(F.lit("FF7200070001"), _hex(nl, 2), _hex(types[0] * 64 + types[1] * 16 + types[2] * 4 + types[3], 2), _hex(types[4] * 64, 2))
    qcd = F.concat(F.lit("FF5C"), _hex(3 + steps, 4), F.lit("40"), F.array_join(F.transform(F.sequence(F.lit(1), steps.cast("int")), lambda j: F.lpad(F.hex(((k + j) % 32 * 8).cast("bigint")), 2, "0")), ""))
    whole = F.concat(F.lit("FF4F"), siz, F.when(k % 4 > 0, cap).otherwise(""), cod, F.when(k % 3 > 0, coc).otherwise(""), dfs, qcd, F.lit("FF93"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("epoch"), F.unhex(whole).alias("data"))


SQL_VARIED = """WITH k AS (SELECT o_orderkey AS epoch, o_orderkey AS k, 1 + o_orderkey % 5 AS nl, 1 + o_orderkey % 4 AS nc, list_transform(range(5), lambda j: 1 + (o_orderkey + j) % 3) AS ty FROM orders),
h AS (SELECT *, 1 + list_sum(list_transform(ty[1:nl], lambda t: CASE WHEN t = 1 THEN 3 ELSE 1 END))::BIGINT AS steps FROM k)
"""


@query(SQL_VARIED + """SELECT epoch, true AS valid, 64 + k % 1000 AS xsiz, 48 + k % 777 AS ysiz, 64 + k % 1000 AS xtsiz, 3 AS csiz, 7 AS ssiz, CASE WHEN k % 4 > 0 THEN k % 65536 ELSE 0 END::INT AS ccap2, CASE WHEN k % 4 > 0 THEN k * 7 % 65536 ELSE 0 END::INT AS ccap15,
nl::INT AS nl, (7 + k % 3)::INT AS cbw, (2 + k % 3)::INT AS cbh, 72 AS cbs, 1 AS transform, (3 + k % 2 * 2)::INT AS progression, (1 + k % 9)::INT AS layers, (k % 2)::INT AS mct, repeat('55', (1 + nl)::INT) || repeat('FF', (5 - nl)::INT) AS prec,
array_to_string(list_prepend(0, ty[1:nl]), ',') AS types, array_to_string(list_prepend(0, list_transform(range(1, nl + 1), lambda i: len(list_filter(ty[1:i], lambda x: x <> 3)))), ',') AS hor, array_to_string(list_prepend(0, list_transform(range(1, nl + 1), lambda i: len(list_filter(ty[1:i], lambda x: x <> 2)))), ',') AS ver,
0 AS qtype, 2 AS guard, array_to_string(list_transform(range(1, steps + 1), lambda j: (k + j) % 32), ',') AS exponents,
CASE WHEN k % 2 = 1 AND NOT (k % 4 > 0 AND k % 65536 // 16384 % 2 = 1) THEN 'CAP: PRCL without extended progression' ELSE '' END AS warnings FROM h""")
def header_fields(spark, sf_dir):
    """Every field of generated headers, from their bytes."""
    h = header.parse_headers(_varied_headers(spark, sf_dir))
    c, levels = "header.cod.", F.col("header.dfs.levels")

    def joined(name):
        return F.array_join(F.transform(levels, lambda x: x[name].cast("string")), ",")

    return h.select(
        "epoch", "header.valid", "header.siz.xsiz", "header.siz.ysiz", "header.siz.xtsiz", "header.siz.csiz", F.col("header.siz.comps")[1]["ssiz"].alias("ssiz"), "header.ccap2", "header.ccap15", c + "nl", c + "cbw", c + "cbh", c + "cbs", c + "transform",
        F.col(c + "progression_order").alias("progression"), F.col(c + "num_layers").alias("layers"), c + "mct", F.array_join(F.transform(c + "prec", lambda x: _hex(x["prh"] * 16 + x["prw"], 2)), "").alias("prec"),
        joined("type").alias("types"), joined("hor_depth").alias("hor"), joined("ver_depth").alias("ver"), F.col("header.qcd.type").alias("qtype"), F.col("header.qcd.num_guard_bits").alias("guard"),
        F.array_join(F.transform("header.qcd.steps", lambda x: x["exponent"].cast("string")), ",").alias("exponents"), F.array_join("header.warnings", "; ").alias("warnings"))


@query(SQL_VARIED + """SELECT epoch, c::INT AS c, CASE WHEN o THEN nc ELSE nl END::INT AS nl, CASE WHEN o THEN 8 ELSE 7 + k % 3 END::INT AS cbw, CASE WHEN o THEN 2 ELSE 2 + k % 3 END::INT AS cbh, 72 AS cbs, 1 AS transform
FROM (SELECT *, k % 3 > 0 AND k % 3 = c AS o FROM h, (SELECT unnest(range(3)) AS c))""")
def header_overrides(spark, sf_dir):
    """Component codings of the generated headers: the override of one component over the default."""
    return header.component_codings(header.parse_headers(_varied_headers(spark, sf_dir)).drop("data"))
