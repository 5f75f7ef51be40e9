"""The jitter buffer's closed form against a simulator, and the streaming path."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from streamloom.functions import rtp
from streamloom.operators import reorder
from streamloom.plans.fixtures import EMPTY, HEADER
from streamloom.streaming.receive import JitterBuffer


def run(seqs, depth=64):
    b = JitterBuffer(depth)
    out = [s for k, s_ in enumerate(seqs) for s, _, _ in b.push(s_ % 65536, (k,))]
    return b, out


@pytest.mark.parametrize(("seqs", "out", "lost"), [
    ([0, 1, 3, 2], [0, 1, 2, 3], 0), ([0, *range(2, 66)], [0, *range(2, 66)], 1), ([0, 0, 1], [0, 1], 0), ([0, 70, 1], [0], 6), ([65535, 0, 1], [65535, 65536, 65537], 0)])
def test_vectors(seqs, out, lost):
    b, got = run(seqs)
    assert got == out and b.net_lost == lost


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=80), min_size=1, max_size=6))
def test_closed_form(spark, streams):
    rows = [(k, i, s) for k, seqs in enumerate(streams) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "stream_id bigint, arrival_id bigint, seq_ext bigint")
    stats = {r.stream_id: r for r in reorder.loss_stats(df, depth=8).collect()}
    outs = {}
    for r in reorder.reorder(df, depth=8).orderBy("stream_id", "out_no").collect():
        outs.setdefault(r.stream_id, []).append(r.seq_ext)
    for k, seqs in enumerate(streams):
        b, got = run(seqs, 8)
        assert outs.get(k, []) == got
        assert stats[k].net_lost == b.net_lost
        assert stats[k].late + stats[k].duplicate == b.late + b.duplicate


def datagram(seq, payload, marker=False, ssrc=7, version=2, pad=0, csrc=0, ext=b""):
    b0 = version << 6 | (32 if pad else 0) | (16 if ext else 0) | csrc
    head = bytes([b0, (128 if marker else 0) | 96]) + (seq % 65536).to_bytes(2, "big") + (90 * seq).to_bytes(4, "big") + ssrc.to_bytes(4, "big")
    return head + bytes(4 * csrc) + ext + payload + (bytes(pad - 1) + bytes([pad]) if pad else b"")


def test_decode_and_validity(spark):
    body = b"\xc0" + bytes(7) + b"abc"
    cases = [
        (datagram(5, body, True), None), (datagram(5, body, pad=3, csrc=2, ext=b"\xbe\xde\x00\x01abcd"), None), (b"", "short"), (None, "short"), (datagram(1, body, version=1), "version"),
        (datagram(1, b"", csrc=3)[:14], "header"), (datagram(1, b"\xff", pad=200)[:20], "header"), (datagram(1, bytes(8)), None), (datagram(1, bytes(7)), "payload"), (datagram(1, bytes(9300)), "oversize")]
    cases[6] = (datagram(1, bytes(9) + b"\xff").replace(b"\x80", b"\xa0", 1), "padding")
    df = spark.createDataFrame([(k, None if d is None else bytearray(d)) for k, (d, _) in enumerate(cases)], "arrival_id bigint, data binary")
    got = {r.arrival_id: r for r in rtp.decode(df).collect()}
    for k, (_, reason) in enumerate(cases):
        assert got[k].drop_reason == reason, k
    assert bytes(got[0].payload) == body and got[0].marker and got[0].seq == 5 and got[0].ssrc == 7
    assert bytes(got[1].payload) == body and got[1].hdr_len == 28 and got[1].pad_len == 3
    assert rtp.validate(df).count() == 3


def test_streaming_equals_batch(spark, tmp_path):
    from streamloom.operators.frames import FrameMachine
    from streamloom.streaming.receive import receive

    rest = EMPTY[len(HEADER) :]
    parts = [b"\xc0" + bytes(7) + HEADER] + [bytes(8) + rest[i : i + 4] for i in range(0, len(rest), 4)]
    sent = [datagram(n * len(parts) + k, p, k == len(parts) - 1, ssrc) for ssrc in (1, 2) for n in range(3) for k, p in enumerate(parts)]
    sent[3], sent[4] = sent[4], sent[3]
    del sent[8]
    for k, chunk in enumerate((sent[:9], sent[9:])):
        spark.createDataFrame([(9 * k + i, bytearray(d)) for i, d in enumerate(chunk)], "arrival_id bigint, data binary").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    # One folder, two files, read one at a time.
    import os
    import shutil

    (tmp_path / "in").mkdir()
    for k in (0, 1):
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{k}.parquet")
            os.utime(tmp_path / "in" / f"{k}.parquet", (1000 + k, 1000 + k))  # files are read by age
    source = spark.readStream.schema("arrival_id bigint, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = receive(source, 8).writeStream.format("memory").queryName("frame_events").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {}
    for r in spark.table("frame_events").orderBy("stream_id", "event_no").collect():
        if r.kind != "stats":
            got.setdefault(r.stream_id, []).append((r.kind, r.frame_id, r.offset, r.len, r.reason, r.intact))
    for ssrc in (1, 2):
        b, m, want = JitterBuffer(8), FrameMachine(), []
        for d in sent:
            if d[11] == ssrc:
                for _, p, gap in b.push(int.from_bytes(d[2:4], "big"), (bool(d[1] & 128), d[12:])):
                    want += [(e["kind"], e["frame_id"], e["offset"], e["len"], e["reason"], e["intact"]) for e in m.feed(p[1], p[0], gap)]
        assert got[ssrc] == want


def test_udp_source_reader():
    import socket

    from streamloom.sources.udp import UdpReader, address

    assert address("*") == "0.0.0.0" and address("127.0.0.1") == "127.0.0.1"
    with pytest.raises(OSError):
        address("nowhere")
    r = UdpReader({"host": "127.0.0.1", "port": "0", "maxwait": "1.0", "maxrows": "2"})
    port = r._open().getsockname()[1]
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for d in (bytes(12), bytes(5), bytes(20)):
            s.sendto(d, ("127.0.0.1", port))
    rows, end = r.read({"next": 0})
    assert [len(x[2]) for x in rows] == [12, 20] and end == {"next": 2}
    assert len(list(r.readBetweenOffsets({"next": 0}, end))) == 2
    r.commit(end)
    assert not r.kept


def test_a_live_receiver_lands_and_works_off(spark, tmp_path, capfd, monkeypatch):
    """Command line, socket, landing table and frame machine from end to end."""
    import socket
    import threading
    import time

    from streamloom import cli

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    rest = EMPTY[len(HEADER) :]
    parts = [b"\xc0" + bytes(7) + HEADER] + [bytes(8) + rest[i : i + 4] for i in range(0, len(rest), 4)]

    def send():
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            for n in range(400):  # again and again, as nobody may be listening yet
                for k, p in enumerate(parts):
                    out.sendto(datagram(n * len(parts) + k, p, k == len(parts) - 1), ("127.0.0.1", port))
                time.sleep(0.05)

    sender = threading.Thread(target=send, daemon=True)
    sender.start()
    cli.main(["127.0.0.1", str(port), "--duration", "15", "--land", str(tmp_path / "land"), "--out", str(tmp_path / "events")])
    got = spark.read.parquet(str(tmp_path / "events"))
    kept = spark.read.parquet(str(tmp_path / "land" / "datagrams"))
    assert kept.count() > len(parts) and got.where("kind = 'ready' AND intact").count() > 0
    assert kept.select("arrival_id").distinct().count() == kept.count()
    sender.join()


def test_files_and_sinks(spark, tmp_path):
    from streamloom.operators import frames, packets
    from streamloom.sources import files, sinks

    (tmp_path / "a.j2c").write_bytes(EMPTY)
    (tmp_path / "b.j2c").write_bytes(b"no")
    found = files.read_codestreams(spark, str(tmp_path))
    assert [r.content for r in found.collect()] == [EMPTY]
    p = files.packetize(found.selectExpr("1L AS stream_id", "content"), body=4)
    assert p.count() == 1 + -(-(len(EMPTY) - len(HEADER)) // 4)
    f = spark.createDataFrame([(1, 1, bytearray(EMPTY)), (2, 1, bytearray(EMPTY))], "stream_id bigint, frame_id bigint, blob binary")
    sinks.write_frames(f, str(tmp_path / "frames"))
    assert spark.read.parquet(str(tmp_path / "frames")).count() == 2
    sinks.write_j2c(f, str(tmp_path / "j2c"))
    assert sorted(str(x.relative_to(tmp_path / "j2c")) for x in (tmp_path / "j2c").rglob("*.*")) == ["1/out_00001.j2c", "2/out_00001.j2c"] and files.read_codestreams(spark, str(tmp_path / "j2c" / "*")).count() == 2
    lines = sinks.log_lines(packets.codeblock_segments(f), packets.precinct_log(f))
    assert {r.line for r in lines.collect()} == {"EMPTY***"}
    sinks.write_logs(lines, str(tmp_path / "logs"))
    assert spark.read.text(str(tmp_path / "logs")).count() == 30
    assert frames.event_totals(frames.frame_events(p.withColumnRenamed("pkt_no", "seq_ext").selectExpr("*", "false AS gap"))).first().intact == 1
