"""The packet source: frames however their bytes are cut, restarts from a checkpoint, repeats and numberings that begin again."""

import random

import pytest
from pyspark.sql import functions as F

from tremolo.sources import frames, records
from tremolo.streaming import folds

BODY = bytes(range(256)) * 2


def packet(sequence, body=BODY):
    return b"SL%06X" % sequence + body


def plain(data):
    """Frames of whole data by walking over it."""
    found, at = [], 0
    while at < len(data):
        head = data[at : at + 8]
        if head[:2] == b"SL" and len(data) - at >= 520 and head[:7] == b"SLINFO " and head[7:] in (b"*", b" "):
            found.append((at, "info", None, head[7:] == b"*", None))
            at += 520
        elif head[:2] == b"SL" and all(c in b"0123456789abcdefABCDEF" for c in head[2:]) and len(data) - at >= 520:
            found.append((at, "data", int(head[2:], 16), None, data[at + 8 : at + 520]))
            at += 520
        elif head[:5] == b"ERROR" and b"\n" in data[at : at + 256]:
            found.append((at, "error", None, None, None))
            at = data.index(b"\n", at) + 1
        elif head[:3] == b"END":
            return [*found, (at, "end", None, None, None)]
        else:
            return found
    return found


STREAMS = {
    "plain": b"".join(packet(k) for k in range(9)),
    "mixed": packet(0xFFFFFF) + b"ERROR\r\n" + b"SLINFO *" + BODY + b"SLINFO  " + BODY + b"ERROR out of order\r\n" + b"SL00000a" + BODY + b"END" + packet(3),
    "cut": packet(1) + packet(2)[:300],
    "inside": packet(5, b"SL000001ERROR\nEND" + BODY[17:]) + packet(6, b"\n" * 512),
    "empty": b"",
}


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_split_gives_the_same_at_every_cut(name):
    data = STREAMS[name]
    want = plain(data)
    assert frames.split(data)[0] == want
    for cut in range(0, len(data), 1 if len(data) < 2000 else 37):
        first, used, closed = frames.split(data[:cut])
        second = [] if closed else frames.split(data[used:], used)[0]
        assert first + second == want, cut


def test_what_begins_no_frame():
    for bad in (b"XL000001", b"SL00000G" + BODY, b"SLINFO x" + BODY, b"ERRAND", b"ENTER", b"ERROR" + b"x" * 260, b"\r\n"):
        found, used, closed = frames.split(packet(1) + bad + packet(2))
        assert [f[1] for f in found] == ["data", "broken"] and found[1][0] == 520 == used and closed, bad
    for open_ in (b"S", b"E", b"SL0000", b"SLINFO", b"ERROR" + b"x" * 240, b"EN"):
        assert frames.split(open_) == ([], 0, False), open_


def _write(path, data, cuts):
    path.mkdir(parents=True, exist_ok=True)
    for low, high in zip(cuts, cuts[1:]):
        (path / f"{low:020d}").write_bytes(data[low:high])


def _rows(df):
    return sorted((r.connection, r.offset, r.kind, r.sequence, r.more, r.record and bytes(r.record)) for r in df.collect())


@pytest.mark.parametrize("piece", [7, 1000])
def test_a_stream_goes_on_after_restarts(spark, tmp_path, piece):
    """Three runs with one checkpoint while segments of any length are added: no frame is lost or comes twice."""
    draw, kept = random.Random(piece), list(STREAMS.values())
    want = sorted((i, *f) for i, data in enumerate(kept) for f in plain(data))
    edges = [sorted({0, len(data), *draw.sample(range(len(data) + 1), min(6, len(data)))}) for data in kept]
    seen = []
    for run in range(3):
        for i, data in enumerate(kept):
            some = edges[i][len(edges[i]) * run // 3 : len(edges[i]) * (run + 1) // 3 + 1]
            _write(tmp_path / f"log/one/{i}", data, some)
        out = folds.drained(frames.frames(frames.byte_stream(spark, f"file://{tmp_path}/log", pieceBytes=piece, rangeBytes=500)), spark, "frames", path=f"file://{tmp_path}/out")
        seen.append(out.count())
    assert _rows(out) == want and seen == sorted(seen) and seen[0] < seen[2]
    again = folds.drained(frames.frames(frames.byte_stream(spark, f"file://{tmp_path}/log")), spark, "frames", path=f"file://{tmp_path}/out")
    assert again.count() == len(want)


def test_a_hole_waits_for_its_segment(spark, tmp_path):
    data = STREAMS["plain"]
    _write(tmp_path / "log/one/0", data, [0, 600])
    _write(tmp_path / "log/one/0", data, [1300, 2000, len(data)])
    go = lambda: folds.drained(frames.frames(frames.byte_stream(spark, f"file://{tmp_path}/log")), spark, "frames", path=f"file://{tmp_path}/out")
    assert go().count() == 1
    _write(tmp_path / "log/one/0", data, [600, 1300])
    assert [r[1] for r in _rows(go())] == [520 * k for k in range(9)]


def test_records_once_numberings_again_and_unknown_stations(spark):
    def made(station, channel, second):
        return records.encode([second], records.INT32, second * 1_000_000, station=station, channel=channel)

    bad = bytearray(made("AAA", "HHZ", 99))
    bad[24] = 30
    told = [
        (0, "AAA", "HHZ", 0xFFFFFE, 10), (0, "AAA", "HHZ", 0xFFFFFF, 11), (0, "AAA", "HHZ", 0, 12), (1, "AAA", "HHZ", 0xFFFFFF, 11), (1, "AAA", "HHZ", 0, 12), (1, "AAA", "HHZ", 1, 13),
        (1, "BBB", "HHZ", 7, 10), (1, "BBB", "HHN", 7, 9), (1, "BBB", "HHZ", 3, 20), (1, "BBB", "HHZ", 4, 15), (1, "BBB", "HHZ", 3, 15), (1, "CCC", "HHZ", 1, 1),
    ]
    table = [("s", c, 520 * k, "data", n, None, made(s, ch, t)) for k, (c, s, ch, n, t) in enumerate(told)]
    table += [("s", 2, 0, "data", 1, None, bytes(bad)), ("s", 2, 520, "data", 2, None, bytes(bad)), ("s", 2, 1040, "error", None, None, None)]
    found = spark.createDataFrame(table, frames.FRAMES)
    asked = spark.createDataFrame([("XX", "AAA"), ("XX", "BBB"), ("XX", "DDD")], "network string, station string")
    got = frames.delivered(found, asked)
    kept = [(r.station, r.connection, r.sequence, r.samples and r.samples[0]) for r in got.orderBy("station", "connection", "offset").collect()]
    a = [("AAA", 0, 0xFFFFFE, 10), ("AAA", 0, 0xFFFFFF, 11), ("AAA", 0, 0, 12), ("AAA", 1, 1, 13), ("AAA", 2, 2, None)]
    # a number given again on a channel not heard before is let in; later data under a lower number begin a numbering
    b = [("BBB", 1, 7, 10), ("BBB", 1, 7, 9), ("BBB", 1, 3, 20), ("BBB", 1, 4, 15)]
    assert kept == a + b
    lines = {r.station: (r.station_line, r.data_line) for r in frames.resume_commands(got).collect()}
    assert lines == {"AAA": ("STATION AAA XX", "DATA 000003"), "BBB": ("STATION BBB XX", "DATA 000005")}
    assert frames.delivered(found.limit(0)).count() == 0 and frames.delivered(found.where(F.col("kind") == "error")).count() == 0


def test_tasks_grow_with_bytes_not_with_connections(tmp_path):
    """Many short connections share a task, a long one has many; all pieces come in few batches, each byte once."""
    data = {f"one/{i}": bytes([i % 251]) * (10 + i % 3) for i in range(300)} | {"two/7": bytes(range(256)) * 20}
    for name, content in data.items():
        _write(tmp_path / name, content, [0, len(content) // 2, len(content)])
    reader = frames._LogReader({"path": f"file://{tmp_path}", "rangeBytes": "2000", "pieceBytes": "100"})
    parts = reader.partitions({"two/7": 20}, reader.latestOffset())
    assert len(parts) == -(-(sum(map(len, data.values())) - 20) // 2000)
    found = {name: bytearray(content[:20] if name == "two/7" else b"") for name, content in data.items()}
    for p in parts:
        batches = list(reader.read(p))
        assert [len(b) for b in batches[:-1]] == [frames.PIECES_AT_ONCE] * (len(batches) - 1)
        for row in (r for b in batches for r in b.to_pylist()):
            got = found[f"{row['server']}/{row['connection']}"]
            assert row["position"] == len(got)
            got += row["bytes"]
    assert found == data


def test_records_of_integers_by_the_batch_are_those_by_themselves(spark):
    import numpy as np
    import pyarrow as pa

    draw = random.Random(3)
    rows = [([draw.randrange(-(2**31), 2**31) for _ in range(draw.choice([0, 1, 2, 112]))], draw.randrange(-30_610_224_000_000_000, 253_402_300_800_000_000), draw.choice(["A", "ABCDE", ""])) for _ in range(300)]
    rows += [([1], t, "X") for t in (0, -1, 86_399_999_999, 951_782_400_000_000, 253_402_300_799_999_999)]
    samples = pa.array([r[0] for r in rows], pa.list_(pa.int32()))
    for low, high in ((0, len(rows)), (100, 150)):
        some = rows[low:high]
        got = records.encode_integers(samples.slice(low, high - low), np.array([r[1] for r in some]), [r[2].encode() for r in some])
        assert [x.tobytes() for x in got] == [records.encode(s, records.INT32, t, station=c) for s, t, c in some]
    mixed = spark.createDataFrame([([5, 6], 3, 10, "AB"), ([5, 7], 10, 20, "CD"), ([8], 1, 30, "EF")], "samples array<int>, encoding int, start_us bigint, code string")
    assert [bytes(r.record) for r in records.encode_records(mixed, ("start_us",)).orderBy("start_us").collect()] == [records.encode(r.samples, r.encoding, r.start_us, station=r.code) for r in mixed.orderBy("start_us").collect()]


def test_delivered_without_values_carries_no_samples(spark):
    table = [("s", c, 520 * k, "data", n, None, records.encode([n], records.INT32, t * 1_000_000, station="AAA")) for k, (c, n, t) in enumerate([(0, 1, 1), (0, 2, 2), (1, 2, 2), (1, 3, 3)])]
    got = frames.delivered(spark.createDataFrame(table, frames.FRAMES), values=())
    assert got.columns == ["server", "network", "station", "sequence", "connection", "offset"]
    assert sorted((r.connection, r.sequence) for r in got.collect()) == [(0, 1), (0, 2), (1, 3)]
