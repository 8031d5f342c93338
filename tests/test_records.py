"""Records against hand-made bytes: every packing, both byte orders, and one broken record for each reason."""

import zipfile

import numpy as np
import pytest

from tremolo.sources import records, sinks


def made(samples, encoding, **more):
    return bytearray(records.encode(samples, encoding, 1_700_000_000_123_456, **more))


def decoded(*rows):
    data = np.frombuffer(b"".join(bytes(r) for r in rows), np.uint8).reshape(-1, 512)
    h, flat, counts = records.decode(data)
    return [records.REASONS[w] for w in h["why"]], [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])], h


@pytest.mark.parametrize("encoding", [records.STEIM1, records.STEIM2])
def test_every_width_comes_back(encoding):
    rng = np.random.default_rng(encoding)
    for bits in range(1, 30):
        samples = np.cumsum(rng.integers(-(1 << bits - 1), 1 << bits - 1, 60) if bits > 1 else rng.integers(-1, 1, 60)).tolist()
        samples = [x % (1 << 28) for x in samples] if bits < 20 else (rng.integers(-(1 << bits - 1), 1 << bits - 1, 40) // 2).tolist()
        why, got, _ = decoded(made(samples, encoding), made(samples[::-1], encoding, previous=5))
        assert why == ["", ""] and got == [samples, samples[::-1]]


def test_plain_integers_in_both_orders():
    big = made([1, -2, 30_000], records.INT16)
    little = bytearray(big)
    little[53] = 0
    little[64:70] = np.array([1, -2, 30_000], "<i2").tobytes()
    why, got, h = decoded(big, little, made([1 << 30, -7], records.INT32))
    assert why == ["", "", ""] and got == [[1, -2, 30_000], [1, -2, 30_000], [1 << 30, -7]]
    assert h["start_ns"][0] == 1_700_000_000_123_456_000 and h["rate"][0] == 100.0


def test_a_reason_for_every_fault():
    good = made(list(range(50)), records.STEIM2)

    def broken(at, *values):
        r = bytearray(good)
        r[at : at + len(values)] = bytes(values)
        return r

    cases = {
        "byte order": broken(20, 0, 1), "blockettes": broken(46, 0, 0), "encoding": broken(52, 19), "length field": broken(54, 12), "data offset": broken(44, 0, 100), "time": broken(24, 24),
        "sample count": broken(30, 1, 0), "packing": broken(64 + 12, 0), "last sample": broken(64 + 11, 99),
    }
    cases["packing"][64:68] = (2 << 24 | 2 << 26 | 2 << 22).to_bytes(4, "big")
    cases["packing"][64 + 12 : 64 + 16] = b"\0\0\0\0"
    why, got, _ = decoded(*cases.values(), good)
    assert why == [*cases, ""] and got[-1] == list(range(50)) and not any(got[:-1])
    cyclic = broken(58, 0, 48)
    assert decoded(cyclic)[0] == [""]  # a chain that turns back ends after sixteen steps
    assert decoded(broken(30, 0, 0))[:2] == ([""], [[]])


def test_time_corrections_and_leap_seconds():
    r = made([1, 2], records.INT32)
    r[26] = 60
    r[36] = 0
    r[40:44] = (-10_000).to_bytes(4, "big", signed=True)
    _, _, h = decoded(r, made([1, 2], records.INT32))
    assert h["start_ns"][0] - h["start_ns"][1] == (60 - 20 - 1) * 1_000_000_000


def test_files_archives_and_sinks(spark, tmp_path):
    one = b"".join(bytes(made([k, k + 1], records.STEIM1)) for k in range(3))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.rec").write_bytes(one + b"rest")
    with zipfile.ZipFile(tmp_path / "in/b.zip", "w") as z:
        z.writestr("x/c.rec", one[:512])
    raw = records.read_records(spark, str(tmp_path / "in"))
    got = sorted((r.path.rsplit("/", 1)[-1], r.number, r.samples, r.reason) for r in records.decode_records(raw, ("path", "number")).collect())
    assert got == [("a.rec", 0, [0, 1], ""), ("a.rec", 1, [1, 2], ""), ("a.rec", 2, [2, 3], ""), ("a.rec", 3, None, "record length"), ("c.rec", 0, [0, 1], "")]
    sinks.append_archive(raw, f"{tmp_path}/archive")
    sinks.append_archive(raw, f"{tmp_path}/archive")
    assert spark.read.parquet(f"{tmp_path}/archive").count() == 10
    lines = sinks.dump_text(records.decode_records(raw)).collect()
    assert len(lines) == 5 and sum("record length" in r.line for r in lines) == 1
    sinks.write_report(spark.range(3), f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").count() == 3
    assert all(len(r.sha256) == 64 for r in sinks.digests(spark, f"{tmp_path}/report").collect())
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_report(spark.range(3), f"{tmp_path}/report")
