"""Binary time-series records of 512 bytes: headers, compressed and plain samples, reading and writing.

Decoding works on a whole Arrow batch of records at once: a batch is a matrix of bytes, every word of every frame is
classified by a table of (differences, bits), and differences of all records are unpacked and summed in flat arrays.
A record that breaks a rule gets a reason instead of samples; nothing raises.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, FRAME = 512, 64
INT16, INT32, STEIM1, STEIM2 = 1, 3, 10, 11
MOST = 7 * 15 * 7  # differences that a record can hold
REASONS = ("", "record length", "byte order", "blockettes", "encoding", "length field", "data offset", "time", "sample count", "packing", "last sample")
_WHY = {name: i for i, name in enumerate(REASONS)}

#: Differences and bits of a word by its two-bit code and, with Steim-2, its own two upper bits (fixed values).
_STEIM1 = {1: (4, 8), 2: (2, 16), 3: (1, 32)}
_STEIM2 = {(2, 1): (1, 30), (2, 2): (2, 15), (2, 3): (3, 10), (3, 0): (5, 6), (3, 1): (6, 5), (3, 2): (7, 4)}
_COUNT, _BITS = np.full((2, 4, 4), -1, np.int64), np.zeros((2, 4, 4), np.int64)  # -1: no such packing
_COUNT[:, 0] = 0
for _code, (_n, _b) in _STEIM1.items():
    _COUNT[0, _code], _BITS[0, _code] = _n, _b
_COUNT[1, 1], _BITS[1, 1] = _STEIM1[1]
for (_code, _nib), (_n, _b) in _STEIM2.items():
    _COUNT[1, _code, _nib], _BITS[1, _code, _nib] = _n, _b


def _be(data: np.ndarray, at: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(data[:, at : at + width]).view(kind)[:, 0].astype(np.int64)


def _be_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = np.arange(len(data))
    return data[rows, at].astype(np.int64) << 8 | data[rows, at + 1]


def rate_of(factor: np.ndarray, multiplier: np.ndarray) -> np.ndarray:
    """Samples a second: positive numbers multiply, negative ones divide; 0 where either is 0."""
    f, m = factor.astype(float), multiplier.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x: np.where(x > 0, x, np.where(x < 0, -1.0 / x, 0.0))
        return part(f) * part(m)


def headers(data: np.ndarray) -> dict[str, np.ndarray]:
    """Fields of (records, 512) bytes, and ``why``: 0 or the number of a reason."""
    n = len(data)
    year, day = _be(data, 20, ">u2"), _be(data, 22, ">u2")
    why = np.where((year < 1900) | (year > 2500) | (day < 1) | (day > 366), _WHY["byte order"], 0)
    samples, offset = _be(data, 30, ">u2"), _be(data, 44, ">u2")
    rate = rate_of(_be(data, 32, ">i2"), _be(data, 34, ">i2"))
    encoding, order, micro, seen = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    at = _be(data, 46, ">u2")
    for _ in range(16):  # a cyclic chain ends here
        open_ = (why == 0) & (at != 0)
        why = np.where(open_ & (at + 8 > LENGTH), _WHY["blockettes"], why)
        open_ &= why == 0
        if not open_.any():
            break
        safe = np.where(open_, at, 0)
        rows = np.arange(n)
        kind, following = _be_at(data, safe), _be_at(data, safe + 2)
        a, b, c = (data[rows, safe + k].astype(np.int64) for k in (4, 5, 6))
        main = open_ & (kind == 1000)
        steim = (a == STEIM1) | (a == STEIM2)
        bad = ~(steim | (a == INT16) | (a == INT32)) | (b > 1) | (steim & (b != 1))
        why = np.where(main & bad, _WHY["encoding"], np.where(main & (c != 9), _WHY["length field"], why))
        encoding, order, seen = np.where(main, a, encoding), np.where(main, b, order), seen | main
        micro = np.where(open_ & (kind == 1001), np.where(b > 127, b - 256, b), micro)
        at = np.where(open_, following, 0)
    why = np.where((why == 0) & ~seen, _WHY["blockettes"], why)
    steim = (encoding == STEIM1) | (encoding == STEIM2)
    why = np.where((why == 0) & ((offset < 48) | (offset >= LENGTH) | (steim & ((LENGTH - offset) % FRAME != 0))), _WHY["data offset"], why)
    hour, minute, second = (data[:, k].astype(np.int64) for k in (24, 25, 26))
    fract = _be(data, 28, ">u2")
    why = np.where((why == 0) & ((hour > 23) | (minute > 59) | (second > 60) | (fract > 9999)), _WHY["time"], why)
    days = (np.where(why == 0, year, 1970).astype("U4").astype("datetime64[Y]").astype("datetime64[D]")).astype(np.int64) + day - 1
    seconds = days * 86_400 + hour * 3600 + minute * 60 + second  # second 60 carries
    why = np.where((why == 0) & (np.abs(seconds) > 9_223_372_035), _WHY["time"], why)
    correction = np.where(data[:, 36] & 2, 0, _be(data, 40, ">i4"))
    with np.errstate(over="ignore"):
        nanos = seconds * 1_000_000_000 + fract * 100_000 + micro * 1000
        shifted = nanos + correction * 100_000
    why = np.where((why == 0) & ((correction > 0) != (shifted > nanos)) & (correction != 0), _WHY["time"], why)
    return {"why": why, "samples": samples, "rate": rate, "encoding": encoding, "order": order, "offset": offset, "start_ns": shifted}


def unpacked(word: np.ndarray, count: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Signed values of each word, most significant first, as one flat array."""
    k = np.repeat(np.arange(len(word)), count)
    place = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
    value = (word[k].astype(np.int64) >> ((count[k] - 1 - place) * bits[k])) & ((1 << bits[k]) - 1)
    sign = np.int64(1) << (bits[k] - 1)
    return (value ^ sign) - sign


def _steim(data: np.ndarray, h: dict[str, np.ndarray], rows: np.ndarray, why: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of compressed records, flat, and the record of each; failures go to ``why``."""
    rows = rows[(h["samples"][rows] > 0)]
    over = h["samples"][rows] > MOST
    why[rows[over]] = _WHY["sample count"]
    rows = rows[~over]
    n, first = h["samples"][rows], h["offset"][rows] // FRAME
    words = np.ascontiguousarray(data[rows]).view(">u4").astype(np.uint32).reshape(-1, 8, 16)
    codes = (words[:, :, :1] >> (30 - 2 * np.arange(16, dtype=np.uint32))) & 3
    scheme = (h["encoding"][rows] == STEIM2).astype(np.int64)[:, None, None]
    nib = (words >> 30).astype(np.int64)
    count, bits = _COUNT[scheme, codes, nib], _BITS[scheme, codes, nib]
    used = np.arange(8)[None, :] >= first[:, None]
    count = np.where(used[:, :, None] & (np.arange(16) > 0), count, 0).reshape(len(rows), 128)
    good = np.maximum(count, 0)
    before = np.cumsum(good, 1) - good
    broken = ((count < 0) & (before < n[:, None])).any(1)  # a bad packing counts only where samples are still due
    why[rows[broken]] = _WHY["packing"]
    few = ~broken & (good.sum(1) < n)
    why[rows[few]] = _WHY["sample count"]
    keep = ~broken & ~few
    rows, n, first, good, bits, words, codes = rows[keep], n[keep], first[keep], good[keep], bits.reshape(-1, 128)[keep], words[keep], codes[keep]
    difference = unpacked(words.reshape(-1), good.reshape(-1), bits.reshape(-1))
    total = good.sum(1)
    place = np.arange(len(difference)) - np.repeat(np.cumsum(total) - total, total)
    difference = difference[place < np.repeat(n, total)]
    k = np.arange(len(rows))
    ends = [np.where(codes[k, first, w] == 0, words[k, first, w], 0).astype(np.uint32) for w in (1, 2)]
    start = np.cumsum(n) - n
    steps = difference.astype(np.uint32)
    steps[start] = ends[0]  # the first difference belongs to the record before
    run = np.cumsum(steps, dtype=np.uint32)
    base = np.where(start > 0, run[start - 1], 0).astype(np.uint32) if len(start) else start
    samples = (run - np.repeat(base, n)).astype(np.uint32).view(np.int32)
    wrong = samples[start + n - 1].view(np.uint32) != ends[1] if len(start) else np.zeros(0, bool)
    why[rows[wrong]] = _WHY["last sample"]
    return samples[np.repeat(~wrong, n)], np.repeat(rows[~wrong], n[~wrong])


def _integers(data: np.ndarray, h: dict[str, np.ndarray], rows: np.ndarray, why: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = np.where(h["encoding"] == INT16, 2, 4)
    over = h["offset"][rows] + h["samples"][rows] * width[rows] > LENGTH
    why[rows[over]] = _WHY["sample count"]
    rows = rows[~over]
    flat, owner = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for size, kind in ((2, "i2"), (4, "i4")):
        for order, sign in ((0, "<"), (1, ">")):
            some = rows[(width[rows] == size) & (h["order"][rows] == order)]
            n = h["samples"][some] * size
            k = np.repeat(some, n)
            at = h["offset"][k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            flat.append(data[k, at].view(sign + kind).astype(np.int32))
            owner.append(np.repeat(some, h["samples"][some]))
    return np.concatenate(flat), np.concatenate(owner)


def decode(data: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Headers of (records, 512) bytes, all samples in record order, and the number of samples of each record."""
    h = headers(data)
    why = h["why"].copy()
    good = np.flatnonzero(why == 0)
    steim = np.isin(h["encoding"][good], (STEIM1, STEIM2))
    parts = [_steim(data, h, good[steim], why), _integers(data, h, good[~steim], why)]
    flat, owner = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(owner, kind="stable")
    h["why"] = why
    return h, flat[order], np.bincount(owner, minlength=len(data))


def decode_records(df: DataFrame, keep: tuple[str, ...] = (), column: str = "record") -> DataFrame:
    """Columns ``keep``, the header's fields and ``samples`` of a binary column of records.

    Null, shorter and longer records have the reason ``record length``; where there is a reason, ``samples`` is null.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    fields = "station string, location string, channel string, network string, start_us bigint, rate double, n_samples int, encoding int, reason string, samples array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(column).to_pylist()
            fits = np.array([x is not None and len(x) == LENGTH for x in raw], bool)
            data = np.frombuffer(b"".join(x if ok else bytes(LENGTH) for x, ok in zip(raw, fits)), np.uint8).reshape(-1, LENGTH)
            h, flat, counts = decode(data)
            why = np.where(fits, h["why"], _WHY["record length"])
            text = lambda a, b: pa.array([bytes(r[a:b]).decode("ascii", "replace").strip() for r in data], pa.string())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), mask=pa.array(why != 0))
            out = [text(8, 13), text(13, 15), text(15, 18), text(18, 20), pa.array(h["start_ns"] // 1000), pa.array(h["rate"]), pa.array(h["samples"].astype(np.int32)), pa.array(h["encoding"].astype(np.int32))]
            out += [pa.array([REASONS[k] for k in why.tolist()]), lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *out], [*keep, *(x.split()[0] for x in fields.split(", "))])

    return df.select(*keep, column).mapInArrow(run, ", ".join(x for x in (kinds, fields) if x))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path, number and record of every 512 bytes of the files at ``path``; zip archives are opened, member by member.

    A last part of fewer bytes is a record too, which decoding refuses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                members = [(name, content)]
                if content[:4] == b"PK\x03\x04":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = [(f"{name}!{m}", z.read(m)) for m in sorted(z.namelist()) if not m.endswith("/")]
                for member, data in members:
                    parts = [data[i : i + LENGTH] for i in range(0, len(data), LENGTH)]
                    yield pa.RecordBatch.from_arrays([pa.array([member] * len(parts), pa.string()), pa.array(np.arange(len(parts))), pa.array(parts, pa.binary())], ["path", "number", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, number bigint, record binary")


# ---- writing ----------------------------------------------------------------------------------------------------------

_PACKINGS = {STEIM1: [(4, 8, 1, None), (2, 16, 2, None), (1, 32, 3, None)], STEIM2: [(7, 4, 3, 2), (6, 5, 3, 1), (5, 6, 3, 0), (4, 8, 1, None), (3, 10, 2, 3), (2, 15, 2, 2), (1, 30, 2, 1)]}


def encode(samples: list[int], encoding: int, start_us: int, rate: int = 100, station: str = "STA", channel: str = "HHZ", previous: int | None = None) -> bytes:
    """One big-endian record of samples that fit into it; raises ValueError where they do not."""
    at = np.datetime64(start_us, "us")
    year, day = at.astype("datetime64[Y]"), at.astype("datetime64[D]")
    micros = int((at - day.astype("datetime64[us]")).astype(np.int64))
    fract, micro = divmod(micros % 1_000_000, 100)
    pack = lambda v, n, signed=False: int(v).to_bytes(n, "big", signed=signed)
    head = b"000001D " + station.ljust(5).encode() + b"  " + channel.ljust(3).encode() + b"XX"
    head += pack(int(str(year)), 2) + pack(int((day - year.astype("datetime64[D]")).astype(int)) + 1, 2)
    head += bytes([micros // 3_600_000_000, micros // 60_000_000 % 60, micros // 1_000_000 % 60, 0]) + pack(fract, 2)
    head += pack(len(samples), 2) + pack(rate, 2, True) + pack(1, 2, True) + bytes([0, 0, 0, 2]) + pack(0, 4, True) + pack(FRAME, 2) + pack(48, 2)
    head += pack(1000, 2) + pack(56, 2) + bytes([encoding, 1, 9, 0]) + pack(1001, 2) + pack(0, 2) + bytes([0, micro, 0, 7])
    if encoding in (INT16, INT32):
        body = np.array(samples, ">i2" if encoding == INT16 else ">i4").tobytes()
    else:
        diffs = [samples[0] - (previous if previous is not None else samples[0])] + [b - a for a, b in zip(samples, samples[1:])]
        words, i = [(0, samples[0] & 0xFFFFFFFF), (0, samples[-1] & 0xFFFFFFFF)], 0
        while i < len(diffs):
            for n, bits, code, nib in _PACKINGS[encoding]:
                some = diffs[i : i + n]
                if len(some) == n and all(-(1 << bits - 1) <= d < 1 << bits - 1 for d in some):
                    word = sum((d & (1 << bits) - 1) << (n - 1 - k) * bits for k, d in enumerate(some))
                    words.append((code, word | (nib << 30 if nib is not None else 0)))
                    i += n
                    break
            else:
                raise ValueError("a difference is too large")
        words += [(0, 0)] * (-len(words) % 15)
        body = b""
        for f in range(0, len(words), 15):
            ctrl = sum(code << 30 - 2 * (w + 1) for w, (code, _) in enumerate(words[f : f + 15]))
            body += pack(ctrl, 4) + b"".join(pack(word, 4) for _, word in words[f : f + 15])
    record = head + body
    if len(record) > LENGTH:
        raise ValueError("too many samples for a record")
    return record.ljust(LENGTH, b"\0")


def encode_integers(samples: pa.ListArray, start_us: np.ndarray, codes: list[bytes], rate: int = 100, channel: str = "HHZ") -> np.ndarray:
    """``encode`` of a batch of INT32 records, as (records, 512) bytes; no list may be longer than fits."""
    n, counts = len(codes), np.diff(samples.offsets.to_numpy())
    data = np.zeros((n, LENGTH), np.uint8)
    data[:] = np.frombuffer(encode([], INT32, 0, rate, "", channel), np.uint8)

    def put(at: int, values: np.ndarray, kind: str) -> None:
        data[:, at : at + np.dtype(kind).itemsize] = values.astype(kind).view(np.uint8).reshape(n, -1)

    day, micros = np.divmod(start_us, 86_400_000_000)
    dates = day.astype("datetime64[D]")
    year = dates.astype("datetime64[Y]")
    data[:, 8:13] = np.frombuffer(b"".join(c.ljust(5) for c in codes), np.uint8).reshape(n, 5)
    put(20, year.astype(np.int64) + 1970, ">u2")
    put(22, (dates - year.astype("datetime64[D]")).astype(np.int64) + 1, ">u2")
    for at, unit, most in ((24, 3_600_000_000, 24), (25, 60_000_000, 60), (26, 1_000_000, 60)):
        put(at, micros // unit % most, "u1")
    put(28, micros % 1_000_000 // 100, ">u2")
    put(30, counts, ">u2")
    put(61, micros % 100, "u1")
    for k in range(counts.max(initial=0)):
        some = np.flatnonzero(counts > k)
        values = samples.values.to_numpy()[samples.offsets.to_numpy()[some] + k]
        data[some, FRAME + 4 * k : FRAME + 4 * k + 4] = values.astype(">i4").view(np.uint8).reshape(-1, 4)
    return data


def encode_records(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` and ``record`` of rows with station, start_us, encoding and samples (array<int>)."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("samples", "encoding", "start_us", "code")]
            samples, encoding, start_us, code = columns
            whole = not any(c.null_count for c in columns) and not samples.values.null_count and batch.num_rows
            times, codes = (start_us.to_numpy(), [c.encode() for c in code.to_pylist()]) if whole else (None, [])
            # years of four digits, codes of five bytes at most and lists that fit need no record by itself
            if whole and set(encoding.to_pylist()) == {INT32} and max(map(len, codes)) <= 5 and np.diff(samples.offsets.to_numpy()).max() * 4 <= LENGTH - FRAME and -30_610_224_000_000_000 <= times.min() and times.max() < 253_402_300_800_000_000:
                data = encode_integers(samples, times, codes).tobytes()
                made = [data[i : i + LENGTH] for i in range(0, len(data), LENGTH)]
            else:
                made = [encode(s, e, t, station=c) for s, e, t, c in zip(*(c.to_pylist() for c in columns))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.binary())], [*keep, "record"])

    return df.select(*keep, *[F.col(c).alias(c) for c in ("samples", "encoding", "start_us", "code") if c not in keep]).mapInArrow(run, ", ".join(x for x in (kinds, "record binary") if x))
