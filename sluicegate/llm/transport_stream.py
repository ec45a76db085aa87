"""Media columns: MPEG transport streams, written and parsed in Arrow batches.

A payload becomes one elementary stream of access units, each in a packetised
elementary packet with a presentation timestamp; every ``rap_every``-th access
unit is a random-access point.  The parser follows the program association
table to the program map tables to all elementary streams, reassembles sections
over packets, checks the tables' CRC and every packet's continuity counter, and
reassembles the packets.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices

PACKET, SYNC, PMT_PID, ES_PID, STREAM_ID, STREAM_TYPE = 188, 0x47, 0x1000, 0x0100, 0xBD, 0x06
UNIT, TICKS = 16_384, 3003

_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1) ^ (0x04C11DB7 if _c & 0x80000000 else 0)
    _CRC.append(_c & 0xFFFFFFFF)


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def write(payload: bytes, unit: int = UNIT, rap_every: int = 4) -> bytes:
    """A transport stream that holds ``payload``; ``unit`` is the access unit's size."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, max(len(payload), 1), unit)):
        data = payload[at : at + unit]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * TICKS) + data
        # a random-access point's first packet has its flag and the clock reference in the adaptation field
        flag, clock = (0x50, (k * TICKS << 15 | 0x7E00).to_bytes(6, "big")) if k % rap_every == 0 else (0, b"")
        room = 182 - len(clock)
        head = pes[:room]
        fill = room - len(head)
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter, 1 + len(clock) + fill, flag]) + clock + b"\xff" * fill + head)
        counter = counter + 1 & 15
        rest = pes[room:]
        full = len(rest) // 184
        if full:
            block = np.empty((full, PACKET), dtype=np.uint8)
            block[:, :3] = (SYNC, ES_PID >> 8, ES_PID & 0xFF)
            block[:, 3] = 0x10 | (counter + np.arange(full) & 15)
            block[:, 4:] = np.frombuffer(rest, dtype=np.uint8, count=full * 184).reshape(full, 184)
            out.append(block.tobytes())
            counter = counter + full & 15
        tail = rest[full * 184 :]
        if tail:
            n = 183 - len(tail)
            field_ = bytes([n]) + (b"\x00" + b"\xff" * (n - 1) if n else b"")
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter]) + field_ + tail)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds; ``errors`` is empty if it is sound."""

    payload: bytes = b""
    stamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    clocks: list[int] = field(default_factory=list)
    packets: int = 0
    program: int = -1
    stream_type: int = -1
    pid: int = -1
    gaps: int = 0
    errors: list[str] = field(default_factory=list)


def _sections(view: np.ndarray, pid: int, pids: np.ndarray) -> list[bytes]:
    """The sections on a PID, each once; a section may span packets and a packet hold several."""
    out: list[bytes] = []
    buffer, before = None, b""

    def take():
        nonlocal buffer
        while buffer and buffer[0] != 0xFF and len(buffer) >= 3:
            size = 3 + (int.from_bytes(buffer[1:3], "big") & 0xFFF)
            if len(buffer) < size:
                return
            out.append(buffer[:size])
            buffer = buffer[size:]
        if buffer and buffer[0] == 0xFF:
            buffer = None

    for row in view[pids == pid]:
        raw = row.tobytes()
        if not raw[3] & 0x10 or raw == before:
            continue
        if before and raw[3] & 15 != (before[3] + 1) & 15 and not raw[1] & 0x40:
            if buffer:
                out.append(buffer)  # a lost packet: the CRC tells
            buffer = None
        before = raw
        at = 4 + (raw[3] & 0x20 and 1 + raw[4])
        if raw[1] & 0x40:
            pointer = raw[at] if at < PACKET else 0
            if buffer:
                buffer += raw[at + 1 : at + 1 + pointer]
                take()
                if buffer:
                    out.append(buffer)
            buffer = raw[at + 1 + pointer :]
        elif buffer is not None:
            buffer += raw[at:]
        take()
    if buffer:
        out.append(buffer)
    return [*dict.fromkeys(out)]


def parse(data: bytes | None) -> Stream:
    """The first of ``parse_all``; its errors name how many further streams there are."""
    first, *rest = parse_all(data)
    if rest:
        first.errors.append(f"{len(rest)} more streams")
    return first


def parse_all(data: bytes | None) -> list[Stream]:
    """An entry for each elementary stream of each program, in the tables' order.

    A program without a readable map or without streams has an entry that names
    the error, and so has a transport stream that can't be read.  Errors of the
    transport and of the program table are in every entry.
    """
    whole = Stream()
    if not data or len(data) % PACKET:
        whole.errors.append("length")
        return [whole]
    view = np.frombuffer(data, dtype=np.uint8).reshape(-1, PACKET)
    whole.packets = len(view)
    if (view[:, 0] != SYNC).any():
        whole.errors.append("sync")
        return [whole]
    if (view[:, 1] & 0x80).any():
        whole.errors.append("transport")
    pids = (view[:, 1].astype(np.int32) & 0x1F) << 8 | view[:, 2]
    programs: dict[int, int] = {}
    for sec in _sections(view, 0, pids):
        if len(sec) < 12 or crc32_mpeg(sec):
            whole.errors.append("pat crc")
            continue
        for i in range(8, len(sec) - 4, 4):
            number = int.from_bytes(sec[i : i + 2], "big")
            if number:
                programs.setdefault(number, int.from_bytes(sec[i + 2 : i + 4], "big") & 0x1FFF)
    if not programs:
        whole.errors.append("no program")
        return [whole]
    out = []
    tables = {pid: _sections(view, pid, pids) for pid in {*programs.values()}}
    for program, pmt_pid in programs.items():
        errors, streams = list(whole.errors), {}
        for sec in tables[pmt_pid]:
            if len(sec) < 16 or crc32_mpeg(sec):
                errors.append("pmt crc")
                continue
            if sec[0] != 2 or (int.from_bytes(sec[3:5], "big") != program and len(programs) > 1):
                continue  # several programs may share a PID
            at = 12 + (int.from_bytes(sec[10:12], "big") & 0xFFF)
            while at + 5 <= len(sec) - 4:
                streams.setdefault(int.from_bytes(sec[at + 1 : at + 3], "big") & 0x1FFF, sec[at])
                at += 5 + (int.from_bytes(sec[at + 3 : at + 5], "big") & 0xFFF)
        if not streams:
            out.append(Stream(packets=len(view), program=program, errors=[*errors, "no stream"]))
        for pid, kind in streams.items():
            s = Stream(packets=len(view), program=program, stream_type=kind, pid=pid, errors=list(errors))
            _read(s, view, pids)
            out.append(s)
    return out


def _read(s: Stream, view: np.ndarray, pids: np.ndarray) -> None:
    """Fill in what the packets of the stream's PID hold."""
    own = view[pids == s.pid]
    control, count = own[:, 3] >> 4 & 3, own[:, 3] & 15
    own, control, count = own[control & 1 == 1], control[control & 1 == 1], count[control & 1 == 1]
    if len(count) > 1:
        step = (count[1:].astype(int) - count[:-1]) % 16
        repeat = np.concatenate([[False], (step == 0) & (own[1:] == own[:-1]).all(axis=1)])  # a packet may be sent twice
        own, control, count = own[~repeat], control[~repeat], count[~repeat]
        s.gaps = int(((count[1:].astype(int) - count[:-1]) % 16 != 1).sum())
        if s.gaps:
            s.errors.append("continuity")
    begins = np.flatnonzero(own[:, 1] & 0x40)
    parts = []
    for b, e in zip(begins, [*begins[1:], len(own)]):
        rows, adapted = own[b:e], control[b:e] == 3
        if adapted[0] and rows[0, 4] and rows[0, 5] & 0x40:
            s.random_access.append(len(s.stamps))
        for row in rows[adapted & (rows[:, 4] >= 7) & (rows[:, 5] & 0x10 > 0)]:
            at = int.from_bytes(row[6:12].tobytes(), "big")
            s.clocks.append((at >> 15) * 300 + (at & 0x1FF))
        pieces, last = [], 0
        for k in np.flatnonzero(adapted):
            pieces += [rows[last:k, 4:].tobytes(), rows[k, 5 + int(rows[k, 4]) :].tobytes()]
            last = k + 1
        pieces.append(rows[last:, 4:].tobytes())
        pes = b"".join(pieces)
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            s.errors.append("pes")
            continue
        size = int.from_bytes(pes[4:6], "big")
        if size and size + 6 != len(pes):
            s.errors.append("pes length")
        if pes[7] & 0x80:
            p = pes[9:14]
            s.stamps.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        else:
            s.stamps.append(-1)
        s.offsets.append(sum(map(len, parts)) if len(parts) < 2 else s.offsets[-1] + len(parts[-1]))
        parts.append(pes[9 + pes[8] :])
    s.payload = b"".join(parts)


def features(s: Stream) -> str:
    """A summary: units, all random-access points and clock references (by digest), timestamps, packets, and the payload's moments."""
    x = np.frombuffer(s.payload, dtype=np.uint8)
    total = int(x.sum(dtype=np.int64))
    square = sum(int((x[i : i + (1 << 20)].astype(np.int64) ** 2).sum()) for i in range(0, len(x), 1 << 20))
    points = zlib.crc32(",".join(f"{s.stamps[i]}@{s.offsets[i]}" for i in s.random_access).encode())
    clocks = zlib.crc32(",".join(map(str, s.clocks)).encode())
    return f"prog={s.program};type={s.stream_type};units={len(s.stamps)};rap={len(s.random_access)};points_crc32={points};clocks={len(s.clocks)};clocks_crc32={clocks};last_pts={max(s.stamps, default=-1)};packets={s.packets};gaps={s.gaps};sum={total};sumsq={square};errors={'|'.join(s.errors)}"


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a transport stream; null is the empty text."""
    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = part.schema[0].dataType.simpleString()

    def run(batches):
        for c in slices(batches):
            if c.num_rows:
                pads = [padded(t) for t in c.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([n for _, n in pads], pa.int64()), pa.array([write(p) for p, _ in pads], pa.binary())], names=["id", "n_bytes", "media"])

    return part.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def probe(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The ``keep`` columns with timestamps, random-access points and errors, a row for each elementary stream.

    Null, empty and broken streams give empty lists and the error's name.
    """
    part = media.select(*keep, F.col(media_col).alias("_media"))
    parsed = T.StructType.fromDDL("program int, stream_type int, pid int, payload binary, stamps array<bigint>, random_access array<int>, offsets array<bigint>, clocks array<bigint>, packets bigint, gaps bigint, errors array<string>")
    out = T.StructType([*part.drop("_media").schema.fields, *parsed.fields])

    def run(batches):
        for b in slices(batches):
            each = [parse_all(m) for m in b.column(b.num_columns - 1).to_pylist()]
            got = [g for streams in each for g in streams]
            b = b.take(pa.array([i for i, streams in enumerate(each) for _ in streams], pa.int64()))
            numbers = [pa.array([getattr(g, c) for g in got], pa.int32()) for c in ("program", "stream_type", "pid")]
            cols = [*numbers, pa.array([g.payload for g in got], pa.binary()), pa.array([g.stamps for g in got], pa.list_(pa.int64())), pa.array([g.random_access for g in got], pa.list_(pa.int32())), pa.array([g.offsets for g in got], pa.list_(pa.int64())), pa.array([g.clocks for g in got], pa.list_(pa.int64())), pa.array([g.packets for g in got], pa.int64()), pa.array([g.gaps for g in got], pa.int64()), pa.array([g.errors for g in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=out.names)

    return part.mapInArrow(run, out)


def summary(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``store``'s table with the digests of its stream and of the payload that is read back from it.

    A stream that can't be read has an empty payload and its errors in ``feature``.
    """
    part = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    kind = part.schema[0].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def one(media):
        s = parse(media)
        return len(s.payload), sha(s.payload), zlib.crc32(s.payload[-64:]), len(media or b""), sha(media or b""), features(s)

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in slices(batches):
            rows = list(zip(*map(one, b.column(2).to_pylist()))) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(r), k) for r, k in zip(rows, kinds))], names=names)

    return part.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
