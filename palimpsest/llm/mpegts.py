"""MPEG transport streams as a media column.

``demux`` parses a stream: it checks the sync bytes, reads the program
association and program map tables (with their CRC), follows the continuity
counters of each elementary stream, reassembles its PES packets and stores
their timestamps and random-access points. ``mux`` writes a single-program
stream that carries a byte payload, one PES packet for each access unit.

Cases: a null or empty text is a payload of spaces alone. Streams that are cut
short, lose packets or have broken tables are parsed as far as they go, and the
faults are counted; nothing raises. A null stream has no packets. Each row, of
whatever key, is stored for itself; a column ``media`` of the input is replaced.
Memory: one text and its stream.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm import shared
from palimpsest.llm.blocks import blocks

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID = 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets
UNIT = 3072  # bytes of payload in an access unit
TICKS = 3600  # of the 90 kHz clock from one access unit to the next
RANDOM_ACCESS_EVERY = 8
GRAIN = 192


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _timestamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 1 | t >> 14 & 0xFE, t >> 7 & 0xFF, 1 | t << 1 & 0xFE])


@functools.lru_cache(64)
def _layout(size: int, random_access: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Packets of an access unit with empty payload, where its PES bytes go, and the number of packets."""
    left, at, packets, places = size + 14, 0, [], []
    first = True
    while left:
        body = PACKET - 4
        field_ = b""
        if first and random_access:
            field_ = b"\x07\x50" + b"\x00" * 6  # random access, clock reference
        room = body - len(field_)
        if left < room:  # stuffing makes the packet full
            more = room - left
            if field_:
                field_ = bytes([field_[0] + more]) + field_[1:] + b"\xff" * more
            else:
                field_ = b"\x00" if more == 1 else bytes([more - 1, 0]) + b"\xff" * (more - 2)
        take = body - len(field_)
        head = bytes([SYNC]) + ((0x4000 if first else 0) | ES_PID).to_bytes(2, "big") + bytes([0x30 if field_ else 0x10])
        packets.append(head + field_ + b"\x00" * take)
        places.append(np.arange(at + 4 + len(field_), at + PACKET))
        at += PACKET
        left -= take
        first = False
    return np.frombuffer(b"".join(packets), np.uint8), np.concatenate(places), len(packets)


def mux(payload: bytes) -> bytes:
    """A transport stream of one program with one private stream that carries the payload."""
    data = np.frombuffer(payload, np.uint8)
    out, counter = [np.frombuffer(_TABLES, np.uint8)], 0
    for k, a in enumerate(range(0, len(data), UNIT)):
        unit = data[a : a + UNIT]
        rap = k % RANDOM_ACCESS_EVERY == 0
        empty, places, n = _layout(len(unit), rap)
        packets = empty.copy()
        packets[3::PACKET] |= (np.arange(counter, counter + n) & 15).astype(np.uint8)
        counter += n
        pts = 90_000 + k * TICKS
        if rap:
            base = pts - TICKS
            packets[6:12] = np.frombuffer(((base & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        head = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _timestamp(pts)
        packets[places[:14]] = np.frombuffer(head, np.uint8)
        packets[places[14:]] = unit
        out.append(packets)
    return np.concatenate(out).tobytes()


@dataclass
class Stream:
    """What demux found. packets: (pid, pts or None, random access, payload) of each PES packet, in order of PID."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    n_packets: int = 0
    sync_errors: int = 0
    table_errors: int = 0
    continuity_errors: int = 0
    pes_errors: int = 0

    def payload(self) -> bytes:
        return b"".join(p[3] for p in self.packets)


def _sections(raw: np.ndarray, rows: np.ndarray, start: np.ndarray, out: Stream):
    """Sections of a table PID: each begins in a packet with the start flag; they may run on."""
    held = b""
    for r in rows.tolist():
        body = raw[r, start[r] :].tobytes()
        if raw[r, 1] & 0x40:
            if not body:
                continue
            held = body[1 + body[0] :]
        elif held:
            held += body
        while len(held) >= 3 and held[0] != 0xFF:
            n = 3 + (held[1] & 15) * 256 + held[2]
            if len(held) < n:
                break
            section, held = held[:n], held[n:]
            if n < 12 or crc_mpeg(section):
                out.table_errors += 1
            else:
                yield section


def demux(data: bytes) -> Stream:
    """Parses a transport stream; see the module."""
    out = Stream()
    raw = np.frombuffer(data, np.uint8)[: len(data) // PACKET * PACKET].reshape(-1, PACKET)
    good = raw[:, 0] == SYNC
    out.sync_errors = int((~good).sum()) + (len(data) % PACKET > 0)
    if out.sync_errors:
        raw = raw[good]
    out.n_packets = len(raw)
    pid = (raw[:, 1].astype(np.int32) & 0x1F) << 8 | raw[:, 2]
    has_field, has_body = raw[:, 3] & 0x20 > 0, raw[:, 3] & 0x10 > 0
    start = np.where(has_field, 5 + raw[:, 4].astype(np.int32), 4)
    start = np.where(has_body, np.minimum(start, PACKET), PACKET)
    flags = np.where(has_field & (raw[:, 4] > 0), raw[:, 5], 0)
    for s in _sections(raw, np.flatnonzero(pid == 0), start, out):
        if s[0] == 0:
            for i in range(8, len(s) - 7, 4):
                if s[i : i + 2] != b"\x00\x00":
                    out.programs[s[i] << 8 | s[i + 1]] = (s[i + 2] & 0x1F) << 8 | s[i + 3]
    for table in sorted(set(out.programs.values())):
        for s in _sections(raw, np.flatnonzero(pid == table), start, out):
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while s[0] == 2 and i + 5 <= len(s) - 4:
                out.streams[(s[i + 1] & 0x1F) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    for p in sorted(out.streams):
        rows = np.flatnonzero(pid == p)
        if not len(rows):
            continue
        counter, body = raw[rows, 3] & 15, has_body[rows]
        step = (counter[1:] - counter[:-1]) & 15
        expected = body[1:].astype(np.uint8)
        repeat = (step == 0) & body[1:] & (raw[rows[1:], 4:] == raw[rows[:-1], 4:]).all(1) if ((step == 0) & body[1:]).any() else np.zeros(len(step), bool)
        reset = flags[rows[1:]] & 0x80 > 0
        broken = (step != expected) & ~repeat & ~reset
        out.continuity_errors += int(broken.sum())
        rows = rows[np.concatenate(([True], ~repeat))]
        lost: set[int] = set()
        if broken.any():
            lost = set(np.flatnonzero(pid == p)[1:][broken].tolist())
        begins = np.flatnonzero(raw[rows, 1] & 0x40)
        if not len(begins) or begins[0] > 0:
            out.pes_errors += 1
        columns = np.arange(PACKET)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)]):
            own = rows[a:b]
            part = raw[own]
            pes = part[columns >= start[own][:, None]].tobytes()
            if len(pes) < 9 or pes[:3] != b"\x00\x00\x01" or lost and lost.intersection(own[1:].tolist()):
                out.pes_errors += 1
                continue
            length, head, pts = pes[4] << 8 | pes[5], 9 + pes[8], None
            if pes[7] & 0x80 and len(pes) >= 14:
                pts = (pes[9] >> 1 & 7) << 30 | pes[10] << 22 | pes[11] >> 1 << 15 | pes[12] << 7 | pes[13] >> 1
            if length and len(pes) < 6 + length:
                out.pes_errors += 1
            out.packets.append((p, pts, bool(flags[own[0]] & 0x40), pes[head : 6 + length if length else None]))
    return out


def feature(s: Stream, payload: bytes) -> str:
    """Programs, packets, faults, timestamps, random-access points and sample statistics of what was read back."""
    pts = [p[1] for p in s.packets if p[1] is not None]
    raps = [p[1] for p in s.packets if p[2]]
    x = np.frombuffer(payload, np.uint8)
    return (
        f"programs={len(s.programs)};streams={','.join(f'{p:#06x}:{t:#04x}' for p, t in sorted(s.streams.items()))};packets={s.n_packets};pes={len(s.packets)};cc_errors={s.continuity_errors};"
        f"pts={pts[0] if pts else ''}-{pts[-1] if pts else ''};random_access={len(raps)};last_random_access={raps[-1] if raps else ''};mean={int(x.sum(dtype=np.int64)) // max(1, len(x))};distinct={int((np.bincount(x, minlength=256) > 0).sum())}"
    )


def pad(text: bytes) -> bytes:
    """Spaces are appended up to a positive multiple of GRAIN."""
    return text.ljust(max(GRAIN, -(-len(text) // GRAIN) * GRAIN), b" ")


COLUMNS = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("pts", T.ArrayType(T.LongType())), ("random_access", T.ArrayType(T.LongType()))]


def to_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with a binary column ``media``: each text as a transport stream."""
    names = [c for c in docs.columns if c.lower() != "media"]
    docs = docs.select(*names)
    text_at = names.index("text")

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(text_at)):
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([mux(pad(t)) for t in block.texts()], pa.binary())], names=[*names, "media"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("media", T.BinaryType())]))


def elementary_packets(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each PES packet of the column ``media``: key, pid, pts, random_access, payload."""

    def run(batches):
        for batch in batches:
            for k, m in zip(batch.column(0), batch.column(1)):
                found = demux(m.as_py() or b"").packets
                if found:
                    pids, pts, rap, payload = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), batch.schema.field(0).type), pa.array(pids, pa.int32()), pa.array(pts, pa.int64()), pa.array(rap, pa.bool_()), pa.array(payload, pa.binary())], names=[key, "pid", "pts", "random_access", "payload"])

    return media.select(key, "media").mapInArrow(run, T.StructType([T.StructField(key, media.schema[key].dataType), T.StructField("pid", T.IntegerType()), T.StructField("pts", T.LongType()), T.StructField("random_access", T.BooleanType()), T.StructField("payload", T.BinaryType())]))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id and COLUMNS: each text is stored as a stream, read back, and described; pts: the timestamps of its elementary
    packets, random_access: those of the ones where reading may begin."""
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows = []
                for text in block.texts():
                    media = mux(pad(text))
                    stream = demux(media)
                    back = stream.payload()
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]) & 0xFFFFFFFF, len(media), hashlib.sha256(media).hexdigest(), feature(stream, back), [p[1] for p in stream.packets], [p[1] for p in stream.packets if p[2]]))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), *(pa.array(c, kinds[t]) for c, (_, t) in zip(columns, COLUMNS))], names=["doc_id", *(n for n, _ in COLUMNS)])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in COLUMNS)]))


def op10_mpegts(spark, sf_dir: str) -> DataFrame:
    return digest(shared.table(spark, sf_dir, "documents"))
