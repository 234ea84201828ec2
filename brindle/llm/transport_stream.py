"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``mux`` stores a payload losslessly as a single-program stream: a program association table, a program map table with one
private-data stream, and elementary packets with presentation timestamps in 188-byte packets; each elementary packet begins
with the random-access indicator set.  ``demux`` reads any such stream: it parses the program tables (sections may span packets; CRC-32
is checked), checks continuity counters, reassembles the elementary packets of every stream and returns their timestamps,
random-access points and bytes.

Defined cases.  Null or empty payloads are stored as 64 zero bytes by ``store``; a null id is stored like any other.  Bytes that aren't a stream give a
defined error (``ValueError``) from ``demux`` and null columns from ``parse_column``.  Nothing in a stream depends on the row, so equal texts give equal
values, and repeated rows a row each; nothing is compared, so there are no ties.  Texts may be of any length: a batch is cut by bytes, a media value holds one whole text.  Empty
tables give no rows.  ``store`` ignores columns other than doc_id and text; ``parse_column`` carries every column but one named ``stream``, which it replaces.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import as_bytes, in_pieces

PACKET, SYNC, PAT_PID, PMT_PID, DATA_PID = 188, 0x47, 0, 0x1000, 0x0100
#: 16-bit PES_packet_length leaves 65,535 bytes after it, of which 8 are header here; whole 64-byte units fit.
PES_BYTES = 65_472
#: Bytes of texts or streams that are worked on at once: a media column is as large as its texts.
PIECE = 1 << 22
CLOCK = 3_600  # 90 kHz ticks from one elementary packet to the next


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _pts(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 255, 1 | (t >> 14) & 0xFE, (t >> 7) & 255, 1 | (t << 1) & 0xFE])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``."""
    out, counter = [TABLES], 0
    hi, lo = DATA_PID >> 8, DATA_PID & 255
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        part = payload[at : at + PES_BYTES]
        pes = b"\x00\x00\x01\xbd" + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(k * CLOCK) + part
        first, i = True, 0
        while i < len(pes):
            room = 182 if first else 184
            piece = pes[i : i + room]
            i += len(piece)
            head = bytes([SYNC, (0x40 if first else 0) | hi, lo])
            if first:
                short = 182 - len(piece)
                out.append(head + bytes([0x30 | counter, 1 + short, 0x40]) + b"\xff" * short + piece)
            elif len(piece) == 184:
                out.append(head + bytes([0x10 | counter]) + piece)
            else:
                short = 183 - len(piece)
                out.append(head + bytes([0x30 | counter, short]) + (b"\x00" + b"\xff" * (short - 1) if short else b"") + piece)
            counter = (counter + 1) & 15
            first = False
    return b"".join(out)


@dataclass
class Stream:
    """An elementary stream: its PES payloads with timestamps, random-access points (byte offsets) and errors found."""

    pid: int
    kind: int
    packets: list[bytes] = field(default_factory=list)
    pts: list[int | None] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    discontinuities: int = 0
    ts_packets: int = 0

    @property
    def data(self) -> bytes:
        return b"".join(self.packets)


def _pes(raw: bytes) -> tuple[int | None, bytes]:
    if raw[:3] != b"\x00\x00\x01" or len(raw) < 6:
        raise ValueError("an elementary packet has no start code")
    said = int.from_bytes(raw[4:6], "big")
    body = raw[: 6 + said] if said else raw
    if said and len(body) < 6 + said:
        raise ValueError("an elementary packet is cut short")
    if len(body) < 9 or body[3] in (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF):
        return None, body[6:]
    stamp = None
    if body[7] & 0x80:
        b = body[9:14]
        stamp = (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1
    return stamp, body[9 + body[8] :]


def demux(data: bytes) -> dict[int, Stream]:
    """pid -> stream.  Duplicate packets are dropped as the standard says; gaps in the counters are counted."""
    if len(data) % PACKET or not data:
        raise ValueError("not a whole number of 188-byte packets")
    sections: dict[int, bytearray] = {}
    tables = {PAT_PID}
    streams: dict[int, Stream] = {}
    raw: dict[int, bytearray] = {}
    last: dict[int, int] = {}
    sizes: dict[int, int] = {}

    def close(pid: int) -> None:
        if raw.get(pid):
            stamp, body = _pes(bytes(raw[pid]))
            streams[pid].packets.append(body)
            streams[pid].pts.append(stamp)
            sizes[pid] = sizes.get(pid, 0) + len(body)
        raw[pid] = bytearray()

    def table(section: bytes) -> None:
        if crc32_mpeg(section):
            raise ValueError("a program table's CRC is wrong")
        body = section[8:-4]
        if section[0] == 0:
            for i in range(0, len(body), 4):
                if int.from_bytes(body[i : i + 2], "big"):
                    tables.add(int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF)
        elif section[0] == 2:
            i = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
            while i + 5 <= len(body):
                pid = int.from_bytes(body[i + 1 : i + 3], "big") & 0x1FFF
                streams.setdefault(pid, Stream(pid, body[i]))
                i += 5 + (int.from_bytes(body[i + 3 : i + 5], "big") & 0xFFF)

    for at in range(0, len(data), PACKET):
        if data[at] != SYNC:
            raise ValueError(f"no sync byte at {at}")
        start, pid, flags = data[at + 1] & 0x40, (data[at + 1] & 0x1F) << 8 | data[at + 2], data[at + 3]
        body, rai, jump = at + 4, False, False
        if flags & 0x20:
            n = data[body]
            if n:
                rai, jump = bool(data[body + 1] & 0x40), bool(data[body + 1] & 0x80)
            body += 1 + n
        if not flags & 0x10:
            continue
        if pid in streams or pid in tables:
            counter = flags & 15
            if pid in last and not jump:
                if counter == last[pid]:
                    continue
                if counter != (last[pid] + 1) & 15 and pid in streams:
                    streams[pid].discontinuities += 1
            last[pid] = counter
        if pid in tables:
            if start:
                skip = data[body]
                if sections.get(pid):
                    sections[pid] += data[body + 1 : body + 1 + skip]
                sections[pid] = bytearray(data[body + 1 + skip : at + PACKET])
            elif pid in sections:
                sections[pid] += data[body : at + PACKET]
            got = sections.get(pid, b"")
            while len(got) >= 3 and got[0] != 0xFF and len(got) >= (n := 3 + (int.from_bytes(got[1:3], "big") & 0xFFF)):
                table(bytes(got[:n]))
                got = sections[pid] = got[n:]
        elif pid in streams:
            s = streams[pid]
            s.ts_packets += 1
            if start:
                close(pid)
            if rai:
                s.random_access.append(sizes.get(pid, 0))
            raw.setdefault(pid, bytearray()).extend(data[body : at + PACKET])
    for pid in streams:
        close(pid)
    return streams


def pad(payload: bytes, unit: int = 64) -> bytes:
    return payload.ljust(max(unit, -(-len(payload) // unit) * unit), b"\x00")


def feature(streams: dict[int, Stream]) -> str:
    """What the program tables, counters and timestamps say, of every stream in order."""
    return ";".join(
        f"pid={s.pid},type={s.kind},pes={len(s.packets)},ts={s.ts_packets},first={s.pts[0] if s.pts else None},last={s.pts[-1] if s.pts else None},rap={len(s.random_access)},gaps={s.discontinuities}"
        for _, s in sorted(streams.items())
    )


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_pieces(batches, PIECE):
            raw = [as_bytes(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([mux(pad(b)) for b in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PARSED = "stream array<struct<pid:int,kind:int,packets:int,ts_packets:int,discontinuities:int,pts:array<bigint>,random_access:array<bigint>,data:binary>>"


def parse_column(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with a column ``stream``: the elementary streams of each media value, null where it isn't a stream."""
    kind = pa.list_(pa.struct([("pid", pa.int32()), ("kind", pa.int32()), ("packets", pa.int32()), ("ts_packets", pa.int32()), ("discontinuities", pa.int32()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64())), ("data", pa.binary())]))

    def one(data: bytes | None) -> list[dict] | None:
        try:
            return [dict(pid=s.pid, kind=s.kind, packets=len(s.packets), ts_packets=s.ts_packets, discontinuities=s.discontinuities, pts=s.pts, random_access=s.random_access, data=s.data) for _, s in sorted(demux(data or b"").items())]
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_pieces(batches, PIECE):
            made = pa.array([one(x) for x in part.column(part.schema.get_field_index(media)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "stream"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "stream")
    return df.drop("stream").mapInArrow(run, f"{fields}, {PARSED}")


def digests(stored: DataFrame) -> DataFrame:
    """Read the stored streams back and digest them: a row for each of (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, PIECE):
            doc, size, media = (c.to_pylist() for c in batch.columns)
            cols = [[], [], [], [], [], []]
            for data in media:
                streams = demux(data)
                back = b"".join(s.data for _, s in sorted(streams.items()))
                for c, v in zip(cols, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(streams))):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(size, pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[x.split()[0] for x in DIGEST.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST)
