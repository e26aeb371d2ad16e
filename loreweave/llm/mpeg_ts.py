"""Media columns as MPEG transport streams (ISO/IEC 13818-1): multiplexing, and a parser that checks what it reads.

A payload becomes one private-data elementary stream: PES packets with presentation timestamps, each begun by a
transport packet that is marked as a random-access point and carries the program clock, after a program association
table and a program map table. The parser reads any stream of 188-byte packets of one program with one such elementary stream: it checks
the sync bytes and the CRC of the tables, whose sections may run over several packets, follows the map to the
stream's PID, checks continuity counters (a repeated packet is skipped, a gap is counted) and puts the PES packets
together. For each it stores the presentation timestamp with the place of its bytes in the payload and whether it is
a random-access point, so that a reader can seek.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give equal streams; a null id
stays null; repeated rows are returned as often as they occur; an empty table gives an empty result; extra columns,
whatever their names, are ignored. A damaged
stream gives what could be read and the counts of what was wrong.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loreweave.llm import shared

PACKET = 188
_PAT_PID, _PMT_PID, _DATA_PID, _PROGRAM = 0, 0x1000, 0x100, 1
_PRIVATE_TYPE, _PRIVATE_STREAM = 0x06, 0xBD
#: Payload bytes in a PES packet, and in a second of presentation time.
PES_BYTES = 16384
BYTES_PER_SECOND = 64000
PAD = 64


@lru_cache(maxsize=256)
def section_crc(data: bytes) -> int:
    """CRC-32 of table sections: polynomial 0x04C11DB7, not reflected, all ones at first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def _table_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    section = bytes((table_id, 0xB0 | length >> 8, length & 0xFF)) + number.to_bytes(2, "big") + bytes((0xC1, 0, 0)) + body
    section += section_crc(section).to_bytes(4, "big")
    packet = bytes((0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0)) + section
    return packet.ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _PROGRAM.to_bytes(2, "big") + (0xE000 | _PMT_PID).to_bytes(2, "big")
    pmt = (0xE000 | _DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes((_PRIVATE_TYPE,)) + (0xE000 | _DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    return _table_packet(_PAT_PID, 0, 1, pat) + _table_packet(_PMT_PID, 2, _PROGRAM, pmt)


def _timestamp(pts: int) -> bytes:
    return bytes((0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 1 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 1 | pts << 1 & 0xFE))


def _pes_packets(chunk: bytes, pts: int, counter: int) -> np.ndarray:
    """The transport packets of one PES packet; the first is a random-access point, the last is stuffed."""
    body = np.frombuffer(b"\x00\x00\x01" + bytes((_PRIVATE_STREAM,)) + (8 + len(chunk)).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(pts) + chunk, dtype=np.uint8)
    first = PACKET - 12  # what the first packet has room for beside its flags and clock
    count = 1 + max(0, -(-(len(body) - first) // 184))
    out = np.full((count, PACKET), 0xFF, dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, _DATA_PID >> 8, _DATA_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(count)) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    head = body[:first]
    out[0, 4], out[0, 5] = 183 - len(head), 0x50  # random access, clock
    out[0, 6:12] = np.frombuffer((pts << 15 | 0x7E00).to_bytes(6, "big"), dtype=np.uint8)
    out[0, PACKET - len(head) :] = head
    full = max(0, (len(body) - first) // 184)
    out[1 : 1 + full, 4:] = body[first : first + full * 184].reshape(full, 184)
    if (last := len(body) - first - full * 184) > 0:
        out[-1, 3] |= 0x20
        out[-1, 4] = 183 - last
        if last < 183:
            out[-1, 5] = 0
        out[-1, PACKET - last :] = body[-last:]
    return out


def multiplex(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``."""
    parts, counter = [_tables()], 0
    for at in range(0, len(payload), PES_BYTES):
        packets = _pes_packets(payload[at : at + PES_BYTES], at * 90000 // BYTES_PER_SECOND % (1 << 33), counter)
        counter += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    """What a transport stream holds."""

    program: int = 0
    pid: int = -1
    stream_type: int = -1
    packets: int = 0
    payload: bytes = b""
    points: list[tuple[int | None, int, bool]] = field(default_factory=list)  # of each PES packet: timestamp, payload offset, random access
    clocks: int = 0
    gaps: int = 0
    bad_tables: int = 0
    bad_sync: int = 0

    @property
    def timestamps(self) -> list[int]:
        return [t for t, _, _ in self.points if t is not None]

    @property
    def random_access(self) -> list[int]:
        """Payload offsets from which a reader can begin."""
        return [offset for _, offset, access in self.points if access]

    def feature(self) -> str:
        times = self.timestamps
        span = f"{times[0]}-{times[-1]}" if times else "-"
        return f"program={self.program};pid={self.pid};type={self.stream_type};packets={self.packets};pes={len(times)};pts={span};rap={len(self.random_access)};pcr={self.clocks};gaps={self.gaps};bad={self.bad_tables + self.bad_sync}"


def _sections(packets: np.ndarray, starts: np.ndarray, begins: np.ndarray, table_id: int, found: Stream) -> Iterator[bytes]:
    """The bodies of the table sections of one PID; a section runs on in the packets after it until it is whole."""
    data = b""
    for packet, start, begin in zip(packets, starts.tolist(), begins.tolist(), strict=True):
        part = packet[start:].tobytes()
        if begin:
            rest, part = part[1 : 1 + part[0]], part[1 + part[0] :]
            if data and (body := _section(data + rest, table_id, found)) is not None:
                yield body
            data = b""
        elif not data:
            continue  # the middle of a section whose beginning is not there
        data += part
        while len(data) > 2 and data[0] != 0xFF and len(data) >= 3 + ((data[1] & 15) << 8 | data[2]):
            end = 3 + ((data[1] & 15) << 8 | data[2])
            if (body := _section(data[:end], table_id, found)) is not None:
                yield body
            data = data[end:]
        data = b"" if data[:1] == b"\xff" else data
    if data:
        found.bad_tables += 1


def _section(section: bytes, table_id: int, found: Stream) -> bytes | None:
    if len(section) < 12 or section[0] != table_id or section_crc(section[:-4]) != int.from_bytes(section[-4:], "big"):
        found.bad_tables += 1
        return None
    return section[3:-4]


def demultiplex(data: bytes) -> Stream:
    """Read a transport stream: tables, continuity, elementary packets, timestamps and random-access points."""
    found = Stream(packets=len(data) // PACKET)
    packets = np.frombuffer(data, dtype=np.uint8, count=found.packets * PACKET).reshape(-1, PACKET)
    synced = packets[:, 0] == 0x47
    found.bad_sync = int((~synced).sum()) + (len(data) % PACKET > 0)
    if found.bad_sync:
        packets = packets[synced]
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    begins, control, counter = packets[:, 1] & 0x40 > 0, packets[:, 3] >> 4 & 3, packets[:, 3] & 15
    starts = 4 + np.where(control & 2, 1 + packets[:, 4].astype(np.int32), 0)
    carries = (control & 1 > 0) & (starts < PACKET)

    tables = np.flatnonzero((pid == _PAT_PID) & carries)
    maps = {}
    for body in _sections(packets[tables], starts[tables], begins[tables], 0, found):
        for at in range(5, len(body) - 3, 4):
            if number := int.from_bytes(body[at : at + 2], "big"):
                maps[number] = int.from_bytes(body[at + 2 : at + 4], "big") & 0x1FFF
    for number, map_pid in maps.items():
        tables = np.flatnonzero((pid == map_pid) & carries)
        for body in _sections(packets[tables], starts[tables], begins[tables], 2, found):
            at = 9 + (int.from_bytes(body[7:9], "big") & 0xFFF)
            if at + 5 <= len(body):
                found.program, found.stream_type, found.pid = number, body[at], int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF

    own = np.flatnonzero((pid == found.pid) & carries)
    if not len(own):
        return found
    step = np.diff(counter[own].astype(np.int32)) & 15
    repeated = np.concatenate(([False], (step == 0) & (packets[own[1:]] == packets[own[:-1]]).all(axis=1)))
    found.gaps = int(((step != 1) & ~repeated[1:]).sum())
    own = own[~repeated]
    stream = packets[own][np.arange(PACKET) >= starts[own][:, None]]
    ends = np.cumsum(PACKET - starts[own])
    first = np.flatnonzero(begins[own])
    cuts = [*(ends[first] - (PACKET - starts[own][first])).tolist(), len(stream)]
    marked = (control[own][first] & 2 > 0) & (packets[own][first, 4] > 0) & (packets[own][first, 5] & 0x40 > 0)
    found.clocks = int(((control[own] & 2 > 0) & (packets[own][:, 4] > 6) & (packets[own][:, 5] & 0x10 > 0)).sum())
    raw, parts, size = stream.tobytes(), [], 0
    for a, b, access in zip(cuts, cuts[1:], marked.tolist(), strict=False):
        if raw[a : a + 3] != b"\x00\x00\x01" or b - a < 9:
            found.bad_sync += 1
            continue
        p = raw[a + 9 : a + 14] if raw[a + 7] & 0x80 else b""
        found.points.append(((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1 if len(p) == 5 else None, size, access))
        length = int.from_bytes(raw[a + 4 : a + 6], "big")
        end = min(b, a + 6 + length) if length else b
        parts.append(raw[a + 9 + raw[a + 8] : end])
        size += len(parts[-1])
    found.payload = b"".join(parts)
    return found


def padded(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of 64."""
    return text + bytes(max(PAD, -(-len(text) // PAD) * PAD) - len(text))


def store(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``, the transport stream of each whole text, written to the scratch folder."""
    shared.small_batches(documents.sparkSession)

    rows = documents.select("doc_id", "text").mapInArrow(_media, "doc_id long, n_bytes long, media binary")
    return shared.written(rows, "media", compression="zstd")


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of texts, a few megabytes at a time."""
    for batch in shared.table_of(batches):
        begin, size, streams, lengths = 0, 0, [], []
        for text in shared.as_bytes(batch.column(1)):
            lengths.append(len(text))
            streams.append(multiplex(padded(text)))
            size += len(streams[-1])
            if size > shared.BATCH_BYTES:
                yield _media_batch(batch.column(0)[begin : begin + len(streams)], lengths, streams)
                begin, size, streams, lengths = begin + len(streams), 0, [], []
        yield _media_batch(batch.column(0)[begin:], lengths, streams)


def _media_batch(ids: pa.Array, lengths: list[int], streams: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(lengths, pa.int64()), pa.array(streams, pa.binary())], ["doc_id", "n_bytes", "media"])


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, points array<struct<pts: bigint, offset: bigint, random_access: boolean>>"


def features(media: DataFrame) -> DataFrame:
    """Read the stored streams back: ``doc_id, n_bytes`` and the payload's and the stream's digests and features."""
    shared.small_batches(media.sparkSession)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, f"doc_id long, n_bytes long, {_FEATURES}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    point = pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(point))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "points"]
    for batch in shared.table_of(batches):
        rows = []
        for stored in batch.column(2):
            data = stored.as_py()
            stream = demultiplex(data)
            p = stream.payload
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), stream.feature(), [dict(zip(("pts", "offset", "random_access"), x, strict=True)) for x in stream.points]))
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)
