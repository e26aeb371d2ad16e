import hashlib
import random
import zlib

import pytest
from helpers import EDGES, empty, frame

from loreweave.llm import mpeg_ts as M


def payload(size, seed=0):
    return random.Random(seed).randbytes(size)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 128, 165, 166, 167, 168, 169, 170, 182, 184, 350, 352, 354, 16383, 16384, 16385, 16384 * 3 + 5, 300_000])
def test_round_trip(size):
    data = payload(size)
    stream = M.demultiplex(M.multiplex(data))
    assert stream.payload == data and not (stream.gaps or stream.bad_sync or stream.bad_tables)
    count = -(-size // M.PES_BYTES)
    assert stream.timestamps == [i * M.PES_BYTES * 90000 // M.BYTES_PER_SECOND for i in range(count)]
    assert stream.random_access == [i * M.PES_BYTES for i in range(count)]


def test_packets_are_well_formed():
    data = M.multiplex(payload(50_000))
    assert len(data) % 188 == 0 and all(data[i] == 0x47 for i in range(0, len(data), 188))
    assert M.section_crc(b"123456789") == 0x0376E6E7  # the published check value of this CRC


def test_damage_is_counted():
    data = M.multiplex(payload(40_000))
    cut = data[: 188 * 10] + data[188 * 11 :]
    assert M.demultiplex(cut).gaps == 1
    twice = data[: 188 * 10] + data[188 * 9 : 188 * 10] + data[188 * 10 :]
    assert M.demultiplex(twice).payload == payload(40_000) and M.demultiplex(twice).gaps == 0
    table = bytearray(data)
    table[188 + 12] ^= 1
    assert M.demultiplex(bytes(table)).bad_tables == 1 and M.demultiplex(bytes(table)).payload == b""
    sync = bytearray(data)
    sync[188 * 5] = 0
    assert M.demultiplex(bytes(sync)).bad_sync == 1
    assert M.demultiplex(b"").payload == b"" and M.demultiplex(b"noise").bad_sync == 1


def test_features_of_documents(spark):
    got = {}
    for r in M.features(M.store(frame(spark, EDGES))).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(EDGES)
    for doc, text in EDGES:
        raw = (text or "").encode()
        want = M.padded(raw)
        assert len(want) % 64 == 0 and len(want) >= 64
        assert any((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:])) for r in got[doc])
    same = [r for rows in got.values() for r in rows if r["doc_id"] in (10, 11, 12)]
    assert len({(r["media_sha256"], r["feature"]) for r in same}) == 1
    assert M.features(M.store(empty(spark))).count() == 0


def test_points_of_a_long_text_are_stored(spark):
    """Every PES packet's timestamp, payload offset and random access, by which the payload can be cut again."""
    text = "é" * 40_000
    (row,) = M.features(M.store(frame(spark, [(1, text)]))).collect()
    want = [(i * M.PES_BYTES * 90000 // M.BYTES_PER_SECOND, i * M.PES_BYTES, True) for i in range(5)]
    assert [tuple(p) for p in row["points"]] == want and ";pes=5;" in row["feature"] and ";pcr=5;" in row["feature"]


def test_a_table_over_several_packets_is_put_together():
    """A program map with long descriptors, in three packets, with the elementary stream at its end."""
    data = M.multiplex(payload(1000))
    filler = b"\x05" + (0xE000 | 0x200).to_bytes(2, "big") + (0xF000 | 200).to_bytes(2, "big") + bytes(200)
    body = (0xE000 | 0x100).to_bytes(2, "big") + b"\xf0\x00" + filler * 2 + bytes((6,)) + (0xE000 | 0x100).to_bytes(2, "big") + b"\xf0\x00"
    length = 5 + len(body) + 4
    section = bytes((2, 0xB0 | length >> 8, length & 0xFF)) + (1).to_bytes(2, "big") + bytes((0xC1, 0, 0)) + body
    section = b"\x00" + section + M.section_crc(section).to_bytes(4, "big")
    packets = b"".join(bytes((0x47, (0x40 if i == 0 else 0) | 0x10, 0, 0x10 | i)) + section[184 * i : 184 * (i + 1)].ljust(184, b"\xff") for i in range(3))
    stream = M.demultiplex(data[:188] + packets + data[376:])
    assert stream.bad_tables == 0 and stream.pid == 0x200  # the first elementary stream of the map
    cut = M.demultiplex(data[:188] + packets[:188] + data[376:])
    assert cut.bad_tables == 1 and cut.payload == b""
