"""MPEG transport streams as a media column: multiplex bytes into packets, and read stored streams back.

A stream has one program: a PAT on PID 0, a PMT on PID 0x100 and one private elementary stream on PID 0x101.
Access units of 2304 bytes (the last may be shorter) are PES packets with a presentation time stamp each; every
eighth is a random-access point and carries a clock reference.  Reading checks the tables' CRCs and the continuity
counters, reassembles the PES packets and lists time stamps and random-access points.

Rows: a null text stores the empty text's payload; equal texts give equal streams, whatever their row; repeated
rows are all stored; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, table
from .textcols import slices, utf8

PACKET, SYNC, PMT_PID, ES_PID, STREAM_TYPE = 188, 0x47, 0x100, 0x101, 0x06
UNIT, EVERY, TICKS, PES_HEADER, FIRST_DATA = 2304, 8, 3600, 14, 176

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC[_i] = _c


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ int(_CRC[(c >> 24) ^ b])
    return c


def _section(table_id: int, body: bytes, number: int) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"), 1)) + _table_packet(
    PMT_PID, _section(2, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00", 1)
)


def _template(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Packets of one access unit of that size, and the places of its PES bytes in them."""
    rest = PES_HEADER + size - FIRST_DATA
    n = 1 + -(-rest // 184)
    rows = np.full((n, PACKET), 255, np.uint8)
    rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = SYNC, ES_PID >> 8, ES_PID & 255, 0x10
    rows[0, 1] |= 0x40
    rows[0, 3] = 0x30
    rows[0, 4:12] = [7, 0] + [255] * 6
    start = np.full(n, 4)
    start[0] = 12
    if spare := (n - 1) * 184 - rest:  # stuffing in the last packet's adaptation field
        rows[-1, 3], rows[-1, 4] = 0x30, spare - 1
        if spare > 1:
            rows[-1, 5] = 0
        start[-1] = 4 + spare
    place = np.flatnonzero((np.arange(PACKET) >= start[:, None]).ravel())
    return rows, place


_TEMPLATES = {size: _template(size) for size in range(576, UNIT + 1, 576)}


def _units(payload: np.ndarray, first: int, counter: int) -> np.ndarray:
    """Packets of access units of one size (rows of payload), numbered from first; counter: of the first packet."""
    k, size = payload.shape
    rows, place = _TEMPLATES[size]
    n = len(rows)
    out = np.repeat(rows[None], k, 0)
    pes = np.empty((k, PES_HEADER + size), np.uint8)
    pes[:, :9] = [0, 0, 1, 0xBD, (size + 8) >> 8, (size + 8) & 255, 0x84, 0x80, 5]
    order = first + np.arange(k, dtype=np.int64)
    pts = order * TICKS & ((1 << 33) - 1)
    pes[:, 9] = 0x21 | (pts >> 29 & 0x0E)
    pes[:, 10] = pts >> 22 & 255
    pes[:, 11] = (pts >> 14 & 0xFE) | 1
    pes[:, 12] = pts >> 7 & 255
    pes[:, 13] = (pts << 1 & 0xFE) | 1
    pes[:, PES_HEADER:] = payload
    out.reshape(k, -1)[:, place] = pes
    keys = order % EVERY == 0
    out[keys, 0, 5] = 0x50
    clock = pts[keys]
    out[keys, 0, 6:12] = np.stack([clock >> 25 & 255, clock >> 17 & 255, clock >> 9 & 255, clock >> 1 & 255, (clock << 7 & 0x80) | 0x7E, clock * 0], 1).astype(np.uint8)
    out[:, :, 3] |= ((counter + np.arange(k * n)) & 15).reshape(k, n).astype(np.uint8)
    return out.reshape(-1, PACKET)


def mux(payload: bytes) -> bytes:
    """payload: a positive multiple of 576 bytes."""
    units = np.frombuffer(payload, np.uint8)
    whole = len(units) // UNIT
    parts, n = [TABLES], 0
    if whole:
        packets = _units(units[: whole * UNIT].reshape(whole, UNIT), 0, 0)
        n = len(packets)
        parts.append(packets.tobytes())
    if len(units) > whole * UNIT:
        parts.append(_units(units[None, whole * UNIT :], whole, n).tobytes())
    return b"".join(parts)


def _read_section(packets: np.ndarray) -> bytes:
    row = packets[0]
    start = 5 + (1 + int(row[4]) if row[3] & 0x20 else 0) + int(row[4 + (1 + int(row[4]) if row[3] & 0x20 else 0)])
    section = row[start:].tobytes()
    section = section[: 3 + ((section[1] & 15) << 8 | section[2])]
    if crc32_mpeg(section):
        raise ValueError("a program table's CRC is wrong")
    return section


def demux(stream: bytes) -> dict:
    """The program, continuity errors, elementary bytes, time stamps and random-access points of a stored stream."""
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a packet has no sync byte")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pat = _read_section(packets[pid == 0])
    pmt_pid = (pat[10] & 0x1F) << 8 | pat[11]
    pmt = _read_section(packets[pid == pmt_pid])
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    kind, es_pid = pmt[at], (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]
    own = np.flatnonzero(pid == es_pid)
    es = packets[own]
    filled = (es[:, 3] & 0x10) > 0
    counters = es[filled, 3] & 15
    breaks = int(((counters[1:] - counters[:-1] & 15) != 1).sum())
    adapted = (es[:, 3] & 0x20) > 0
    start = np.where(adapted, 5 + es[:, 4].astype(np.int32), 4)
    data = es[(np.arange(PACKET) >= start[:, None]) & filled[:, None]]
    length = np.where(filled, PACKET - start, 0)
    at_unit = np.flatnonzero(es[:, 1] & 0x40)
    heads = (np.cumsum(length) - length)[at_unit]
    random_access = (adapted & (es[:, 4] > 0) & ((es[:, 5] & 0x40) > 0))[at_unit]
    parts, pts = [], []
    for head, tail in zip(heads.tolist(), [*heads[1:].tolist(), len(data)]):
        pes = data[head:tail]
        if pes[:3].tolist() != [0, 0, 1]:
            raise ValueError("a PES packet has no start code")
        size = int(pes[4]) << 8 | int(pes[5])
        t = pes[9:14].astype(np.int64)
        pts.append(int((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1))
        parts.append(pes[9 + int(pes[8]) : 6 + size])
    return {
        "program": pat[8] << 8 | pat[9], "stream_type": kind, "es_pid": es_pid, "packets": len(packets), "continuity_errors": breaks,
        "payload": np.concatenate(parts).tobytes(), "pts": pts, "random_access": [[p, int(k)] for p, k, r in zip(pts, own[at_unit], random_access) if r],
    }


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // 576)) * 576, b"\xff")


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's payload as a transport stream."""
    schema = f"{id_col} long, n_bytes long, media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            media = [mux(payload_of(data[a:b].tobytes())) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return bounded_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read stored streams back: their payload's digests, and what the program tables and packets say."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access_packets"]
    schema = f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access_packets array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for stream in batch.column("media").to_pylist():
                got = demux(stream)
                payload = got["payload"]
                told = {k: got[k] for k in ("program", "stream_type", "es_pid", "packets", "continuity_errors")}
                told |= {"units": len(got["pts"]), "first_pts": got["pts"][0], "last_pts": got["pts"][-1], "random_access": got["random_access"]}
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), json.dumps(told, sort_keys=True), got["pts"], [k for _, k in got["random_access"]]))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return bounded_batches(media).select(id_col, "n_bytes", "media").mapInArrow(run, schema)


def op3_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))


QUERIES = {"op3_mpeg_ts": op3_mpeg_ts}
ORACLES: dict[str, str] = {}
