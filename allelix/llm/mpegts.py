"""Operator 9: media columns as MPEG transport streams.

Each text becomes one transport stream of 188-byte packets: a program association
table, a program map table, then elementary packets (PES) of one private data
stream.  A PES packet carries up to ``UNITS`` access units of 576 samples of 8
bits; its header has a presentation timestamp, and its first transport packet an
adaptation field with the random-access flag and a clock reference.

Reading back parses both tables (with their CRC-32), follows the program's PID,
checks continuity counters, reassembles the PES packets, and returns payload,
timestamps and the positions of random-access points.

``to_media`` gives a table of streams with two columns beside them, the presentation
timestamps and the packets at which decoding may start, so that a reader can seek
without parsing.  ``describe`` reads such a table back: it parses the stored bytes,
compares both columns with what the stream says, and computes features.

A stream depends on the text alone, so equal texts have equal streams.  Each step is
one pass over the rows, a text at a time; nothing is shuffled.

Defined results: a null or empty text is one unit of padding; ids may be null or
repeat, each row gives a row; an empty table gives none; a damaged stream, or one
that is not what its columns say, raises ``StreamError`` when read; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks

PACKET, BODY, SYNC = 188, 184, 0x47
UNIT, PAD = 576, 255
UNITS = 16
RATE, CLOCK = 48_000, 90_000
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x0100, 0x0101
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets
FIELD = 8  # adaptation field with a clock reference: length, flags, 6 bytes
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


MEDIA = "doc_id long, n_bytes long, media binary, timestamps array<long>, access_points array<long>"


class StreamError(ValueError):
    """A transport stream that cannot be read."""


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section_packet(pid: int, table: int, body: bytes) -> bytes:
    head = struct.pack(">BH", table, 0xB000 | len(body) + 4)
    section = head + body
    section += struct.pack(">I", crc32_mpeg(section))
    packet = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section
    return packet + b"\xff" * (PACKET - len(packet))


def _tables() -> bytes:
    pat = _section_packet(PAT_PID, 0x00, struct.pack(">HBBBHH", 1, 0xC1, 0, 0, 1, 0xE000 | PMT_PID))
    pmt = _section_packet(PMT_PID, 0x02, struct.pack(">HBBBHHBHH", 1, 0xC1, 0, 0, 0xE000 | DATA_PID, 0xF000, STREAM_TYPE, 0xE000 | DATA_PID, 0xF000))
    return pat + pmt


TABLES = _tables()


def _timestamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, (pts >> 14 & 0xFE) | 1, pts >> 7 & 0xFF, (pts << 1 & 0xFE) | 1])


def mux(payload: bytes) -> bytes:
    """The stream of a payload whose length is a multiple of ``UNIT``."""
    out = [TABLES]
    counter = 0
    for k, at in enumerate(range(0, len(payload), UNIT * UNITS)):
        part = payload[at : at + UNIT * UNITS]
        pts = k * UNITS * UNIT * CLOCK // RATE % (1 << 33)
        pes = struct.pack(">I", 0x100 | STREAM_ID) + struct.pack(">H", len(part) + 8) + b"\x84\x80\x05" + _timestamp(pts) + part
        n = 1 + -(-max(0, len(pes) - (BODY - FIELD)) // BODY)
        room = n * BODY - FIELD - len(pes)  # stuffing, in the adaptation field of the last packet
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = DATA_PID >> 8
        packets[:, 2] = DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        counter = (counter + n) % 16
        packets[0, 1] |= 0x40
        first = FIELD + (room if n == 1 else 0)
        clock = struct.pack(">IH", pts >> 1 & 0xFFFFFFFF, (pts & 1) << 15 | 0x7E00)
        packets[0, 3] |= 0x20
        packets[0, 4 : 4 + first] = np.frombuffer(bytes([first - 1, 0x50]) + clock + b"\xff" * (first - FIELD), np.uint8)
        body = np.frombuffer(pes, np.uint8)
        packets[0, 4 + first :] = body[: BODY - first]
        body = body[BODY - first :]
        if n > 1:
            full = (n - 2) * BODY
            packets[1 : n - 1, 4:] = body[:full].reshape(-1, BODY)
            if room:
                packets[n - 1, 3] |= 0x20
                field = bytes([room - 1]) + (b"\0" + b"\xff" * (room - 2) if room > 1 else b"")
                packets[n - 1, 4 : 4 + room] = np.frombuffer(field, np.uint8)
            packets[n - 1, 4 + room :] = body[full:]
        out.append(packets.tobytes())
    return b"".join(out)


def _section(packet: bytes, table: int) -> bytes:
    if not packet[1] & 0x40 or packet[4] != 0 or packet[5] != table:
        raise StreamError("no table where one is expected")
    size = struct.unpack_from(">H", packet, 6)[0] & 0x0FFF
    section = packet[5 : 8 + size]
    if crc32_mpeg(section):
        raise StreamError("a table's checksum is wrong")
    return section


class Stream:
    """A parsed stream: ``payload``, ``timestamps`` of the PES packets, ``random_access`` packet numbers."""

    def __init__(self, blob: bytes):
        if not blob or len(blob) % PACKET:
            raise StreamError("not whole packets")
        grid = np.frombuffer(blob, np.uint8).reshape(-1, PACKET)
        if (grid[:, 0] != SYNC).any():
            raise StreamError("lost the sync byte")
        pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
        at = np.flatnonzero(pid == PAT_PID)
        if not len(at):
            raise StreamError("no program association table")
        pat = _section(blob[at[0] * PACKET : (at[0] + 1) * PACKET], 0x00)
        self.pmt_pid = struct.unpack_from(">H", pat, 10)[0] & 0x1FFF
        at = np.flatnonzero(pid == self.pmt_pid)
        if not len(at):
            raise StreamError("no program map table")
        pmt = _section(blob[at[0] * PACKET : (at[0] + 1) * PACKET], 0x02)
        skip = struct.unpack_from(">H", pmt, 10)[0] & 0x0FFF
        self.stream_type = pmt[12 + skip]
        self.data_pid = struct.unpack_from(">H", pmt, 13 + skip)[0] & 0x1FFF
        rows = np.flatnonzero(pid == self.data_pid)
        data = grid[rows]
        if not len(rows) or not data[0, 1] & 0x40:
            raise StreamError("the program's stream does not begin with a packet start")
        counter = data[:, 3] & 0x0F
        if (np.diff(counter.astype(np.int16)) % 16 != 1).any():
            raise StreamError("a continuity counter jumps")
        field = np.where(data[:, 3] & 0x20, data[:, 4].astype(np.int64) + 1, 0)
        if (field > BODY).any():
            raise StreamError("an adaptation field is too long")
        flags = np.where(field > 1, data[:, 5], 0)
        self.random_access = rows[(flags & 0x40) != 0]
        keep = np.arange(BODY) >= field[:, None]
        body = data[:, 4:][keep]
        ends = np.cumsum(BODY - field)
        begin = np.flatnonzero(data[:, 1] & 0x40)
        starts = np.concatenate([[0], ends])[begin]
        stops = np.concatenate([starts[1:], [len(body)]])
        self.timestamps, parts = [], []
        for a, b in zip(starts.tolist(), stops.tolist()):
            pes = body[a:b].tobytes()
            if pes[:4] != b"\0\0\1" + bytes([STREAM_ID]) or struct.unpack_from(">H", pes, 4)[0] != len(pes) - 6:
                raise StreamError("a PES packet is damaged")
            t = pes[9:14]
            self.timestamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
            parts.append(pes[9 + pes[8] :])
        self.payload = b"".join(parts)
        self.packets = len(grid)

    def seek(self, pts: int) -> int:
        """The packet at which decoding from ``pts`` can start."""
        k = int(np.searchsorted(self.timestamps, pts, "right")) - 1
        return int(self.random_access[max(k, 0)])


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def feature(stream: Stream) -> str:
    """Packets, PES packets, last timestamp, random-access points, mean and peak of the 8-bit samples."""
    x = np.frombuffer(stream.payload, np.uint8)
    return f"{stream.packets}:{len(stream.timestamps)}:{stream.timestamps[-1]}:{len(stream.random_access)}:{int(x.sum(dtype=np.int64)) // len(x)}:{int(x.max())}"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_blocks(batch.column(1)):
            body, rows = data.tobytes(), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                media = mux(padded(body[a:b]))
                rows.append((b - a, media, *index_of(media)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], [p.split()[0] for p in MEDIA.split(", ")])


def index_of(media: bytes) -> tuple[list[int], list[int]]:
    """(presentation timestamps, packets with the random-access flag) from the headers of a stream that ``mux`` made."""
    grid = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    heads = np.flatnonzero((grid[:, 1] & 0x40 != 0) & (grid[:, 2] == DATA_PID & 0xFF) & (grid[:, 1] & 0x1F == DATA_PID >> 8))
    times = []
    for k in heads.tolist():
        t = media[k * PACKET + 4 + int(grid[k, 4]) + 1 + 9 :][:5]
        times.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
    return times, heads[grid[heads, 5] & 0x40 != 0].tolist()


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, timestamps, access_points) of each text; write it to store the streams."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return source.mapInArrow(_streams, MEDIA)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for n, media, times, points in zip(*(batch.column(k) for k in range(1, 5))):
            media = media.as_py()
            stream = Stream(media)
            if stream.timestamps != times.as_py() or stream.random_access.tolist() != points.as_py():
                raise StreamError("the stream is not what its columns say")
            back = stream.payload
            rows.append((n.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [p.split()[0] for p in SCHEMA.split(", ")])


def describe(media: DataFrame) -> DataFrame:
    """What the stored streams of ``to_media``'s table hold, read back from their bytes."""
    return media.select("doc_id", "n_bytes", "media", "timestamps", "access_points").mapInArrow(_described, SCHEMA)
