"""Media columns: MPEG transport streams (ISO/IEC 13818-1) in a binary column.

`mux` writes a payload as one program with one private elementary stream:
a program association table, a program map table, then one PES packet for
each access unit with a presentation time stamp, cut into 188-byte packets.
Every RANDOM_ACCESS_EVERY-th unit is a random access point with a clock
reference. `demux` reads any such stream back: it parses the program tables
(checking their CRC), checks continuity counters, joins the elementary packets
and lists time stamps and random access points. Sections may span packets; a
counter may jump where the discontinuity flag says so.

A null payload is an empty one. Streams that break the format raise
TransportStreamError in `demux`; lost packets do not, they are counted.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladespark.llm import staging

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Bytes of an access unit, and the 90 kHz ticks that it lasts.
UNIT, TICKS = 8192, 3600
RANDOM_ACCESS_EVERY = 8
ALIGN = 64


class TransportStreamError(ValueError):
    """The bytes are no transport stream with a readable program."""


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = ((value << 1) ^ (0x04C11DB7 if value & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(value)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ _CRC[(value >> 24) ^ byte]
    return value


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | ((len(body) + 9) >> 8), (len(body) + 9) & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


_TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(mark: int, ticks: int) -> bytes:
    return bytes([mark << 4 | (ticks >> 29 & 0xE) | 1, ticks >> 22 & 0xFF, (ticks >> 14 & 0xFE) | 1, ticks >> 7 & 0xFF, (ticks << 1 & 0xFE) | 1])


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    out, counter = [_TABLES], 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        data, pts = payload[at : at + UNIT], unit * TICKS & 0x1FFFFFFFF
        access = unit % RANDOM_ACCESS_EVERY == 0
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + data
        clock = b"\x50" + ((pts << 15) | 0x7E00).to_bytes(6, "big") if access else b""
        room = PACKET - 4 - (len(clock) + 1 if access else 0)
        if len(pes) <= room:  # one packet, stuffed
            pad = room - len(pes)
            clock = clock + b"\xff" * pad if access else (b"" if not pad else bytes(1) + b"\xff" * (pad - 2) if pad > 1 else b"")
            field_ = bytes([len(clock)]) + clock if access or pad else b""
            out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, (0x30 if field_ else 0x10) | counter]) + field_ + pes)
            counter = counter + 1 & 15
            continue
        field_ = bytes([len(clock)]) + clock if access else b""
        out.append(bytes([SYNC, 0x40 | ES_PID >> 8, ES_PID & 0xFF, (0x30 if field_ else 0x10) | counter]) + field_ + pes[:room])
        counter = counter + 1 & 15
        rest = np.frombuffer(pes, np.uint8)[room:]
        full = len(rest) // 184
        body = np.empty((full, PACKET), np.uint8)
        body[:, 0], body[:, 1], body[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        body[:, 3] = 0x10 | (np.arange(counter, counter + full) & 15)
        body[:, 4:] = rest[: full * 184].reshape(full, 184)
        out.append(body.tobytes())
        counter = counter + full & 15
        if left := rest[full * 184 :].tobytes():
            pad = 184 - len(left)
            field_ = bytes([pad - 1]) + (bytes(1) + b"\xff" * (pad - 2) if pad > 1 else b"")
            out.append(bytes([SYNC, ES_PID >> 8, ES_PID & 0xFF, 0x30 | counter]) + field_ + left)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes = b""
    packets: int = 0
    programs: int = 0
    stream_type: int = -1
    elementary_packets: int = 0
    lost: int = 0
    repeated: int = 0
    pts: list[int] = field(default_factory=list)
    #: Payload offsets at which decoding can start.
    random_access: list[int] = field(default_factory=list)

    @property
    def feature(self) -> str:
        span = self.pts[-1] - self.pts[0] if self.pts else 0
        return f"packets={self.packets};programs={self.programs};type={self.stream_type};pes={self.elementary_packets};lost={self.lost};repeated={self.repeated};ticks={span};access={','.join(map(str, self.random_access))}"


def _section_of(table: np.ndarray, pid: np.ndarray, start: np.ndarray, wanted: int, table_id: int) -> bytes:
    """Body of the first section of a table, joined from as many packets as it spans."""
    own = np.flatnonzero(pid == wanted)
    heads = np.flatnonzero(table[own, 1] & 0x40)
    if not len(heads):
        raise TransportStreamError(f"no table {table_id}")
    data, size = b"", None
    for i in own[heads[0] :]:
        data += table[i, start[i] :].tobytes()
        if size is None and data and len(data) >= data[0] + 4:
            data = data[1 + data[0] :]
            size = 3 + ((data[1] & 0x0F) << 8 | data[2])
        if size is not None and len(data) >= size:
            break
    if size is None or size < 12 or data[0] != table_id or len(data) < size or crc32_mpeg(data[:size]):
        raise TransportStreamError(f"table {table_id} is damaged")
    return data[8 : size - 4]


def demux(stream: bytes) -> Stream:
    """Parse tables, check counters, join elementary packets; the first elementary stream of the first program."""
    if len(stream) % PACKET or len(stream) < 2 * PACKET:
        raise TransportStreamError("not whole packets")
    table = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (table[:, 0] != SYNC).any() or (table[:, 1] & 0x80).any():
        raise TransportStreamError("sync byte or error flag")
    pid = (table[:, 1] & 0x1F).astype(np.int32) << 8 | table[:, 2]
    control = table[:, 3] >> 4 & 3
    # Where the payload starts: after the header and the adaptation field.
    start = np.where(control & 2, 5 + table[:, 4].astype(np.int32), 4)
    start = np.where(control & 1, np.minimum(start, PACKET), PACKET)

    pat = _section_of(table, pid, start, PAT_PID, 0)
    programs = [(int.from_bytes(pat[k : k + 2], "big"), int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF) for k in range(0, len(pat), 4)]
    programs = [x for x in programs if x[0]]
    if not programs:
        raise TransportStreamError("no program")
    pmt = _section_of(table, pid, start, programs[0][1], 2)
    at_ = 4 + (int.from_bytes(pmt[2:4], "big") & 0x0FFF)
    if at_ + 5 > len(pmt):
        raise TransportStreamError("a program without streams")
    found = Stream(packets=len(table), programs=len(programs), stream_type=pmt[at_])
    own = np.flatnonzero((pid == (int.from_bytes(pmt[at_ + 1 : at_ + 3], "big") & 0x1FFF)) & (control & 1 > 0))
    if not len(own):
        return found
    counter = (table[own, 3] & 15).astype(np.int16)
    flags = np.where((control[own] & 2 > 0) & (table[own, 4] > 0), table[own, 5], 0)
    step = np.diff(counter) & 15
    jump = flags[1:] & 0x80 > 0
    again = np.concatenate([[False], (step == 0) & ~jump])
    found.repeated, found.lost = int(again.sum()), int(((step - 1) & 15)[(step != 0) & ~jump].sum())
    own, flags = own[~again], flags[~again]
    heads = np.flatnonzero(table[own, 1] & 0x40)
    rows, offset = table[own], start[own]
    plain = offset == 4
    pieces, done = [], 0
    for k, head in enumerate(heads):
        last = heads[k + 1] if k + 1 < len(heads) else len(own)
        mid = rows[head + 1 : last]
        whole = plain[head + 1 : last]
        chunk = [rows[head, offset[head] :].tobytes()]
        if whole.all():
            chunk.append(mid[:, 4:].tobytes())
        else:
            run = int(np.argmin(whole))
            chunk.append(mid[:run, 4:].tobytes())
            chunk += [rows[head + 1 + j, offset[head + 1 + j] :].tobytes() for j in range(run, len(mid))]
        pes = b"".join(chunk)
        if pes[:3] != b"\x00\x00\x01":
            raise TransportStreamError("no elementary packet starts here")
        if pes[7] & 0x80:
            found.pts.append((pes[9] >> 1 & 7) << 30 | pes[10] << 22 | (pes[11] >> 1) << 15 | pes[12] << 7 | pes[13] >> 1)
        if flags[head] & 0x40:
            found.random_access.append(done)
        size = int.from_bytes(pes[4:6], "big")
        data = pes[9 + pes[8] : 6 + size if size else len(pes)]
        pieces.append(data)
        done += len(data)
        found.elementary_packets += 1
    found.payload = b"".join(pieces)
    return found


def padded(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of ALIGN."""
    data = (text or "").encode()
    return data + bytes(-len(data) % ALIGN if data else ALIGN)


@F.pandas_udf(T.BinaryType())
def text_to_stream(text: pd.Series) -> pd.Series:
    return pd.Series([mux(padded(x)) for x in text], dtype=object)


_READ = T.StructType(
    [T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("pts", T.ArrayType(T.LongType())), ("random_access", T.ArrayType(T.LongType())))]
)


@F.pandas_udf(_READ)
def read_stream(media: pd.Series) -> pd.DataFrame:
    rows = []
    for x in media:
        got = demux(bytes(x))
        rows.append((len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-ALIGN:]), len(x), hashlib.sha256(x).hexdigest(), got.feature, got.pts, got.random_access))
    return pd.DataFrame(rows, columns=_READ.names)


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a transport stream of each text. Null and empty texts give 64 zero bytes of payload."""
    staging.small_batches(docs.sparkSession)
    return docs.withColumn(media, text_to_stream(F.col(text).cast("string")))


def parsed(media: Column) -> Column:
    """Struct of what a stored stream holds, its time stamps and random access points included."""
    return read_stream(media)


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = staging.documents(spark, sf_dir).select("doc_id", "text")
    sized = docs.select("doc_id", F.octet_length(staging.text_column()).cast("long").alias("n_bytes"), "text")
    read = store(sized).select("doc_id", "n_bytes", parsed(F.col("media")).alias("m"))
    return read.select("doc_id", "n_bytes", *[f"m.{c}" for c in _READ.names])
