"""MPEG transport streams as table columns: write payloads into them, and read tables, packets and timestamps back.

`mux` stores a payload as one private data stream: PAT and PMT at the head, then PES packets of PES_BYTES payload
bytes, each with a presentation timestamp, and a random-access indicator and the program clock in its first packet.
`parse_stream` trusts none of that: it puts the table sections together (over packets, checking their CRC) and finds
the programs by them, checks each PID's continuity counter (a repeated packet is dropped, a gap is counted unless the
stream announces it as a discontinuity), puts the elementary packets together again and lists the timestamps with the
byte places of random-access points. Packets are handled as one NumPy array of shape (n, 188).

Defined results: a null value counts as empty bytes; empty bytes, and bytes that are no transport stream, parse to
zero programs and an empty payload; an elementary packet with a gap inside, or shorter than it says, keeps the bytes that
are there and counts as `damaged`; trailing bytes short of a packet are counted in `lost_bytes`; equal inputs give
equal outputs; extra columns of the input are kept. A payload of any length goes out in full.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 188
PROGRAM, PMT_PID, DATA_PID, STREAM_TYPE, STREAM_ID = 1, 0x1000, 0x0100, 0x06, 0xBD
PES_BYTES = 32_768
#: 90 kHz ticks between elementary packets.
TICKS = 3_600


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def table_crc(data: bytes) -> int:
    """CRC-32 of program tables (polynomial 04C11DB7, not reflected)."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _table_packet(pid: int, table_id: int, ident: int, body: bytes) -> bytes:
    section = bytes([table_id, 0xB0 | ((len(body) + 9) >> 8), (len(body) + 9) & 0xFF, ident >> 8, ident & 0xFF, 0xC1, 0, 0]) + body
    section += table_crc(section).to_bytes(4, "big")
    return (bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_HEAD = _table_packet(0, 0x00, 1, bytes([0, PROGRAM, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])) + _table_packet(
    PMT_PID, 0x02, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0])
)


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """payload as a transport stream; parse_stream gives it back."""
    out, counter = [_HEAD], 0
    for number, at in enumerate(range(0, len(payload), PES_BYTES)):
        part = payload[at : at + PES_BYTES]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(number * TICKS % (1 << 33)) + part
        first, rest = PACKET - 12, PACKET - 4  # the first packet has an adaptation field of eight bytes: length, flags, clock
        clock = (number * TICKS % (1 << 33) << 15 | 0x7E00).to_bytes(6, "big")
        n = 1 + max(0, -(-(len(pes) - first) // rest))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(n)) % 16
        counter += n
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        packets[0, 5], packets[0, 6:12] = 0x50, np.frombuffer(clock, np.uint8)
        body = np.frombuffer(pes, np.uint8)
        if n == 1:
            stuff = first - len(body)
            packets[0, 4] = 7 + stuff
            packets[0, 12 + stuff :] = body
        else:
            packets[0, 4] = 7
            packets[0, 12:] = body[:first]
            whole = (len(body) - first) // rest
            packets[1 : 1 + whole, 4:] = body[first : first + whole * rest].reshape(whole, rest)
            if tail := len(body) - first - whole * rest:
                stuff = rest - tail
                packets[-1, 3] |= 0x20
                packets[-1, 4] = stuff - 1
                if stuff > 1:
                    packets[-1, 5] = 0
                packets[-1, 4 + stuff :] = body[-tail:]
        out.append(packets.tobytes())
    return b"".join(out)


def _sections(packets: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """Valid table sections of one PID, put together over packets."""
    held: bytes | None = None
    for packet, at in zip(packets, starts, strict=True):
        body, fresh = packet[at:].tobytes(), b""
        if packet[1] & 0x40:  # a section begins where the pointer says; what stands before ends the one at hand
            body, fresh = body[1 : 1 + body[0]] if body else b"", body[1 + body[0] :] if body else b""
        for begun in (False, True):
            held = fresh if begun and packet[1] & 0x40 else held + body if held is not None and not begun else held
            while held and held[0] != 0xFF and len(held) >= 3:
                size = 3 + ((held[1] & 0x0F) << 8 | held[2])
                if len(held) < size:
                    break
                if size >= 12 and table_crc(held[:size]) == 0:
                    yield held[:size]
                held = held[size:]


def parse_stream(data: bytes | None) -> dict:
    """Programs, continuity, payload, timestamps and random-access points of one transport stream."""
    data = data or b""
    out = {"programs": [], "streams": [], "packets": 0, "lost_bytes": len(data) % PACKET, "gaps": 0, "repeats": 0, "damaged": 0, "pts": [], "random_access": [], "payload": b""}
    packets = np.frombuffer(data, np.uint8, len(data) // PACKET * PACKET).reshape(-1, PACKET)
    if not len(packets):
        return out
    good = (packets[:, 0] == 0x47) & (packets[:, 1] & 0x80 == 0)
    places = np.flatnonzero(good)
    packets = packets[good]
    out["packets"], out["lost_bytes"] = len(packets), len(data) - PACKET * len(packets)
    pid = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    control = packets[:, 3] >> 4 & 3
    extra = control & 2 > 0
    starts = np.where(extra, 5 + packets[:, 4].astype(np.int32), 4)
    has = (control & 1 > 0) & (starts <= PACKET)
    for section in _sections(packets[(pid == 0) & has], starts[(pid == 0) & has]):
        if section[0] == 0:
            out["programs"] += [(section[i] << 8 | section[i + 1], (section[i + 2] & 0x1F) << 8 | section[i + 3]) for i in range(8, len(section) - 4, 4) if section[i] << 8 | section[i + 1]]
    out["programs"] = sorted(set(out["programs"]))
    for program, table in out["programs"]:
        for section in _sections(packets[(pid == table) & has], starts[(pid == table) & has]):
            if section[0] == 2 and section[3] << 8 | section[4] == program:
                i = 12 + ((section[10] & 0x0F) << 8 | section[11])
                while i + 5 <= len(section) - 4:
                    out["streams"].append((program, (section[i + 1] & 0x1F) << 8 | section[i + 2], section[i]))
                    i += 5 + ((section[i + 3] & 0x0F) << 8 | section[i + 4])
    out["streams"] = sorted(set(out["streams"]))
    pieces = []
    for _, stream, _ in out["streams"]:
        mine = np.flatnonzero((pid == stream) & has)
        if not len(mine):
            continue
        counter = packets[mine, 3] & 15
        step = (counter[1:].astype(np.int32) - counter[:-1]) % 16
        told = extra[mine[1:]] & (packets[mine[1:], 4] > 0) & (packets[mine[1:], 5] & 0x80 > 0)
        same = np.concatenate([[False], (step == 0) & ~told])
        gap = np.concatenate([[False], (step > 1) & ~told])
        out["repeats"] += int(same.sum())
        out["gaps"] += int(gap.sum())
        torn, mine = np.cumsum(gap)[~same], mine[~same]
        begins = packets[mine, 1] & 0x40 > 0
        marked = extra[mine] & (packets[mine, 4] > 0) & (packets[mine, 5] & 0x40 > 0)
        inside = np.arange(PACKET)[None, :] >= starts[mine][:, None]
        body, length = packets[mine][inside], PACKET - starts[mine]
        ends = np.cumsum(length)
        heads = np.flatnonzero(begins)
        for i, k in enumerate(heads):
            lo, hi = int(ends[k] - length[k]), int(ends[heads[i + 1] - 1] if i + 1 < len(heads) else ends[-1])
            pes = body[lo:hi]
            end = heads[i + 1] - 1 if i + 1 < len(heads) else len(mine) - 1
            if len(pes) < 9 or pes[0] or pes[1] or pes[2] != 1:
                continue
            head = pes[:14].tobytes()
            size = head[4] << 8 | head[5]
            out["damaged"] += bool(torn[end] > torn[k] or (size and len(pes) < 6 + size))
            if head[7] & 0x80 and len(head) == 14:
                p = head[9:14]
                out["pts"].append((p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1)
                if marked[k]:
                    out["random_access"].append((out["pts"][-1], int(places[mine[k]]) * PACKET))
            pieces.append(pes[9 + head[8] : 6 + size if size else len(pes)].tobytes())
    out["payload"] = b"".join(pieces)
    return out


_MEDIA = "struct<programs:array<struct<program:int,pid:int>>,streams:array<struct<program:int,pid:int,type:int>>,packets:bigint,lost_bytes:bigint,gaps:bigint,repeats:bigint,damaged:bigint,pts:array<bigint>,random_access:array<struct<pts:bigint,byte:bigint>>,payload:binary>"


def _struct_type() -> pa.DataType:
    i, long = pa.int32(), pa.int64()
    return pa.struct([
        ("programs", pa.list_(pa.struct([("program", i), ("pid", i)]))), ("streams", pa.list_(pa.struct([("program", i), ("pid", i), ("type", i)]))), ("packets", long), ("lost_bytes", long), ("gaps", long),
        ("repeats", long), ("damaged", long), ("pts", pa.list_(long)), ("random_access", pa.list_(pa.struct([("pts", long), ("byte", long)]))), ("payload", pa.binary()),
    ])


def _with_column(df: DataFrame, source: str, name: str, type_ddl: str, arrow: pa.DataType, f) -> DataFrame:
    """df with a column more, made from `source` value by value; a column of that name is replaced. 64 rows at a time keep memory low."""
    at, keep = df.columns.index(source), [i for i, c in enumerate(df.columns) if c.lower() != name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 64):
                batch = big.slice(k, 64)
                made = pa.array([f(x.as_py()) for x in batch.column(at)], arrow)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), made], names=[*(batch.schema.names[i] for i in keep), name])

    kept = df.select(*(df.columns[i] for i in keep)).schema
    return df.mapInArrow(run, kept.add(name, _ddl(type_ddl)))


def _ddl(ddl: str):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(f"x {ddl}")[0].dataType


def store_as_media(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """df with the transport stream of a binary column."""
    return _with_column(df, payload, media, "binary", pa.binary(), lambda x: mux(x or b""))


def read_media(df: DataFrame, media: str = "media", into: str = "parsed") -> DataFrame:
    """df with a struct of what its transport streams hold: tables, continuity, timestamps, random-access points, payload."""

    def parse(x: bytes | None) -> dict:
        out = parse_stream(x)
        return out | {
            "programs": [dict(zip(("program", "pid"), p, strict=True)) for p in out["programs"]], "streams": [dict(zip(("program", "pid", "type"), p, strict=True)) for p in out["streams"]],
            "random_access": [dict(zip(("pts", "byte"), p, strict=True)) for p in out["random_access"]],
        }

    return _with_column(df, media, into, _MEDIA, _struct_type(), parse)


def _crc32_of(column) -> F.Column:
    return F.crc32(column)


def query(spark, sf_dir: str) -> DataFrame:
    """Digest columns of every document stored as a transport stream and read back."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    size = F.octet_length(text)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("raw"), size.cast("long").alias("n_bytes"))
    whole = F.greatest(F.ceil(F.col("n_bytes") / 64), F.lit(1)) * 64  # up to a positive multiple of 64
    pad = F.unhex(F.repeat(F.lit("00"), (whole - F.col("n_bytes")).cast("int")))
    padded = docs.select("doc_id", "n_bytes", F.concat("raw", pad).alias("payload"))
    read = read_media(store_as_media(padded, "payload").drop("payload"))
    p = F.col("parsed")
    gaps, ra = F.array_join(F.transform(p["streams"], lambda s: F.concat_ws(":", s["program"], s["pid"], s["type"])), ","), p["random_access"]
    return read.select(
        "doc_id", "n_bytes", F.octet_length(p["payload"]).cast("long").alias("payload_bytes"), F.sha2(p["payload"], 256).alias("payload_sha256"), _crc32_of(F.expr("substring(parsed.payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("streams="), gaps, F.lit(" packets="), p["packets"], F.lit(" gaps="), p["gaps"], F.lit(" repeats="), p["repeats"], F.lit(" damaged="), p["damaged"], F.lit(" pes="), F.size(p["pts"]), F.lit(" first_pts="), F.coalesce(F.try_element_at(p["pts"], F.lit(1)), F.lit(-1)),
                 F.lit(" last_pts="), F.coalesce(F.try_element_at(p["pts"], F.lit(-1)), F.lit(-1)), F.lit(" access_points="), F.size(ra)).alias("feature"),
        p["pts"].alias("pts"), ra.alias("random_access"),
    )
