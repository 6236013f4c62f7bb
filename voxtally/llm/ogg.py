"""Ogg media columns: multiplexing raw 8-bit samples into Ogg, and reading Ogg back.

Reading verifies the checksum of every page, takes streams apart by serial number, puts packets together from lacing
values across pages, and derives the time of every packet from the granule positions of the pages. A page with a wrong
checksum or a truncated page is left out and counted, and the reader goes on at the next capture pattern; a gap in a
stream's page numbers drops the packet that it cuts and is counted.

Writing uses two logical streams. One holds unsigned 8-bit mono samples under a PCM header ("PCM     ", version, format,
rate, ...), its granule position being the number of samples. The other holds the number of bytes before padding.

The byte form of a text is its UTF-8, with bytes 0 up to a positive multiple of `PAD`. Null counts as empty. Equal texts
give equal media: serial numbers come from the payload. Repeated rows are treated alike; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.llm.common import map_rows

PAD = 64
RATE = 8000
#: Samples in a packet.
PACKET = 4096

#: Page header flags, format codes and stream headers of the public Ogg and OggPCM descriptions (fixed values).
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
PCM_MAGIC, PCM_UNSIGNED_8 = b"PCM     ", 1
LENGTH_MAGIC = b"\x80length\x00"
NO_GRANULE = -1

_HEADER = struct.Struct("<4sBBqIIIB")
_PCM = struct.Struct(">8sHHIIBBHI")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, start 0, no final inversion.

    That is the bit-reversal of zlib's reflected form over bit-reversed bytes."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def make_page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing))
    crc = page_checksum(head + lacing + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + lacing + body


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def stream_pages(serial: int, packets: list[tuple[bytes, int]], header_packets: int = 1, segments: int = 255) -> list[bytes]:
    """The pages of one logical stream. packets: (bytes, granule position at its end). Each header packet has a page of
    its own; other packets fill pages of up to `segments` lacing values and may go on over several pages."""
    pages: list[bytes] = []
    groups = [[p] for p in packets[:header_packets]] + ([packets[header_packets:]] if packets[header_packets:] else [])
    for g, group in enumerate(groups):
        lacing = b"".join(_lacing(len(p)) for p, _ in group)
        body = b"".join(p for p, _ in group)
        ends = np.flatnonzero(np.frombuffer(lacing, "u1") != 255)
        at = 0
        for start in range(0, len(lacing), segments):
            part = lacing[start : start + segments]
            size = sum(part)
            done = int(np.searchsorted(ends, start + len(part)))
            before = int(np.searchsorted(ends, start))
            granule = group[done - 1][1] if done > before else NO_GRANULE
            flags = CONTINUED * (start > 0 and lacing[start - 1] == 255) | FIRST * (not pages)
            flags |= LAST * (g == len(groups) - 1 and start + segments >= len(lacing))
            pages.append(make_page(serial, len(pages), flags, granule, part, body[at : at + size]))
            at += size
    return pages


def write_media(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """Payload as 8-bit samples in a physical stream that interleaves both logical streams."""
    serial = zlib.crc32(payload)
    header = _PCM.pack(PCM_MAGIC, 0, 0, PCM_UNSIGNED_8, rate, 8, 1, 0, 0)
    samples = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    sound = stream_pages(serial, [(header, 0), *samples])
    length = stream_pages(serial ^ 0xFFFFFFFF, [(LENGTH_MAGIC, 0), (struct.pack("<Q", n_bytes), len(payload))])
    return b"".join([sound[0], length[0], *sound[1:-1], *length[1:], *sound[-1:]])


@dataclass
class Packet:
    data: bytes
    #: Granule position of the page on which it ends if it is the last that ends there, else None.
    granule: int | None
    start: float | None = None
    end: float | None = None


@dataclass
class Stream:
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    _next: int | None = None
    _open: list[bytes] | None = None


def read_streams(media: bytes) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial number, and the number of damaged places."""
    streams: dict[int, Stream] = {}
    bad = at = 0
    while at < len(media):
        if media[at : at + 4] != CAPTURE:
            bad += 1
            at = media.find(CAPTURE, at + 1)
            if at < 0:
                break
            continue
        if len(media) < at + 27:
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if version != 0 or len(lacing) < n or end > len(media) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at = media.find(CAPTURE, at + 1)
            if at < 0:
                break
            continue
        _add_page(streams.setdefault(serial, Stream()), flags, granule, number, lacing, page[27 + n :])
        at = end
    return streams, bad


def _add_page(stream: Stream, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
    lost = number != (stream._next or 0)
    if lost:
        stream.gaps += 1
    if lost or not flags & CONTINUED:
        stream._open = None
    skip = bool(flags & CONTINUED) and stream._open is None  # the rest of a packet whose start is missing
    held = stream._open or []
    stream._next, stream.pages = number + 1, stream.pages + 1
    stream.ended |= bool(flags & LAST)
    at, last = 0, None
    for size in lacing:
        held.append(body[at : at + size])
        at += size
        if size < 255:
            if not skip:
                last = Packet(b"".join(held), None)
                stream.packets.append(last)
            held, skip = [], False
    if last is not None and granule != NO_GRANULE:
        last.granule = granule
    stream._open = held if lacing and lacing[-1] == 255 and not skip else None


def put_times(packets: list[Packet], rate: int) -> None:
    """Start and end in seconds of 8-bit mono packets: a page's granule position is the end of the last packet that ends
    on it; packets before it are placed by their lengths, counted back from it, and packets after the last known position
    are counted on from it."""
    known: int | None = None
    for p in reversed(packets):
        known = p.granule if p.granule is not None else known
        if known is not None:
            p.end, p.start = known / rate, (known - len(p.data)) / rate
            known -= len(p.data)
    reached = 0.0
    for p in packets:
        if p.end is None:
            p.start, p.end = reached, reached + len(p.data) / rate
        reached = p.end


def read_media(media: bytes) -> dict:
    """Payload, number of bytes before padding, and what was found on the way."""
    streams, bad = read_streams(media)
    sound = next((s for s in streams.values() if s.packets and s.packets[0].data[:8] == PCM_MAGIC), None)
    length = next((s for s in streams.values() if s.packets and s.packets[0].data == LENGTH_MAGIC), None)
    rate = _PCM.unpack_from(sound.packets[0].data)[4] if sound and len(sound.packets[0].data) >= _PCM.size else RATE
    packets = sound.packets[1:] if sound else []
    put_times(packets, max(rate, 1))
    payload = b"".join(p.data for p in packets)
    n_bytes = struct.unpack("<Q", length.packets[1].data)[0] if length and len(length.packets) > 1 and len(length.packets[1].data) == 8 else None
    return {"payload": payload, "n_bytes": n_bytes, "rate": rate, "streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(packets), "bad": bad, "gaps": sum(s.gaps for s in streams.values()), "seconds": packets[-1].end if packets else 0.0, "ended": bool(sound and sound.ended)}


def features(payload: bytes) -> str:
    """Mean, deviation, zero crossings and a 16-bin histogram of the samples."""
    x = np.frombuffer(payload, "u1")
    if not len(x):
        return "mean=0;std=0;cross=0;hist="
    counts = np.bincount(x >> 4, minlength=16)
    centred = x.astype("i2") - 128
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    return f"mean={x.mean():.4f};std={x.std():.4f};cross={crossings};hist={','.join(map(str, counts))}"


def text_to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media: every whole text as an Ogg file."""

    def make():
        def one(row):
            data = row[1]
            payload = data + b"\0" * (max(PAD, -(-len(data) // PAD) * PAD) - len(data))
            return row[0], write_media(payload, len(data))

        return one

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"))
    return map_rows(rows, "doc_id long, media binary", make)


def media_to_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What reading each Ogg file finds. Null media counts as an empty file; damaged places are counted, never raised."""

    def make():
        def one(row):
            media = row[1] or b""
            got = read_media(media)
            payload = got["payload"]
            feature = f"rate={got['rate']};seconds={got['seconds']:.6f};packets={got['packets']};{features(payload)}"
            return (
                row[0], got["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]),
                len(media), hashlib.sha256(media).hexdigest(), feature, got["streams"], got["pages"], got["bad"] + got["gaps"],
            )

        return one

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return map_rows(
        rows,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_streams int, n_pages int, n_damaged int",
        make,
    )
