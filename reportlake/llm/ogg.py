"""Media columns in Ogg: 8-bit samples as packets in pages, several logical streams in one file.

Writing: samples are cut in packets, dealt in turn to the logical streams; a packet is laced (255s and a
rest) into segments, up to 255 segments make a page, and a page carries its stream's serial
number, sequence number, the granule position of the last packet that ends in it, and a
checksum. Each stream begins with a page that holds its description.

Reading: pages are found by their capture pattern, the checksum is computed anew, pages
are dealt to their streams by serial number and must follow in sequence, packets are put together from the
lacing values across pages, and a page's granule position gives the end of its last packet, from which the
packets before it on that page are counted back. Packets are placed at the positions so derived, over all streams; they must
follow without a gap or an overlap from the first sample to the last, or the file is refused.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import whole_text

HEAD = "<4sBBqIIIB"
HEAD_SIZE = struct.calcsize(HEAD)
ABOUT = "<8sIIIIq"  # mark, rate, packet size, streams, index of the stream, samples in all
MARK = b"pcm8samp"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = -1
BLOCK = 64

# a byte with its bits reversed: Ogg's checksum runs from the highest bit, zlib's from the lowest
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Polynomial 04C11DB7, start 0, no final turn, highest bit first: zlib's sum of the mirrored bytes, mirrored back."""
    turned = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{turned:032b}"[::-1], 2)


@dataclass(frozen=True)
class Layout:
    rate: int = 8000
    packet: int = 1000
    streams: int = 2


def page(serial: int, number: int, kind: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    blank = struct.pack(HEAD, b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:]


def stream_pages(serial: int, packets: list[bytes], granules: list[int]) -> Iterator[tuple[int, bytes]]:
    """(granule position, page) of one logical stream; packets[0] describes it and has a page to itself."""
    number = 0
    lacing, body, granule, kind = bytearray(), bytearray(), NO_PACKET_ENDS, FIRST
    reached = 0
    for i, (packet, end) in enumerate(zip(packets, granules, strict=True)):
        values = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        for j, value in enumerate(values):
            if len(lacing) == 255:
                yield reached, page(serial, number, kind, granule, bytes(lacing), bytes(body))
                number, kind, granule = number + 1, CONTINUED if j else 0, NO_PACKET_ENDS
                lacing, body = bytearray(), bytearray()
            lacing.append(value)
            body += packet[at : at + value]
            at += value
        granule = reached = end
        if i == 0 and len(packets) > 1:
            yield reached, page(serial, number, kind, granule, bytes(lacing), bytes(body))
            number, kind, granule, lacing, body = 1, 0, NO_PACKET_ENDS, bytearray(), bytearray()
    yield reached, page(serial, number, kind | LAST, granule, bytes(lacing), bytes(body))


def stored(samples: bytes, layout: Layout = Layout()) -> bytes:
    """An Ogg file with the samples in several logical streams, their pages in order of time."""
    pages: list[tuple[int, int, int, bytes]] = []
    cut = [samples[i : i + layout.packet] for i in range(0, len(samples), layout.packet)]
    for s in range(layout.streams):
        about = struct.pack(ABOUT, MARK, layout.rate, layout.packet, layout.streams, s, len(samples))
        own = range(s, len(cut), layout.streams)
        granules = [0] + [min(len(samples), (i + 1) * layout.packet) for i in own]
        found = stream_pages(s + 1, [about, *(cut[i] for i in own)], granules)
        # all first pages stand before any other, as the format asks
        pages += [(0 if n == 0 else 1, at, s, p) for n, (at, p) in enumerate(found)]
    return b"".join(p for *_, p in sorted(pages, key=lambda x: x[:3]))


@dataclass
class Logical:
    number: int = 0
    open: bytearray | None = None
    packets: list[tuple[bytes, int]] = field(default_factory=list)  # packet and its page's granule position
    ended: bool = False
    granule: int = 0


def pages_of(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(kind, granule, serial, number, lacing, body) of each page; raises ValueError on damage."""
    at = 0
    while at < len(data):
        if len(data) - at < HEAD_SIZE:
            raise ValueError("file ends inside a page")
        mark, version, kind, granule, serial, number, crc, n = struct.unpack_from(HEAD, data, at)
        if mark != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = data[at + HEAD_SIZE : at + HEAD_SIZE + n]
        end = at + HEAD_SIZE + n + sum(lacing)
        whole = data[at:end]
        if len(lacing) < n or end > len(data) or checksum(whole[:22] + bytes(4) + whole[26:]) != crc:
            raise ValueError(f"checksum of the page at byte {at} is wrong")
        yield kind, granule, serial, number, lacing, whole[HEAD_SIZE + n :]
        at = end


def streams_of(data: bytes) -> tuple[dict[int, Logical], int]:
    """Logical streams by serial number, with their packets put together, and the number of pages."""
    found: dict[int, Logical] = {}
    count = 0
    for kind, granule, serial, number, lacing, body in pages_of(data):
        count += 1
        if kind & FIRST:
            if serial in found:
                raise ValueError(f"stream {serial} begins twice")
            found[serial] = Logical()
        stream = found.get(serial)
        if stream is None or stream.ended or number != stream.number:
            raise ValueError(f"page {number} of stream {serial} is out of sequence")
        if bool(kind & CONTINUED) != (stream.open is not None):
            raise ValueError(f"a packet of stream {serial} is broken")
        stream.number += 1
        at = 0
        for value in lacing:
            stream.open = (stream.open or bytearray()) + body[at : at + value]
            at += value
            if value < 255:
                if granule == NO_PACKET_ENDS:
                    raise ValueError(f"a packet of stream {serial} ends without a time")
                stream.packets.append((bytes(stream.open), granule))
                stream.open = None
        if granule != NO_PACKET_ENDS:
            if granule < stream.granule:
                raise ValueError(f"time of stream {serial} runs back")
            stream.granule = granule
        stream.ended = bool(kind & LAST)
    if any(s.open is not None or not s.ended for s in found.values()):
        raise ValueError("a stream has no end")
    return found, count


def placed(packets: list[tuple[bytes, int]], step: int) -> Iterator[tuple[int, bytes]]:
    """(first sample, packet) by the granule positions; packets of a stream begin ``step`` samples apart."""
    for granule, page in groupby(packets, key=lambda x: x[1]):
        pieces = [piece for piece, _ in page]
        first = granule - len(pieces[-1]) - (len(pieces) - 1) * step
        yield from ((first + n * step, piece) for n, piece in enumerate(pieces))


def read_back(data: bytes) -> tuple[bytes, dict]:
    """The samples of a file that ``stored`` made, and what its pages tell; ``times`` holds the serial number and first second of each packet."""
    found, pages = streams_of(data)
    pieces: list[tuple[int, int, bytes]] = []
    rate = total = 0
    for serial, stream in found.items():
        mark, rate, packet, streams, _, total = struct.unpack(ABOUT, stream.packets[0][0])
        if mark != MARK or stream.packets[0][1]:
            raise ValueError("not a stream of samples")
        pieces += [(first, serial, piece) for first, piece in placed(stream.packets[1:], packet * streams)]
    pieces.sort(key=lambda x: x[0])
    reached = 0
    for first, serial, piece in pieces:
        if first != reached:
            raise ValueError(f"times of stream {serial} leave sample {reached} and go on at {first}")
        reached += len(piece)
    if reached != total:
        raise ValueError("samples are missing")
    told = {"streams": len(found), "pages": pages, "packets": sum(len(s.packets) for s in found.values())}
    told |= {"seconds": max(s.granule / rate for s in found.values()), "times": [(serial, first / rate) for first, serial, _ in pieces]}
    return b"".join(piece for *_, piece in pieces), told


def padded(raw: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of 64."""
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame, text: str = "text", layout: Layout = Layout(), keep: bool = False) -> DataFrame:
    """``docs`` with the columns of ``RESULT``, and ``media`` (the file) if asked for.

    Null counts as empty and is stored as 64 bytes 0. All values but ``n_bytes`` and ``media_bytes``
    come from the samples read back. Columns of these names are replaced; repeated rows are each stored.
    """
    schema = RESULT + (", media binary" if keep else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def row(text: str) -> tuple:
        raw = text.encode("utf-8")
        data = stored(padded(raw), layout)
        samples, told = read_back(data)
        loud = sum(samples) // len(samples)  # mean sample
        feature = f"{told['streams']}/{told['pages']}/{told['packets']}/{told['seconds']:.6f}/{loud}"
        values = (len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]))
        values += (len(data), hashlib.sha256(data).hexdigest(), feature)
        return (*values, data) if keep else values

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row(t) for t in batch], columns=names)

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.select(*rest, run(whole_text(text)).alias("__media")).select(*rest, "__media.*")
