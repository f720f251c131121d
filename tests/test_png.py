"""PNG of all filters, depths, palettes and interlacing against the pixels they were made of."""

import struct
import zlib

import numpy as np
import pytest

from reportlake.operators import images as I
from reportlake.workloads.pixels import filtered_lines


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(width, height, bits, colour, interlaced, lines, palette=b""):
    head = struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlaced)
    extra = chunk(b"PLTE", palette) if palette else b""
    return I.PNG_START + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (7, 1), (20, 33), (300, 200)])
def test_all_filters(shape):
    pixels = np.random.default_rng(0).integers(0, 65535, shape).astype(np.uint16)
    content = png(shape[1], shape[0], 16, 0, 0, filtered_lines(pixels, 3))
    assert (I.read_png(content) == pixels).all()


def packed(rows, bits):
    spread = lambda r: np.array([[v >> (bits - 1 - i) & 1 for i in range(bits)] for v in r], np.uint8).ravel()
    return b"".join(b"\0" + np.packbits(spread(r)).tobytes() for r in rows)


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_low_bits_palettes_and_passes(bits):
    rng = np.random.default_rng(bits)
    pixels = rng.integers(0, 2**bits, (9, 13)).astype(np.uint8)
    palette = rng.integers(0, 256, (2**bits, 3)).astype(np.uint8)
    in_passes = b"".join(packed(pixels[y::dy, x::dx], bits) for x, y, dx, dy in I.PASSES if pixels[y::dy, x::dx].size)
    for interlaced, lines in enumerate((packed(pixels, bits), in_passes)):
        assert (I.read_png(png(13, 9, bits, 0, interlaced, lines)) == pixels * (255 // (2**bits - 1))).all()
        assert (I.read_png(png(13, 9, bits, 3, interlaced, lines, palette.tobytes())) == palette[pixels]).all()
