"""A baseline JPEG encoder: 4:4:4, Huffman codes made for the picture."""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np

_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: The standard's example quantisation, row by row.
_LUMA = np.array([
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
], np.uint8)
_CHROMA = np.array([
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
], np.uint8)
_k = np.arange(8)
_DCT = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k == 0, np.sqrt(0.125), 0.5)[:, None]


def _quantiser(base: np.ndarray, quality: int) -> np.ndarray:
    quality = max(1, min(100, quality or 90))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base.astype(int) * scale + 50) // 100, 1, 255)


def _blocks(plane: np.ndarray) -> np.ndarray:
    """(n, 8, 8) blocks, row by row; the last row and column repeat to fill them."""
    h, w = plane.shape
    full = np.pad(plane, ((0, -h % 8), (0, -w % 8)), "edge")
    return full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)


def _code_lengths(counts: Counter) -> dict[int, int]:
    """Huffman code lengths to 16 bits; no code is all ones, as one place more is filled than there are symbols."""
    nodes = sorted((n, (s,)) for s, n in counts.items())
    nodes.insert(0, (0, (-1,)))
    depth = dict.fromkeys([*counts, -1], 0)
    while len(nodes) > 1:
        (a, left), (b, right), *nodes = sorted(nodes)
        for s in left + right:
            depth[s] += 1
        nodes.append((a + b, left + right))
    per = [0] * 64
    for d in depth.values():
        per[max(d, 1)] += 1
    for i in range(63, 16, -1):
        while per[i] > 0:
            j = i - 2
            while per[j] == 0:
                j -= 1
            per[i] -= 2
            per[i - 1] += 1
            per[j + 1] += 2
            per[j] -= 1
    for i in range(16, 0, -1):
        if per[i]:
            per[i] -= 1  # the place of the symbol that isn't there
            break
    out, at = {}, iter(sorted(counts, key=lambda s: (depth[s], s)))
    for size in range(1, 17):
        for _ in range(per[size]):
            out[next(at)] = size
    return out


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    out, code, last = {}, 0, 0
    for s, size in lengths.items():
        code <<= size - last
        out[s], last = (code, size), size
        code += 1
    return out


def _symbols(blocks: np.ndarray):
    """For each block its symbols as (class, symbol, extra bits, number of extra bits)."""
    before = 0
    bits = lambda v: (v if v >= 0 else v + (1 << abs(v).bit_length()) - 1, abs(v).bit_length())
    for z in blocks.tolist():
        d, before = z[0] - before, z[0]
        extra, size = bits(d)
        out = [(0, size, extra, size)]
        run = 0
        for v in z[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                out.append((1, 0xF0, 0, 0))
                run -= 16
            extra, size = bits(v)
            out.append((1, run << 4 | size, extra, size))
            run = 0
        if run:
            out.append((1, 0, 0, 0))
        yield out


def encode(picture: np.ndarray, quality: int = 75, flip: bool = False) -> bytes:
    """A JPEG of a picture (h, w[, 3]); quality 1 to 100, 0 for 90; flip turns it upside down."""
    v = picture[::-1] if flip else picture
    h, w = v.shape[:2]
    if v.ndim == 2:
        planes = [v.astype(float)]
    else:
        r, g, b = (v[:, :, k].astype(float) for k in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    tables = [_quantiser(_LUMA, quality), _quantiser(_CHROMA, quality)][: 1 if len(planes) == 1 else 2]
    found = []
    for i, plane in enumerate(planes):
        c = _DCT @ (_blocks(plane) - 128) @ _DCT.T
        q = np.trunc(c.reshape(-1, 64) / tables[min(i, 1)] + np.where(c.reshape(-1, 64) < 0, -0.5, 0.5)).astype(int)[:, _ZIGZAG]
        found.append(list(_symbols(q)))
    counts = [[Counter(), Counter()] for _ in tables]
    for i, blocks in enumerate(found):
        for block in blocks:
            for kind, s, _, _ in block:
                counts[min(i, 1)][kind][s] += 1
    lengths = [[_code_lengths(c) for c in pair] for pair in counts]
    codes = [[_codes(x) for x in pair] for pair in lengths]
    out = bytearray(b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
    for i, t in enumerate(tables):
        out += b"\xff\xdb" + struct.pack(">HB", 67, i) + bytes(int(t[k]) for k in _ZIGZAG)
    out += b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * len(planes), 8, h, w, len(planes)) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(len(planes)))
    for i, pair in enumerate(lengths):
        for kind, x in enumerate(pair):
            per = [sum(size == n for size in x.values()) for n in range(1, 17)]
            out += b"\xff\xc4" + struct.pack(">HB", 19 + len(x), kind << 4 | i) + bytes(per) + bytes(x)
    out += b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(planes), len(planes)) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(len(planes))) + b"\x00\x3f\x00"
    held = size = 0
    for group in zip(*found):
        for i, block in enumerate(group):
            for kind, s, extra, n in block:
                code, k = codes[min(i, 1)][kind][s]
                held, size = (held << k | code) << n | extra, size + k + n
                while size >= 8:
                    size -= 8
                    byte = held >> size & 255
                    out.append(byte)
                    if byte == 255:
                        out.append(0)
                held &= (1 << size) - 1
    if size:
        byte = (held << (8 - size) | (1 << (8 - size)) - 1) & 255
        out.append(byte)
        if byte == 255:
            out.append(0)
    return bytes(out + b"\xff\xd9")
