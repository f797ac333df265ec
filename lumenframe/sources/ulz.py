"""ULZ streams: blocks of LZ77 tokens with a window of 128 KiB and matches of 4 bytes at least."""

from __future__ import annotations

import struct

MAGIC, BLOCK, WINDOW, LEAST = b"ULZ!", 1 << 24, 1 << 17, 4


class UlzError(ValueError):
    pass


def _number(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        n -= 128
        out.append(128 + (n & 127))
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while shift <= 21:
        c = data[at]
        at += 1
        n += c << shift
        shift += 7
        if c < 128:
            break
    return n, at


def compress_block(data: bytes, tries: int = 16) -> bytes:
    """Greedy matching by chains of earlier places of the next four bytes; at most so many are tried."""
    out, seen, at, start, n = bytearray(), {}, 0, 0, len(data)

    def put(length: int, distance: int) -> None:
        run, m = at - start, length - LEAST
        out.append(min(run, 7) << 5 | (distance >> 12 & 16) | min(m, 15) if length else min(run, 7) << 5)
        if run >= 7:
            out.extend(_number(run - 7))
        out.extend(data[start:at])
        if length:
            if m >= 15:
                out.extend(_number(m - 15))
            out.extend(struct.pack("<H", distance & 0xFFFF))

    def note(i: int) -> None:
        seen.setdefault(data[i : i + 4], []).append(i)

    while at + LEAST <= n:
        best, far = 0, 0
        for i in reversed(seen.get(data[at : at + 4], [])[-tries:]):
            if at - i >= WINDOW:
                break
            k = LEAST
            while at + k < n and data[i + k] == data[at + k]:
                k += 1
            if k > best:
                best, far = k, at - i
        if best:
            put(best, far)
            for i in range(at, min(at + best, n - LEAST + 1)):
                note(i)
            at += best
            start = at
        else:
            note(at)
            at += 1
    at = n
    if start < n:
        put(0, 0)
    return bytes(out)


def decompress_block(data: bytes, limit: int = BLOCK) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    try:
        while at < n:
            t = data[at]
            at += 1
            if t >= 32:
                run = t >> 5
                if run == 7:
                    more, at = _read_number(data, at)
                    run += more
                if at + run > n:
                    raise UlzError("a literal run goes over the end")
                out += data[at : at + run]
                at += run
                if at >= n:
                    break
            m = (t & 15) + LEAST
            if t & 15 == 15:
                more, at = _read_number(data, at)
                m += more
            d = ((t & 16) << 12) + struct.unpack_from("<H", data, at)[0]
            at += 2
            if not 0 < d <= len(out) or len(out) + m > limit:
                raise UlzError("a match lies outside")
            for _ in range(m // d + 1 if d < m else 1):
                part = out[-d:][:m] if d < m else out[len(out) - d : len(out) - d + m]
                out += part
                m -= len(part)
                if m <= 0:
                    break
    except (IndexError, struct.error) as e:
        raise UlzError("the block ends early") from e
    return bytes(out)


def compress(data: bytes) -> bytes:
    out = bytearray(MAGIC)
    for at in range(0, len(data), BLOCK):
        block = compress_block(data[at : at + BLOCK])
        out += struct.pack("<I", len(block)) + block
    return bytes(out)


def decompress(data: bytes) -> bytes:
    if data[:4] != MAGIC:
        raise UlzError("not a ULZ stream")
    out, at = bytearray(), 4
    while at < len(data):
        size = struct.unpack_from("<I", data, at)[0]
        out += decompress_block(data[at + 4 : at + 4 + size])
        at += 4 + size
    return bytes(out)
