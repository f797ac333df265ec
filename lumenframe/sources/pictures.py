"""BMP, PNM and raw pictures, EXIF orientation, and choice of decoder. Pictures are arrays (height, width[, 3]) of bytes in RGB."""

from __future__ import annotations

import re
import struct

import numpy as np


class PictureError(ValueError):
    pass


def read_bmp(data: bytes) -> np.ndarray:
    """An uncompressed 24-bit BMP, whichever way up."""
    if data[:2] != b"BM":
        raise PictureError("not a BMP")
    offset, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if size == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        packed = 0
    elif size in (40, 56, 108, 124):
        w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    else:
        raise PictureError("unknown header")
    if bits != 24 or packed:
        raise PictureError("24 bits without compression only")
    step = -(-3 * w // 4) * 4
    rows = np.frombuffer(data, np.uint8, step * abs(h), offset).reshape(abs(h), step)[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
    return rows[::-1].copy() if h > 0 else rows.copy()


def write_bmp(v: np.ndarray) -> bytes:
    """A 24-bit BMP, bottom row first; grey pictures get equal channels."""
    v = np.repeat(v[:, :, None], 3, 2) if v.ndim == 2 else v
    h, w, _ = v.shape
    step = -(-3 * w // 4) * 4
    rows = np.zeros((h, step), np.uint8)
    rows[:, : 3 * w] = v[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


_PNM = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)[ \t]+(\d+)[ \t]+(\d+)\s|P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s")


def read_pnm(data: bytes) -> np.ndarray:
    """A PGM (P5) or PPM (P6) of values to 255."""
    m = _PNM.match(data)
    if not m:
        raise PictureError("not a P5 or P6 file")
    kind, w, h, top = (x for x in m.groups() if x is not None)
    if int(top) != 255:
        raise PictureError("values to 255 only")
    shape = (int(h), int(w), 3) if kind == b"6" else (int(h), int(w))
    return np.frombuffer(data, np.uint8, int(np.prod(shape)), m.end()).reshape(shape).copy()


def write_pnm(v: np.ndarray) -> bytes:
    return b"P%d\n%d %d 255\n" % (6 if v.ndim == 3 else 5, v.shape[1], v.shape[0]) + v.astype(np.uint8).tobytes()


def from_raw(data: bytes, h: int, w: int, order: str, stride: int | None = None) -> np.ndarray:
    """Interleaved bytes in an order such as 'bgra' to RGB."""
    n = len(order)
    stride = stride or n * w
    rows = np.frombuffer(data, np.uint8, stride * h).reshape(h, stride)[:, : n * w].reshape(h, w, n)
    return rows[:, :, [order.index(c) for c in "rgb"]].copy()


def to_raw(v: np.ndarray, order: str) -> bytes:
    """RGB to interleaved bytes; alpha is 255."""
    full = np.concatenate([v, np.full((*v.shape[:2], 1), 255, np.uint8)], 2)
    return full[:, :, ["rgba".index(c) for c in order]].tobytes()


def exif_orientation(data: bytes) -> int | None:
    """Orientation 1 to 8 of a JPEG; 0 if it gives none, null if its EXIF part is broken."""
    at = 2
    if data[:2] != b"\xff\xd8":
        return None
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if mark == 0xDA:
            break
        if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tiff = data[at + 10 : at + 2 + size]
            if tiff[:2] not in (b"II", b"MM"):
                return None
            e = "<" if tiff[:2] == b"II" else ">"
            try:
                first = struct.unpack_from(e + "I", tiff, 4)[0]
                for k in range(struct.unpack_from(e + "H", tiff, first)[0]):
                    tag, kind, _ = struct.unpack_from(e + "HHI", tiff, first + 2 + 12 * k)
                    if tag == 0x112:
                        v = struct.unpack_from(e + ("H" if kind == 3 else "I"), tiff, first + 10 + 12 * k)[0]
                        return v if 1 <= v <= 8 else None
            except struct.error:
                return None
            return 0
        at += 2 + size
    return 0


def luma_of(v: np.ndarray) -> np.ndarray:
    """RGB to grey with 8-bit weights."""
    r, g, b = (v[:, :, k].astype(np.int32) for k in range(3))
    return ((77 * r + 150 * g + 29 * b) >> 8).astype(np.uint8)


def decode(path: str, data: bytes) -> np.ndarray:
    """By extension: .bmp, .ppm, .pgm; JPEGs are read by spark.read.format('image')."""
    ext = path[path.rfind(".") :].lower() if "." in path else ""
    if ext == ".bmp":
        return read_bmp(data)
    if ext in (".ppm", ".pgm"):
        return read_pnm(data)
    raise PictureError(f"no decoder for '{ext}'")
