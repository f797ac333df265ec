"""WAV and W64 files: reading to samples, writing, and sizes."""

from __future__ import annotations

import struct

import numpy as np

from lumenframe.functions.pcm import alaw_table, mulaw_table

PCM, ADPCM_MS, IEEE, ALAW, MULAW, ADPCM_IMA, EXTENSIBLE = 1, 2, 3, 6, 7, 0x11, 0xFFFE
_W64_RIFF = bytes.fromhex("726966662e91cf11a5d628db04c10000")
_W64_TAIL = bytes.fromhex("f3acd3118cd100c04f8edb8a")
#: The standard step sizes and scales.
_IMA_STEP = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45,
    50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899,
    15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
_IMA_MOVE = [-1] * 4 + [2, 4, 6, 8]
_MS_SCALE = (230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230)


class WavError(ValueError):
    pass


def parse(data: bytes) -> dict:
    """The header: container, format, channels, rate, bits, block, frames, and the samples' bytes."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        kind, at, pad, head = "riff", 12, 2, 8
    elif data[:16] == _W64_RIFF and data[24:28] == b"wave":
        kind, at, pad, head = "w64", 40, 8, 24
    else:
        raise WavError("neither RIFF WAVE nor W64")
    out: dict = {"container": kind}
    try:
        _chunks(data, kind, at, pad, head, out)
    except struct.error as e:
        raise WavError("the file ends early") from e
    if "format" not in out or "data" not in out:
        raise WavError("no format or no samples")
    return out


def _chunks(data: bytes, kind: str, at: int, pad: int, head: int, out: dict) -> None:
    while at + head <= len(data):
        name = data[at : at + 4]
        size = struct.unpack_from("<I", data, at + 4)[0] if kind == "riff" else struct.unpack_from("<Q", data, at + 16)[0] - head
        body = at + head
        if name == b"fmt ":
            f, ch, rate, _, block, bits = struct.unpack_from("<HHIIHH", data, body)
            if f == EXTENSIBLE and size >= 40:
                f = struct.unpack_from("<H", data, body + 24)[0]
            out |= {"format": f, "channels": ch, "rate": rate, "block": block, "bits": bits}
        elif name == b"fact":
            out["fact"] = struct.unpack_from("<I", data, body)[0]
        elif name == b"data":
            out["data"] = data[body : body + size]
            break
        at = body + -(-size // pad) * pad


def _integers(raw: bytes, width: int) -> np.ndarray:
    """Signed samples of a width in bytes, in their own range; bytes are unsigned in the file."""
    raw = raw[: len(raw) // width * width]
    if width == 1:
        return np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        return np.where(v >= 1 << 23, v - (1 << 24), v)
    return np.frombuffer(raw, f"<i{width}").astype(np.int64)


def _ima(h: dict) -> np.ndarray:
    ch, out = h["channels"], []
    for at in range(0, len(h["data"]) - 4 * ch + 1, h["block"]):
        block = h["data"][at : at + h["block"]]
        state = [list(struct.unpack_from("<hB", block, 4 * c)) for c in range(ch)]
        rows = [[s[0]] for s in state]
        rest = block[4 * ch :]
        for g in range(0, len(rest) - 4 * ch + 1, 4 * ch):
            for c in range(ch):
                value, index = state[c]
                index = min(index, 88)
                for byte in rest[g + 4 * c : g + 4 * c + 4]:
                    for code in (byte & 15, byte >> 4):
                        step = _IMA_STEP[index]
                        d = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
                        value = max(-32768, min(32767, value - d if code & 8 else value + d))
                        index = max(0, min(88, index + _IMA_MOVE[code & 7]))
                        rows[c].append(value)
                state[c] = [value, index]
        out.append(np.array(rows, np.int64).T)
    return np.concatenate(out) if out else np.zeros((0, ch), np.int64)


_MS_COEFFICIENTS = list(struct.iter_unpack(">hh", bytes.fromhex("010000000200ff000000000000c0004000f0000001ccff300188ff18")))


def _ms(h: dict) -> np.ndarray:
    ch, out = h["channels"], []
    for at in range(0, len(h["data"]) - 7 * ch + 1, h["block"]):
        block = h["data"][at : at + h["block"]]
        kind = [min(block[c], 6) for c in range(ch)]
        delta = list(struct.unpack_from(f"<{ch}h", block, ch))
        one = list(struct.unpack_from(f"<{ch}h", block, 3 * ch))
        two = list(struct.unpack_from(f"<{ch}h", block, 5 * ch))
        rows = [list(two), list(one)]
        flat = []
        c = 0
        for byte in block[7 * ch :]:
            for code in (byte >> 4, byte & 15):
                a, b = _MS_COEFFICIENTS[kind[c]]
                v = (one[c] * a + two[c] * b >> 8) + (code - 16 if code & 8 else code) * delta[c]
                two[c], one[c] = one[c], max(-32768, min(32767, v))
                delta[c] = max(16, _MS_SCALE[code] * delta[c] >> 8)
                flat.append(one[c])
                c = (c + 1) % ch
        rows += [flat[i : i + ch] for i in range(0, len(flat) - ch + 1, ch)]
        out.append(np.array(rows, np.int64))
    return np.concatenate(out) if out else np.zeros((0, ch), np.int64)


def samples(data: bytes, kind: str = "s16") -> tuple[dict, np.ndarray]:
    """The header and the samples (frames, channels) as 's16', 's32' or 'f32'."""
    h = parse(data)
    f, width = h["format"], h["bits"] // 8
    if f == PCM:
        if width not in (1, 2, 3, 4, 8):
            raise WavError("samples of 1, 2, 3, 4 or 8 bytes only")
        v, bits = _integers(h["data"], width), 8 * width
    elif f == IEEE:
        x = np.frombuffer(h["data"][: len(h["data"]) // width * width], f"<f{width}").astype(float)
        v, bits = x, 0
    elif f in (ALAW, MULAW):
        v, bits = np.array(alaw_table() if f == ALAW else mulaw_table(), np.int64)[np.frombuffer(h["data"], np.uint8)], 16
    elif f in (ADPCM_IMA, ADPCM_MS):
        v, bits = (_ima(h) if f == ADPCM_IMA else _ms(h)).reshape(-1), 16
        if h.get("fact"):
            v = v[: h["fact"] * h["channels"]]
    else:
        raise WavError(f"format {f} is unknown")
    if kind == "f32":
        made = v.astype(np.float32) if not bits else ((v + 128) * (2 / 255) - 1 if bits == 8 else v / 2.0 ** (bits - 1)).astype(np.float32)
    else:
        to = 16 if kind == "s16" else 32
        if not bits:
            top = 32767 if to == 16 else 2147483648.0
            made = np.clip(np.trunc(np.clip(v, -1, 1) * top), -(2.0 ** (to - 1)), 2.0 ** (to - 1) - 1).astype(np.int64)
        else:
            made = v << (to - bits) if bits <= to else v >> (bits - to)
        made = made.astype(np.int16 if to == 16 else np.int32)
    n = len(made) // h["channels"] * h["channels"]
    h = {k: x for k, x in h.items() if k != "data"} | {"frames": n // h["channels"]}
    return h, made[:n].reshape(-1, h["channels"])


def size_of(frames: int, channels: int, bits: int, container: str = "riff") -> int:
    """Bytes of the file that write() makes."""
    body = frames * channels * bits // 8
    return 44 + body + body % 2 if container == "riff" else 104 + -(-body // 8) * 8


def write(v: np.ndarray, rate: int, bits: int = 16, form: int = PCM, container: str = "riff") -> bytes:
    """A file of samples (frames, channels): integers for PCM, floats for IEEE, codes for A-law and mu-law."""
    if form not in (PCM, IEEE, ALAW, MULAW):
        raise WavError("only PCM, IEEE, A-law and mu-law are written")
    ch = v.shape[1]
    if form == IEEE:
        body = v.astype(f"<f{bits // 8}").tobytes()
    elif form != PCM or bits == 8:
        body = (v + (128 if form == PCM else 0)).astype(np.uint8).tobytes()
    elif bits == 24:
        body = (v.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3]).tobytes()
    else:
        body = v.astype(f"<i{bits // 8}").tobytes()
    block = ch * bits // 8
    head = struct.pack("<HHIIHH", form, ch, rate, rate * block, block, bits)
    if container == "riff":
        pad = b"\0" * (len(body) % 2)
        return b"RIFF" + struct.pack("<I", 36 + len(body) + len(pad)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body + pad
    pad = b"\0" * (-len(body) % 8)
    chunk = lambda name, b: name + _W64_TAIL + struct.pack("<Q", 24 + len(b)) + b
    inside = b"wave" + _W64_TAIL + chunk(b"fmt ", head) + chunk(b"data", body) + pad
    return _W64_RIFF + struct.pack("<Q", 24 + len(inside)) + inside
