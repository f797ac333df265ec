"""Binary archives of table regression models: height, width and bins as 32-bit integers, then each cell's weights as floats."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd


def dump(model: pd.DataFrame, h: int, w: int, bins: int) -> bytes:
    """model: columns y, x, bin, weight; bins without a weight are 0. At most bins numbers a cell, whatever it was trained on."""
    v = np.zeros((h, w, bins), "<f4")
    v[model["y"], model["x"], model["bin"]] = model["weight"]
    return struct.pack("<3i", h, w, bins) + v.tobytes()


def load(data: bytes) -> pd.DataFrame:
    h, w, bins = struct.unpack_from("<3i", data)
    v = np.frombuffer(data, "<f4", h * w * bins, 12)
    y, x, b = np.unravel_index(np.arange(v.size), (h, w, bins))
    return pd.DataFrame({"y": y, "x": x, "bin": b, "weight": v.astype(float)})
