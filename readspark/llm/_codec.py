"""Small binary forms of integer arrays, for exchanges of many fingerprints in few rows."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray, *, ascending: bool = False) -> bytes:
    """``values`` as bytes; the differences of an ascending array take less room."""
    values = np.ascontiguousarray(values)
    kind = values.dtype.str.encode().ljust(4)
    if ascending and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return kind + bytes([ascending]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes) -> np.ndarray:
    dtype = np.dtype(blob[:4].decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[5:]), np.uint8)
    values = np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if blob[4] else values
