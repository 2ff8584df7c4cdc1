"""Number columns packed into binary values, so that one shuffled row carries many of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal significance stand together, which lets the compressor drop leading zeros."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd").decompress(data[8:], size, asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def steps(values: np.ndarray) -> bytes:
    """Packs rising numbers by their differences."""
    return pack(np.diff(values, prepend=0).astype(np.uint32))


def unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint32).astype(np.int64))
