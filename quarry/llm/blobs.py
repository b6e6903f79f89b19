"""Compact binary rows for shuffles of many small numbers.

``pack`` writes arrays plane by plane of their bytes (equal high bytes become runs) and compresses them once
with zstd; ``unpack`` gives the arrays back.  Sorted keys are best packed as differences.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    head = [struct.pack("<H", len(arrays))]
    body = []
    for a in arrays:
        head.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), a.size))
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(a.size, a.itemsize).T).tobytes() if a.size else b"")
    raw = b"".join(head + body)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], struct.unpack_from("<Q", blob)[0], codec="zstd", asbytes=True)
    count, = struct.unpack_from("<H", raw)
    kinds = [struct.unpack_from("<2sQ", raw, 2 + 10 * j) for j in range(count)]
    at, out = 2 + 10 * count, []
    for kind, size in kinds:
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel() if size else np.zeros(0, dtype))
        at += size * dtype.itemsize
    return out


def deltas(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences (``undelta`` is the inverse)."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def undelta(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def narrow(a: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in the smallest unsigned type that holds them."""
    top = int(a.max()) if a.size else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def range_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """Group of each 64-bit hash: equal ranges of the hash space, so that sorted keys have sorted groups."""
    return ((keys >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
