"""Arrays of integers as bytes that compress well."""

from __future__ import annotations

import numpy as np


def planes(x: np.ndarray) -> bytes:
    """Integers with bytes of equal weight together: small ones compress to little more than their lowest byte."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(b: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def spread(x: np.ndarray) -> bytes:
    """Keys in order, as planes of their differences."""
    return planes(np.diff(x, prepend=x.dtype.type(0)) if len(x) else x)


def gathered(b: bytes) -> np.ndarray:
    return np.cumsum(from_planes(b, np.uint64), dtype=np.uint64)
