"""Arrow text columns as numpy arrays of code points and back, without a call per string."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def split(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all values one after another, bounds of each value in them). Null is like empty text."""
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    n = len(col)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _valid, offs, data = col.buffers()
    at = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = memoryview(data)[at[0] : at[-1]] if data is not None else b""
    cps = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cps) == len(raw):
        return cps, at - at[0]
    lead = np.frombuffer(raw, np.uint8)
    upto = np.concatenate(([0], np.cumsum((lead & 0xC0) != 0x80, dtype=np.int64)))
    return cps, upto[at - at[0]]


def text(cps: np.ndarray) -> str:
    return cps.astype("<u4").tobytes().decode("utf-32-le")


def join(cps: np.ndarray, bounds: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The reverse of split(); where valid is false, null."""
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    upto = np.concatenate(([0], np.cumsum(width)))
    offsets = upto[bounds].astype(np.int32)
    data = text(cps).encode("utf-8")
    mask = None
    if valid is not None:
        mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data), mask)


def any_in(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each value whether any of its code points has the flag."""
    upto = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return upto[bounds[1:]] > upto[bounds[:-1]]
