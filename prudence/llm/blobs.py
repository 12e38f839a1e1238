"""Number arrays as small binary values, for rows that carry many numbers through a shuffle."""

from __future__ import annotations

import numpy as np
import zstandard


def packed(values: np.ndarray) -> bytes:
    """An array of whole numbers of 0 and more, or of doubles, compressed; whole numbers in as few bytes as hold the largest."""
    if values.dtype.kind in "iub":
        values = values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return values.dtype.char.encode() + zstandard.compress(planes, 1)


def unpacked(blob: bytes) -> np.ndarray:
    """What packed() was given; whole numbers as int64."""
    kind = np.dtype(blob[:1].decode())
    planes = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8).reshape(kind.itemsize, -1)
    values = planes.T.copy().view(kind).ravel()
    return values if kind.kind == "f" else values.astype(np.int64)


def joined(words: list[str]) -> bytes:
    """Words without line ends, compressed."""
    return zstandard.compress("\n".join(words).encode(), 1)


def parted(blob: bytes) -> list[str]:
    """The words of joined(); there is at least one."""
    return zstandard.decompress(blob).decode().split("\n")
