"""Hilbert curve keys of points with many coordinates, for whole arrays at once.

The public transpose method (Skilling, "Programming the Hilbert curve", 2004): undo the excess work
of each bit plane from the top, Gray-encode, and interleave the bits.
"""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Key along the curve of each row of ``points``, integers in ``[0, 2**bits)``; at most 63 bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 63:
        raise ValueError("Keys of more than 63 bits")
    for level in range(bits - 1, 0, -1):
        plane = np.int64(1 << level)
        low = plane - 1
        for i in range(dims):
            set_ = (x[i] & plane) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key
