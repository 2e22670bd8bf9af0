"""Rolling hashes and triggers over byte strings, many positions at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from dealflow.llm.shingles import BYTE, POWER, mixed, powers

U64 = np.uint64
#: Inverse of POWER modulo 2 ** 64.
INVERSE = U64(pow(int(POWER), -1, 1 << 64))


def _rounded(n: int) -> int:
    return 1 << max(n, 1).bit_length()


@lru_cache(4)
def _powers(n: int) -> np.ndarray:
    return powers(n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[i] the polynomial hash of the first i bytes, modulo 2 ** 64."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * _powers(_rounded(len(data)))[: len(data)], out=out[1:])
    return out


@lru_cache(4)
def inverse_powers(n: int) -> np.ndarray:
    """POWER ** 0 ... POWER ** -(n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), INVERSE, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hash(prefix: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Hash of the bytes from ``start`` to ``end``, the same wherever they stand."""
    return mixed((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))
