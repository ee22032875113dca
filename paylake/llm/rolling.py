"""Rolling hashes: prefix sums of a polynomial over bytes or words."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from . import common

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 2**64)
_BYTES = np.random.default_rng(400).integers(0, 2**63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        m = max(n, 1 << 20)
        _power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(m - 1, BASE, np.uint64))])
        _inverse = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(m - 1, _INVERSE, np.uint64))])
    return _power, _inverse


class Hashes:
    """Hashes of substrings of a string, of 64 bits each, one for each array of ``symbols``
    (its symbols as unsigned 64-bit integers)."""

    def __init__(self, symbols: Iterable[np.ndarray]):
        self.sums = []
        for x in symbols:
            power, self.inverse = powers(len(x) + 1)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(x * power[:len(x)])]))

    @classmethod
    def of_bytes(cls, data: np.ndarray, tables: int = 2) -> Hashes:
        return cls(_BYTES[k][data] for k in range(tables))

    def of(self, lo: np.ndarray, hi: np.ndarray, table: int) -> np.ndarray:
        s = self.sums[table]
        return common.mix64((s[hi] - s[lo]) * self.inverse[lo])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))
