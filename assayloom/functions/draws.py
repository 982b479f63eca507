"""Random numbers as pure functions of a seed and row keys.

The same row gets the same draw whatever the partitioning, and a retried task
repeats its draws.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from the 53 high bits of a 64-bit hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (bits.cast("double") + 0.5) / float(2**53)


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal draw (Box-Muller transform of two uniforms)."""
    radius = F.sqrt(-2.0 * F.log(uniform(seed, F.lit(1), *keys)))
    return radius * F.cos(2.0 * math.pi * uniform(seed, F.lit(2), *keys))


_STEP = 0x9E3779B97F4A7C15  # SplitMix64 increment
_TURNS = np.array([(i * _STEP) % 2**64 for i in range(4)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shuffled_positions(position: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where a key's permutation of 0..n-1 sends a position.

    A four-round Feistel network on the next even number of bits, walked until it
    lands below n: every row is computed by itself, and no list is ever shuffled.
    """
    x = position.astype(np.uint64)
    size = n.astype(np.uint64)
    seed = _mix(key.astype(np.int64).view(np.uint64) + np.uint64(_STEP))
    half = np.maximum((np.ceil(np.log2(np.maximum(size.astype(float), 2.0))) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right, h, mk = x[todo] >> half[todo], x[todo] & mask[todo], half[todo], mask[todo]
        for step in _TURNS:
            turn = _mix(right + seed[todo] + step)
            left, right = right, left ^ (turn & mk)
        x[todo] = (left << h) | right
        todo &= x >= size
    return x.astype(np.int64)


@pandas_udf(LongType())
def shuffled(position: pd.Series, key: pd.Series, n: pd.Series) -> pd.Series:
    """``shuffled_positions`` of columns."""
    return pd.Series(shuffled_positions(position.to_numpy(), key.to_numpy(), n.to_numpy()))
