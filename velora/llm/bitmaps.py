"""A map of hashes that fits in a broadcast, whatever their number."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.llm.substring_dedup import BITS_EACH, _bit_map


@dataclass
class BitMap:
    """bits over size places, a power of two. What was put in is found; of other hashes some are, which callers have to allow for."""

    bits: np.ndarray
    size: int

    def has(self, names: np.ndarray) -> np.ndarray:
        place = (names.view(np.uint64) & np.uint64(self.size - 1)).astype(np.int64)
        return ((self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def bit_map(hashes: DataFrame, column: str, each: int = BITS_EACH) -> BitMap:
    """The map of a column of 64-bit hashes: each bits a hash, 16 MB at most."""
    return BitMap(*_bit_map(hashes.select(F.col(column).alias("p")), each))
