"""A bounded filter of 64-bit keys: what it lacks isn't among them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 15, 28


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits, eight to a byte, at the places of the rows' `key` (long): 16 and more bits for each, at most 2**28 (32 MB).

    Beyond 16 million keys it lets more through, so an exact step always follows. At most 2**13 rows, of
    4 kB each, come to the driver.
    """
    n = keys.count()
    k = min(max((16 * n - 1).bit_length(), LEAST_BITS), MOST_BITS) if n else LEAST_BITS
    place = keys.select(F.pmod(F.col("key"), F.lit(1 << k)).alias("place"))
    maps = place.groupBy(F.shiftright("place", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("place") % (1 << 15)).alias("bits"))
    bits = np.zeros(1 << (k - 3), dtype=np.uint8)
    for row in maps.collect():  # one job; an iterator would start one for each partition
        bits[row["block"] << 12 : (row["block"] + 1) << 12] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bits


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each of the keys (unsigned), whether it may be among those of the filter."""
    place = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
