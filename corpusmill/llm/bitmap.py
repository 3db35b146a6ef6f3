"""Sets of numbers of any size as bitmaps of at most MOST_BITS bits: small enough to broadcast, with false positives but no misses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


class Bitmap:
    """Which numbers may be in a set: a number is looked up by its lowest bits."""

    def __init__(self, bits: int, at: np.ndarray, words: np.ndarray) -> None:
        self.bits, self.words = bits, np.zeros(bits // 64, np.uint64)
        self.words[at] = words

    @classmethod
    def of(cls, rows: DataFrame, number: str) -> Bitmap:
        """A bitmap of a long column; at most MOST_BITS bits come to the driver, whatever the rows are."""
        bits, wanted = LEAST_BITS, min(MOST_BITS, 16 * rows.count())
        while bits < wanted:
            bits <<= 1
        places = rows.selectExpr(f"{number} & {bits - 1}L AS place")
        got = places.selectExpr("shiftright(place, 6) AS at", "shiftleft(1L, cast(place & 63 AS int)) AS bit").groupBy("at").agg({"bit": "bit_or"}).toDF("at", "word").toArrow()
        return cls(bits, got.column("at").to_numpy(), got.column("word").to_numpy().astype(np.int64).view(np.uint64))

    def has(self, numbers: np.ndarray) -> np.ndarray:
        place = numbers.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def __bool__(self) -> bool:
        return bool(self.words.any())
