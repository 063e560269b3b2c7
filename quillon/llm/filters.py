"""A filter over 64-bit hashes, built by the tasks: false positives cost work, never results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that the filter is cut into.
PIECES = 64


def passes(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those that the filter was built from."""
    bits = len(packed).bit_length() + 2
    place = (values >> np.uint64(64 - bits)).astype(np.int64)
    return ((packed[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool)


def _pieces(bits: int):
    """Hashes dealt out by the piece that they fall into in; the bits of each piece out. A task holds the pieces that it was dealt."""
    width = (1 << bits) // PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            piece = at // width
            for p in np.unique(piece).tolist():
                if p not in held:
                    held[p] = np.zeros(width // 8, np.uint8)
                own = at[piece == p] - p * width
                np.bitwise_or.at(held[p], own >> 3, np.uint8(128) >> (own & 7).astype(np.uint8))
        for p, x in held.items():
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["piece", "bits"])

    return run


def collected_filter(hashes: DataFrame, most: int, least: int = 16) -> np.ndarray:
    """The packed bits of a filter over hashes(one long column): some 16 bits for each hash, 2**least at least and 2**most at most.
    2**most bits are what comes to the driver at most. Hashes are shuffled by the piece that they fall into, so that no task holds the whole filter."""
    n = hashes.count()
    bits = min(most, max(least, (16 * n).bit_length()))
    (h,) = hashes.columns
    dealt = hashes.repartition(F.shiftrightunsigned(h, 64 - PIECES.bit_length() + 1))
    found = dealt.mapInArrow(_pieces(bits), "piece int, bits binary").collect()
    out = np.zeros((PIECES, (1 << bits) // 8 // PIECES), np.uint8)
    for x in found:
        out[x.piece] = np.frombuffer(x.bits, np.uint8)
    return out.reshape(-1)
