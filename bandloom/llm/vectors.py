"""Vectors of a table as whole-number matrices, batch by batch, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT = 1 << 53  # whole numbers below it are exact as doubles
CELLS = 1 << 21  # numbers of a matrix
LONG = (1 << 63) - 1


def width(table: DataFrame, vector: str) -> int:
    """Dimensions of the longest vector."""
    return table.agg(F.max(F.size(F.col(vector)))).first()[0] or 0


def finite(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their lengths, their components one after another): neither the vector nor a component may be null or not finite."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    good = lengths >= 0
    good[own[~np.isfinite(values)]] = False
    return np.flatnonzero(good), lengths[good], values[good[own]]


def matrices(batch: pa.RecordBatch, vector: str, scale: int, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of floor(scale * x)) of at most CELLS numbers each; shorter vectors end in zeros.

    A matrix is of doubles where each of its numbers is exact as one, of Python's whole numbers elsewhere.
    """
    rows, lengths, values = finite(batch.column(batch.schema.get_field_index(vector)))
    ends = np.cumsum(lengths)
    step = max(1, min(2048, CELLS // max(1, wide)))
    for k in range(0, len(rows), step):
        part = lengths[k : k + step]
        x = values[ends[k] - part[0] : ends[min(k + step, len(rows)) - 1]]
        small = len(x) == 0 or np.abs(x).max() < EXACT / scale
        out = np.zeros((len(part), wide), float if small else object)
        whole = np.floor(x * scale) + 0.0 if small else [int(np.floor(v * scale)) if abs(v) < EXACT else int(v) * scale for v in x]
        out[np.arange(wide) < part[:, None]] = whole
        yield rows[k : k + step], out


def as_long(n) -> int:
    """A whole number as a long; what does not fit is the nearest long."""
    return max(-LONG - 1, min(LONG, int(n)))
