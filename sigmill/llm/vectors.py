"""Arrow lists of numbers as numpy matrices; used by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): nothing else of `rows` is read, so no name can clash."""
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))


def width(rows: DataFrame) -> int:
    """Entries of the longest vector of (id, vec); shorter ones count as filled up with zeros."""
    return max(0, rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0])


def matrix(column: pa.Array, d: int, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the lists of a batch that are not null and hold only numbers whose size is finite and at most `most`."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(np.nan).to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    usable = column.is_valid().to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(flat) | (np.abs(flat) > most)
    usable[row[bad]] = False
    out = np.zeros((len(size), d))
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)] = np.where(bad, 0, flat)
    places = np.flatnonzero(usable)
    return places, out[places]
