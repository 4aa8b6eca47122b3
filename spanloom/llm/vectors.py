"""Vectors of floats as vectors of whole numbers, for exact sums and products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest size of a component; squares of distances over 64 components stay under 2^62.
LARGEST = 1 << 26


def whole_vectors(rows: DataFrame, scale: int, dims: int | None = None, column: str = "embedding") -> DataFrame:
    """Adds ``vector``, floor(scale * x) of each component x as a double.

    Rows whose vector is null, has a null or non-finite component or, with ``dims``, another
    length are left out.  A component that scales to over LARGEST raises an error.
    """
    there = F.col(column)
    sound = there.isNotNull() & F.forall(there, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    if dims is not None:
        sound = sound & (F.size(there) == dims)
    scaled = F.transform(there, lambda x: x.cast("double") * scale)
    large = F.exists(scaled, lambda x: F.abs(x) >= LARGEST)
    whole = F.transform(scaled, lambda x: F.floor(x))
    error = F.raise_error(F.lit(f"a component scales to over {LARGEST}")).cast("array<bigint>")
    return rows.where(F.coalesce(sound, F.lit(False))).withColumn("vector", F.when(large, error).otherwise(whole))


def matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Arrow lists of whole numbers as the rows of an array, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0)) if width is None else width
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out
