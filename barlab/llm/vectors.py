"""What the two vector operators share: clean double vectors, one short row for each distinct vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """The vector as array<double>, or null if it is null, empty, zero or has null or non-finite components."""
    doubles = vector.cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    good = F.forall(doubles, finite) & F.exists(doubles, lambda x: x != 0)
    return F.when(F.coalesce(good, F.lit(False)), doubles)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long, as an (n, d) array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def dimension(vectors: DataFrame, column: str) -> int:
    """The length of most vectors; 0 without any. Vectors of another length take no part."""
    row = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(row["d"]) if row else 0
