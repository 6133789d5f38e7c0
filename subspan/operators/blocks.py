"""Block pairs: all-against-all work cut into pieces that fit a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_blocks(rows: int, row_bytes: int, parallelism: int, block_bytes: int = 32 << 20, least: int = 256) -> int:
    """Blocks so that one holds at most block_bytes, and so many more that all cores have pairs, but not under `least` rows each."""
    for_size = -(-rows * row_bytes // block_bytes)
    for_cores = min(-(-rows // least), max(1, round((2 * parallelism) ** 0.5)))
    return max(1, for_size, for_cores)


def pair_blocks(left: DataFrame, right: DataFrame, key: Column, blocks: int | tuple[int, int], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, half: bool = False) -> DataFrame:
    """run(left block, right block) for every pair of blocks, or for x <= y only if half.

    Rows fall into blocks by key (an integer) modulo blocks, of which each side may have its own
    number; each side is copied once for each block of the other and meets it in one task. Nothing
    is broadcast.
    """
    n, m = (blocks, blocks) if isinstance(blocks, int) else blocks
    x, y = F.pmod(key, F.lit(n)).cast("int"), F.pmod(key, F.lit(m)).cast("int")
    to_right, to_left = F.sequence(F.lit(0), F.lit(m - 1)), F.sequence(F.lit(0), F.lit(n - 1))
    if half:
        to_right, to_left = F.filter(to_right, lambda o: o >= x), F.filter(to_left, lambda o: o <= y)
    left, right = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (left, right))  # a table may meet itself
    a = left.withColumn("_x", x).withColumn("_y", F.explode(to_right))
    b = right.withColumn("_y", y).withColumn("_x", F.explode(to_left))
    return a.groupBy("_x", "_y").cogroup(b.groupBy("_x", "_y")).applyInArrow(run, schema)


def vectors_of(table: pa.Table, column: str, width: int):
    """A column of equally long arrays as a matrix."""
    flat = table.column(column).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
