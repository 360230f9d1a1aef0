"""Dense ids over a whole table without gathering it."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOCAL = 33  # bits that monotonically_increasing_id gives to a row's place in its partition


def dense_ids(rows: DataFrame, order: list[str], start: int, keep: Callable[[DataFrame], DataFrame], column: str = "id") -> tuple[DataFrame, int]:
    """Rows numbered ``start``, ``start`` + 1, ... in ``order``, which must tell all rows apart, and the next number.

    The table is range-partitioned, so a large document is split too.  Each row keeps its place in its partition;
    the partitions are counted and their sums before each (one number per partition) are added.  The same rows get
    the same numbers under any partitioning.
    """
    place = F.monotonically_increasing_id()
    placed = keep(rows.orderBy(*order).withColumn("_place", place))
    part = F.shiftright("_place", _LOCAL)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())
    before = [start, *accumulate((n for _, n in counts), initial=start)][1:]
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part long, _before long")
    local = F.col("_place").bitwiseAND(F.lit((1 << _LOCAL) - 1))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(column, F.col("_before") + local)
    return numbered.drop("_part", "_before", "_place"), before[-1]
