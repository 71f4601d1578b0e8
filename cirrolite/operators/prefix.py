"""Running sums over a whole table in one order, without a window over all of it.

Rows are dealt by ranges of the order and written once, so that a row's slice is fixed. Each slice's totals are a small aggregate; what lies before a slice is the sum of the totals before it,
at most `slices` rows on the driver. Within its slice a row's sum is an ordinary window. So no task holds more than a slice, and two passes do.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import written


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, Column], slices: int = 64) -> DataFrame:
    """Adds the sum of each of `sums` (name -> whole number, nulls are 0) over all rows up to this one, itself included. `order` must be unique; nulls come first."""
    made = rows.withColumns({f"_{k}": F.coalesce(c.cast("bigint"), F.lit(0)) for k, c in sums.items()})
    made = written(made.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("_slice", F.spark_partition_id()))
    totals = sorted(made.groupBy("_slice").agg(*[F.sum(f"_{k}").alias(k) for k in sums]).collect())
    before = {k: [0, *accumulate(t[k] for t in totals)] for k in sums}
    starts = [(t["_slice"], *[before[k][n] for k in sums]) for n, t in enumerate(totals)]
    starts = rows.sparkSession.createDataFrame(starts, "_slice int, " + ", ".join(f"_{k}_before bigint" for k in sums))
    by = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = made.join(F.broadcast(starts), "_slice")  # at most `slices` rows
    return out.select(*rows.columns, *[(F.sum(f"_{k}").over(by) + F.col(f"_{k}_before")).alias(k) for k in sums])


def positions(rows: DataFrame, order: list[str], name: str = "position", slices: int = 64) -> DataFrame:
    """Adds each row's place in the order, from 1."""
    return running_sums(rows, order, {name: F.lit(1)}, slices)
