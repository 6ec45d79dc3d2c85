"""Order-dependent operators without a single-partition window: running sums over a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramsu.session import cut


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each out: value of sums, the sum of value over all rows of the same by up to and
    with this row, in the order of by and order (which must be total for a unique result).

    Rows are range-partitioned by that order; every partition sums its own rows, and adds what the
    partitions before it hold of the same by: a table of a row per partition and by, no more.
    Values must not be null; integers give exact sums however the rows are partitioned. No rows give none.
    """
    keys = [*by, *order]
    placed = cut(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = before.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_pid", *by).agg(*[F.sum(v).alias(o) for o, v in sums.items()])
    offsets = totals.select("_pid", *by, *[F.coalesce(F.sum(o).over(before), F.lit(0)).alias(f"_o_{o}") for o in sums])
    local = placed.withColumns({o: F.sum(v).over(inside) for o, v in sums.items()})
    on = local["_pid"] == offsets["_pid"]
    for c in by:
        on = on & local[c].eqNullSafe(offsets[c])
    return local.join(offsets, on).select(
        *[local[c] for c in df.columns], *[(local[o] + offsets[f"_o_{o}"]).alias(o) for o in sums]
    )
