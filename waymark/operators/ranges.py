"""Places and running sums in groups of any size.

Rows are dealt by ranges of their whole order, so a group that holds most rows is spread over
many tasks. What stands before a range in its group is added up from a row for each group and range.
The dealt rows are a table of the shared folder, so that a task that runs again sees the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import stored, tasks_over


def placed(df: DataFrame, group: list[str], order: list, sums: dict[str, str] | None = None, name: str = "place", rows: int | None = None) -> DataFrame:
    """df with its row's place in its group, from 0, and running sums (its own value included): name -> column.

    Rows that agree in the whole order have places next to each other in any order. Null groups are
    groups; a null value adds nothing. There are as many more ranges as df has rows, which are counted if
    they aren't given, so a range's rows, which one task holds, stay as many.
    """
    sums = sums or {}
    by = [*group, *order]
    ranges = tasks_over(df, rows)
    dealt = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("__range", F.shiftright("__at", 33)))
    totals = dealt.groupBy(*group, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"__of_{n}") for n, c in sums.items()])
    before = W.partitionBy(*[F.col(g) for g in group]).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    # a table, so that its size is known: one of few rows is broadcast, and the dealt rows aren't shuffled for it
    begins = totals.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__range").alias("__of"), (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), *[F.coalesce(F.sum(f"__of_{n}").over(before), F.lit(0)).alias(f"__to_{n}") for n in sums])
    begins = stored(begins)
    near = W.partitionBy("__range", *group).orderBy("__at").rowsBetween(W.unboundedPreceding, 0)
    summed = dealt.repartition(ranges, "__range").withColumns({f"__in_{n}": F.coalesce(F.sum(c).over(near), F.lit(0)) for n, c in sums.items()}) if sums else dealt
    on = summed["__range"] == begins["__of"]
    for g in group:
        on = on & summed[g].eqNullSafe(begins[f"__{g}"])
    whole = summed.join(begins, on)
    return whole.select(*[F.col(c) for c in df.columns], (F.col("__at") + F.col("__shift")).alias(name), *[(F.col(f"__in_{n}") + F.col(f"__to_{n}")).alias(n) for n in sums])
