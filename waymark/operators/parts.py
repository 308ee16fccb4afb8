"""Parts that begin anew at a limit, in groups of any size.

Where a part ends hangs on where it began, which is a loop over a group's rows. It isn't run as one.
All rows stand in one order, group by group, and the end of a part from any row on is found for all rows at
once: its limit's place among the running sums, or the end of its group, where the next part begins
anyway. Groups that lie in one range of this order, which small ones nearly all do, are done by one pass over
the range; the pointers are for groups that go on in the next one. Blocks of BLOCK consecutive rows follow these pointers by themselves, from every row to the
first part that begins behind the block; of those entries, which are few, the ones that the first
row leads to are found by doubling the length of the steps. So no task holds more than a block, whether
there is one group or a group for each row, and the rounds are as many as the logarithm of the blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .lineage import dropped, stored, tasks_over
from .ranges import placed

#: Rows that one call works on.
BLOCK = 1 << 16


def _followed(next_: np.ndarray, base: int) -> np.ndarray:
    """For each row of a block that begins at base: where the first part behind the block begins, if one begins with this row."""
    out = next_.copy()
    end = base + len(next_)
    for i in range(len(next_) - 1, -1, -1):
        if out[i] < end:
            out[i] = out[out[i] - base]
    return out


def _walked(next_: np.ndarray, base: int, entry: int) -> np.ndarray:
    """How many parts begin in a block up to each row, if the first one begins at entry."""
    begins = np.zeros(len(next_), np.int64)
    at, end = entry, base + len(next_)
    while at < end:
        begins[at - base] = 1
        at = next_[at - base]
    return begins.cumsum()


def accumulated_parts(df: DataFrame, group: str, order: list[str], size: str, most_rows: int, most_bytes: int, block: int = BLOCK) -> DataFrame:
    """df with part, from 1: a new one begins when the next row would pass either limit.

    Sizes are whole numbers of 0 or more, a null counts as 0; a row above the limit is a part of its
    own. Rows that agree in the whole order may stand in any order. A null group is a group.
    """
    if most_rows < 1 or most_bytes < 0:
        raise ValueError("a part holds a row at least")
    at = {c: f"c{k}" for k, c in enumerate(df.columns)}
    key = F.unhex(F.md5(F.to_json(F.struct(F.col(group).alias("g"))).cast("binary")))
    rows = df.select(key.alias("g"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), *[F.col(c).alias(n) for c, n in at.items()])
    by = ["g", *[at[c] for c in order]]
    in_order = rows.repartitionByRange(tasks_over(df), *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())

    def counted(batches):
        last, part, n, total = None, 0, 0, 0
        for batch in batches:
            found = []
            for g, more in zip(batch.column("g").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if g != last:
                    last, part, n, total = g, 1, 1, more
                elif n == most_rows or total + more > most_bytes:
                    part, n, total = part + 1, 1, more
                else:
                    n, total = n + 1, total + more
                found.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "part"])

    # right for all groups that don't go on from one range to the next
    dealt = stored(in_order.mapInArrow(counted, StructType([*in_order.schema.fields, StructField("part", IntegerType())])))
    edges = dealt.groupBy(F.shiftright("at", 33).alias("range")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    edges = edges.select("range", F.explode(F.array("first", "last")).alias("at"))
    crossing = stored(dealt.select("at", "g").join(F.broadcast(edges), "at").groupBy("g").agg(F.count_distinct("range").alias("n")).filter("n > 1").select("g"))
    named = [F.col(n).alias(c) for c, n in at.items()]
    if crossing.isEmpty():
        dropped(crossing)
        return dealt.select(*named, "part")
    # a row or two for each range
    over = F.broadcast(crossing)
    crossed = _by_pointers(dealt.join(over, "g", "left_semi").drop("at", "part"), by, most_rows, most_bytes, block)
    return dealt.join(over, "g", "left_anti").select(*named, "part").union(crossed.select(*named, "part"))


def _by_pointers(rows: DataFrame, order: list[str], most_rows: int, most_bytes: int, block: int) -> DataFrame:
    """rows (g, size and others) with part, whatever the size of their groups, of which there are few."""
    columns, n_rows = rows.columns, rows.count()
    tasks = tasks_over(rows, n_rows)
    rows = stored(placed(rows, [], order, {"total": "size"}, rows=n_rows))
    spans = stored(rows.groupBy("g").agg(F.min("place").alias("start"), (F.max("place") + 1).alias("end")))
    slim = rows.select("g", "place", "size", "total")
    # how many rows' sums fit under a row's limit: its place among the sums, less the limits before it
    sums = slim.select(F.col("total").alias("value"), F.lit(0).alias("kind"), "place", F.lit(None).cast("binary").alias("g"))
    limits = slim.select((F.col("total") - F.col("size") + most_bytes).alias("value"), F.lit(1).alias("kind"), "place", "g")
    among = placed(sums.union(limits), [], ["value", "kind", "place"], name="among", rows=2 * n_rows).filter("kind = 1").join(F.broadcast(spans), "g")
    next_ = F.greatest(F.col("place") + 1, F.least(F.col("place") + most_rows, F.col("among") - F.col("place"), "end"))
    ends = stored(among.select("g", "place", next_.alias("next"), F.floor(F.col("place") / block).alias("block")))

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        return part.assign(exit=_followed(part["next"].to_numpy(), int(part["place"].iloc[0])))[["place", "exit"]]

    exits = stored(ends.select("place", "next", "block").repartition(tasks, "block").groupBy("block").applyInPandas(follow, "place long, exit long"))
    # steps between places that some row leads to; the first place is one, and the last part leads nowhere
    inside = exits.filter(F.col("exit") < n_rows)
    first = rows.sparkSession.range(1).select(F.col("id").alias("place"))
    entries = stored(inside.select(F.col("exit").alias("place")).union(first).distinct())
    steps = stored(inside.join(entries, "place", "left_semi"))
    found = stored(first)
    while not steps.isEmpty():
        ahead = found.join(steps, "place").select(F.col("exit").alias("place"))
        more = stored(found.union(ahead).distinct())
        far = steps.select(F.col("place").alias("exit"), F.col("exit").alias("far"))
        twice = stored(steps.join(far, "exit").select("place", F.col("far").alias("exit")))
        dropped(found, steps)
        found, steps = more, twice
    entered = found.select(F.floor(F.col("place") / block).alias("block"), F.col("place").alias("entry"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        base, entry = int(part["place"].iloc[0]), part["entry"].iloc[0]
        begun = np.zeros(len(part), np.int64) if pd.isna(entry) else _walked(part["next"].to_numpy(), base, int(entry))
        return part.assign(begun=begun)[["g", "block", "place", "begun"]]

    local = stored(ends.join(stored(entered), "block", "left").repartition(tasks, "block").groupBy("block").applyInPandas(walk, "g binary, block long, place long, begun long"))
    before = placed(local.groupBy("block").agg(F.max("begun").alias("here")), [], ["block"], {"so_far": "here"}).select("block", (F.col("so_far") - F.col("here")).alias("before"))
    numbered = stored(local.join(F.broadcast(before), "block").select("g", "place", (F.col("before") + F.col("begun")).alias("all")))
    ahead = numbered.join(spans.select(F.col("start").alias("place")), "place", "left_semi").select("g", (F.col("all") - 1).alias("ahead"))
    own = numbered.join(F.broadcast(ahead), "g").select("place", (F.col("all") - F.col("ahead")).cast("int").alias("part"))
    out = stored(rows.repartition(tasks, "place").join(own.repartition(tasks, "place"), "place").select(*columns, "part"))
    dropped(rows, spans, ends, exits, entries, found, steps, local, numbered)
    return out
