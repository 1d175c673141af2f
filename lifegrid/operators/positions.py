"""Places in a global order: row numbers, representatives, even subsamples and equal chunks.

Rows go to ranges of their order; each range counts its rows and a running sum over the few counts gives each its base.
So no task sorts a whole group, however many of the rows it has.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import UserInputError
from ..scratch import written


def numbered(df: DataFrame, groups: list[str], order: list[Column], position: str = "position", size: str = "size") -> DataFrame:
    """df plus each row's position in its group from 0 and the group's size. The order should be total; rows that it doesn't tell apart
    are numbered in some order. Nulls come first and are a group of their own."""
    keys = [f"_k{i}" for i in range(len(groups))]
    marks = [f"_o{i}" for i in range(len(order))]
    x = df.select("*", *[F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys, strict=True)], *[o.alias(m) for o, m in zip(order, marks, strict=True)])
    ranges = written(x.repartitionByRange(*keys, *marks).sortWithinPartitions(*keys, *marks).withColumn("_m", F.monotonically_increasing_id()).drop(*marks))
    rows = ranges.withColumn("_part", F.shiftright("_m", 33))
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))  # a row a range
    runs = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    runs = runs.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_part").alias("_part_"), (F.sum("_n").over(window.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_base"), F.sum("_n").over(window).alias(size))
    same = F.col("_part") == F.col("_part_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return rows.join(runs, same).withColumn(position, F.col("_m") + F.col("_base")).drop("_m", "_part", "_part_", "_base", *keys, *[f"{k}_" for k in keys])


def representatives(df: DataFrame, score: str, groups: list[str] = ()) -> DataFrame:
    """The rows of the least, the middle (position n // 2) and the greatest score of each group, with a column ``representative`` of low, median
    or high; ties by _row_id. A group of one row has it three times. Rows without a score are left out."""
    x = numbered(df.filter(F.col(f"`{score}`").isNotNull()), list(groups), [F.col(f"`{score}`"), F.col("_row_id")], "_p", "_s")
    chosen = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), p.alias("p")) for n, p in (("low", F.lit(0)), ("median", F.floor(F.col("_s") / 2)), ("high", F.col("_s") - 1))]), lambda c: c["p"] == F.col("_p"))
    return x.withColumn("_c", F.explode(chosen)).withColumn("representative", F.col("_c")["n"]).drop("_p", "_s", "_c")


def even_subsample(df: DataFrame, score: str, rows: int) -> DataFrame:
    """At most so many rows, evenly spaced along the score (ties by _row_id): the positions round(linspace(0, n - 1, rows))."""
    if rows < 1:
        raise UserInputError("at least one row")
    x = numbered(df, [], [F.col(f"`{score}`"), F.col("_row_id")], "_p", "_s")
    n = df.count()
    if n <= rows:
        return x.drop("_p", "_s")
    wanted = df.sparkSession.createDataFrame([(int(p),) for p in sorted(set(np.round(np.linspace(0, n - 1, rows)).astype(int).tolist()))], "_p long")
    return x.join(F.broadcast(wanted), "_p").drop("_p", "_s")  # as many rows as asked for


def equal_chunks(df: DataFrame, score: str, chunks: int, name: str = "chunk") -> DataFrame:
    """df plus its chunk along the score (ties by _row_id): chunks of n // chunks rows, what is left over in the last one."""
    if chunks < 1:
        raise UserInputError("at least one chunk")
    x = numbered(df, [], [F.col(f"`{score}`"), F.col("_row_id")], "_p", "_s")
    width = F.greatest(F.lit(1), F.floor(F.col("_s") / chunks))
    return x.withColumn(name, F.least(F.floor(F.col("_p") / width), F.lit(chunks - 1)).cast("int")).drop("_p", "_s")
