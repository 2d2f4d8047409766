"""Row numbers over a whole table in one order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(rows: DataFrame, coarse: list[Column], order: list, name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... in the order of ``coarse`` (ascending), then ``order``.

    ``coarse`` are expressions that the wanted order agrees with and that cut the rows into groups small enough to sort (such
    as a key divided by some thousands). Rows are counted by group, the counts are summed up over the groups (a table smaller
    by the size of a group), and rows are numbered within their group.
    """
    keys = [f"_g{k}" for k in range(len(coarse))]
    marked = rows.withColumns(dict(zip(keys, coarse, strict=True)))
    counts = marked.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    same = [marked[k].eqNullSafe(before[k]) for k in keys]
    joined = marked.join(before, same).drop(*[before[k] for k in keys])
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return joined.withColumn(name, inside + F.col("_before")).drop(*keys, "_before")
