"""Sinks as DataFrame to DataFrame steps (what the target holds afterwards) and thin writers of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumengrid.operators.numbering import numbered


def upserted(target: DataFrame, batch: DataFrame, key: list[str], order: str, keep_old: list[str] | None = None) -> DataFrame:
    """target with the batch's last row of each key in place of its own; ``keep_old`` columns keep the older value."""
    last = W.partitionBy(*key).orderBy(F.col(order).desc())
    new = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    old = target.select(*key, *[F.col(c).alias(f"_{c}") for c in keep_old or []])
    new = new.join(old, key, "left")
    for c in keep_old or []:
        new = new.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return target.join(new.select(*key), key, "left_anti").unionByName(new)


def inserted_or_ignored(target: DataFrame, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows to append: the batch's first row of each key that the target lacks."""
    first = W.partitionBy(*key).orderBy(order)
    new = batch.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return new.join(target.select(*key), key, "left_anti")


def activated(rows: DataFrame, user: str, order: list) -> DataFrame:
    """Adds is_active: true for the newest row of each user."""
    return rows.withColumn("is_active", F.row_number().over(W.partitionBy(user).orderBy(*order)) == 1)


def next_ids(existing: DataFrame, new: DataFrame, column: str, prefix: str, order: str, width: int = 4, group: int = 4096) -> DataFrame:
    """Adds to ``new`` the ids after the largest numeric suffix in ``existing``, by ``order`` (a column of whole numbers),
    numbered in groups of ``group`` neighbouring values."""
    top = existing.agg(F.coalesce(F.max(F.regexp_extract(column, "([0-9]+)$", 1).try_cast("long")), F.lit(0)).alias("top")).first()["top"]
    rows = numbered(new, [F.floor(F.col(order) / group)], [order], "_number")
    return rows.withColumn(column, F.concat(F.lit(prefix), F.lpad((F.col("_number") + top).cast("string"), width, "0"))).drop("_number")


def canonical_json(columns: list[str]) -> Column:
    """A row as JSON text with sorted keys and blanks after separators; nulls are written, strings keep their letters."""

    def text(c: str):
        quoted = F.regexp_replace(F.to_json(F.struct(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("x"))), '^\\{"x":|\\}$', "")
        return F.concat(F.lit(f'"{c}": '), F.when(F.col(c).isNull(), "null").otherwise(quoted))

    return F.concat(F.lit("{"), F.concat_ws(", ", *[text(c) for c in sorted(columns)]), F.lit("}"))


def write_edges(edges: DataFrame, path: str) -> None:
    """Edge lines in one total order; written by range partitions, so the parts concatenate to that order."""
    order = ["from_term", "to_kind", "to_id", "relation", F.col("weight").desc()]
    edges.repartitionByRange(*order).sortWithinPartitions(*order).select(canonical_json(edges.columns).alias("value")).write.mode("overwrite").text(path)


def refresh(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)
