"""Shared pieces of the training-data operators: cut points in the shared folder, let-bindings, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a folder of our own in local mode (as in tests); on a
    cluster an error, as executors would write to disks that no other one sees."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lumengrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_point = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that ``materialize`` wrote and that no plan will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_point)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken: list[str], name: str) -> str:
    """``name`` with as many underscores in front as no column of ``taken`` has (names are compared without case)."""
    while name.lower() in [c.lower() for c in taken]:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``, which is thus computed once, whatever the optimizer merges."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_sample(df: DataFrame, key: list[str], rows: int, seed: int = 3) -> DataFrame:
    """At most ``rows`` rows, those of the least hashes of ``key`` (ties by the key). A count comes first, and a bound on the
    hash lets only some rows more than that leave the tasks, however many tasks there are."""
    n = df.count()
    h = F.xxhash64(F.lit(seed), *key)
    if n > rows:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int(min(1.0, (1.1 * rows + 6 * rows**0.5) / n) * (1 << 40)))
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), *key).limit(rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for each node of ``edges`` (src, dst: long); a component is named by its smallest node.

    Alternating large-star and small-star rounds: edges never outgrow the input, and a round's result is written to the
    shared folder. Nulls and self-loops are ignored. Ends when a round changes nothing, after O(log^2 n) rounds at worst.
    The center of a large component is a hot key of the first star. Its least neighbour comes from a partial aggregate and
    goes back by a join on a hash of the node, which has a shuffle on both sides, so that adaptive execution can split it.
    """

    def counted(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = materialize(e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), label)
        return out, (seen.get["n"], seen.get["h"])

    e, now = counted(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    before = None
    while now != before and now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.xxhash64("u").alias("k"), F.col("u").alias("w"), "m")
        up = both.where("v > u").withColumn("k", F.xxhash64("u"))
        large = up.join(low, (up["k"] == low["k"]) & (up["u"] == low["w"])).select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        pair = F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(
            F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        )
        last, before = e, now
        e, now = counted(near.select(F.inline(pair)).distinct())
        discard(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
