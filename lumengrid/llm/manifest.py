"""A Merkle manifest of a table: a digest for each row, a tree for each part, a root, and a proof for each row.

Rows become leaves, and each part (a source, say) orders its leaves. Ranks are written in digits to the base of the tree's
fan, and a block is ``fan ** depth`` consecutive ranks. Within a block the digits are grouped away one after the other: a
group's children become a list of structs inside their parent, whose digest is made from theirs, until one nested struct a
block is left. All these groupings follow one shuffle by (part, block). The digests of blocks are leaves of a smaller
table that is rolled up in the same way, until each part has one block; the parts' roots are once more leaves, of the tree
over all parts. On the way down, a block's struct is walked by nested transforms that carry the path (what stands left and
right at each level), and explode emits its leaves. A block meets the path above it by grouping: a union of blocks and
paths, one row each, by (part, block). No proof needs a join, and no row holds more than a block.

Every level is a written table, so a lost executor costs its own tasks. Ranks come from a range sort: numbers within a
task, plus what earlier tasks hold of the same part, known from one summary row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import discard, materialize

PATH = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """Lower-case hex sha256 of the values, one after the other; strings count as UTF-8."""
    return F.sha2(F.concat(*values), 256)


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field is ``-`` if null, else its UTF-8 byte count, ``:`` and the value. No null results."""

    def said(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*(said(f) for f in fields))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, leaf, lambda x, s: digest(s["left"], x, s["right"]))


def siblings_digest(path: Column) -> Column:
    """The digest of all siblings' digests, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, part first. Adds the number of a row among its task's rows of that part, whether the part is the task's
    first one, and the task."""
    last, count, first, task = None, 0, True, TaskContext.get().partitionId()
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        now = b.column(0)
        before = pa.concat_arrays([pa.array([last], now.type), now.slice(0, n - 1)])
        same = pc.or_(pc.fill_null(pc.equal(now, before), False), pc.and_(pc.is_null(now), pc.is_null(before))).to_numpy(zero_copy_only=False)
        same[0] |= first and not count  # the first row of all starts the first part, whatever it is
        at = np.arange(n)
        turn = np.maximum.accumulate(np.where(same, -1, at))
        local = np.where(turn < 0, count + at, at - turn)
        in_first = first & (turn < 0)
        last, count, first = now[n - 1].as_py(), int(local[-1]) + 1, bool(in_first[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local), pa.array(in_first), pa.array(np.full(n, task, np.int32))], [*b.schema.names, "local", "in_first", "task"])


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """rank, part, digest, item: ``rows`` (part, digest, item and what ``order`` names) numbered from 0 within their part.

    ``rows`` is a written table. ``order`` ascends, nulls first; give it a column that tells equal rows apart, or else many
    equal rows go to one task. Rows are sorted by range, so a part of any size is spread over tasks; the driver sees one
    row a task.
    """
    by = ["part", *order]
    kept = rows.select("part", "digest", "item", *(c for c in order if c not in ("digest", "item")))
    cut = materialize(
        kept.repartitionByRange(*by).sortWithinPartitions(*by).select("part", "digest", "item").mapInArrow(_numbered, f"part string, digest string, item {kept.schema['item'].dataType.simpleString()}, local long, in_first boolean, task int"), label
    )
    ends = cut.groupBy("task").agg(
        F.count_if("in_first").alias("first"),
        F.count("*").alias("n"),
        F.first(F.when(F.col("in_first"), F.struct("part")), ignorenulls=True).alias("a"),
        F.max(F.when(~F.col("in_first"), F.struct("part", "local"))).alias("z"),
    )
    before, last, held = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["task"]):
        before.append((r["task"], held if last == (r["a"]["part"],) else 0))
        if r["z"] is None:
            last, held = (r["a"]["part"],), before[-1][1] + r["first"]
        else:
            last, held = (r["z"]["part"],), r["z"]["local"] + 1
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "task int, before long"))  # one row a task
    rank = F.col("local") + F.when(F.col("in_first"), F.col("before")).otherwise(0)
    out = cut.join(offsets, "task").select(rank.alias("rank"), "part", "digest", "item")
    out._cut_point = cut._cut_point
    return out


def rolled_up(nodes: DataFrame, depth: int, fan: int) -> DataFrame:
    """part, block, node: rank, part, digest, item rolled up to one nested struct for each ``fan ** depth`` ranks.

    A node is (digest, alone, kids), a leaf (digest, item). While a part has several nodes, each run of ``fan`` of them makes
    one of the next level; a part that is down to one node keeps it: ``alone``, its digest is its only child's.
    """
    digits = [F.pmod(F.floor(F.col("rank") / fan**j), F.lit(fan)).cast("int").alias(f"d{j}") for j in range(depth)]
    keys = ["part", "block", *(f"d{j}" for j in reversed(range(depth)))]
    block = F.floor(F.col("rank") / fan**depth).alias("block")
    rows = nodes.select("part", block, *digits, F.struct("digest", "item").alias("node")).repartition("part", "block")
    for j in range(depth):
        digit = keys.pop()
        first = F.col("block") == 0
        for key in keys[2:]:
            first &= F.col(key) == 0
        kids = F.transform(F.array_sort(F.collect_list(F.struct(digit, "node"))), lambda x: x["node"])
        rows = rows.groupBy(*keys).agg(kids.alias("kids"))
        alone = first & (F.size("kids") == 1)
        top = F.when(alone, F.col("kids")[0]["digest"]).otherwise(F.sha2(F.array_join(F.col("kids")["digest"], ""), 256))
        rows = rows.select(*keys, F.struct(top.alias("digest"), alone.alias("alone"), "kids").alias("node"))
    return rows


def walked(node: Column, path: Column, depth: int, fan: int) -> Column:
    """The leaves below a node: array of (item, digest, path)."""
    if not depth:
        return F.array(F.struct(node["item"].alias("item"), node["digest"].alias("digest"), path.alias("path")))

    def below(kid: Column, i: Column) -> Column:
        left = F.array_join(F.slice(node["kids"]["digest"], F.lit(1), i), "")
        right = F.array_join(F.slice(node["kids"]["digest"], i + 2, F.lit(fan)), "")
        step = F.when(node["alone"], F.array().cast(PATH)).otherwise(F.array(F.struct(left.alias("left"), right.alias("right"))))
        return walked(kid, F.concat(step, path), depth - 1, fan)

    return F.flatten(F.transform(node["kids"], below))


def _levels(nodes: DataFrame, depth: int, fan: int, label: str) -> list[DataFrame]:
    """Written tables (part, block, node), each the blocks of the one before, until every part has one block."""
    levels = [materialize(rolled_up(nodes, depth, fan), label)]
    while levels[-1].agg(F.max("block")).first()[0]:
        up = levels[-1].select(F.col("block").alias("rank"), "part", F.col("node.digest").alias("digest"), F.col("block").alias("item"))
        levels.append(materialize(rolled_up(up, depth, fan), label))
    return levels


def manifest(rows: DataFrame, part: str, order: str, fields: list[Column], carry: list[Column], fan: int = 3, depth: int = 6) -> DataFrame:
    """The ``carry`` columns of each row, with its leaf, path, subroot and root.

    A leaf is the digest of ``fields`` (``leaf``). Per ``part`` (null is a part), leaves ascend by ``order`` (null first; ties
    by the leaf, so equal rows share a leaf and each has a path of its own); every ``fan`` consecutive nodes, a last run
    may be shorter, become their digest until one is left, the subroot. Subroots ascend by part (null first, bytewise) and
    lead to the root in the same way. ``path``: array of (left, right), the siblings' digests of each level, from the leaf up;
    ``folded`` leads from a leaf to the root. Whole texts are hashed where they lie, only digests move; nulls and empty
    texts differ in their leaves. A part of one row is its own subroot. An empty table gives no rows. Columns that are not
    named take no part, whatever they are called.
    """
    # random numbers, once written, let many equal rows be sorted by several tasks
    first = rows.select(F.col(part).cast("string").alias("part"), leaf(*fields).alias("digest"), F.struct(*carry).alias("item"), F.col(order).alias("by"), F.xxhash64(F.monotonically_increasing_id()).alias("spread"))
    leaves = materialize(first, "leaves")
    in_order = ranked(leaves, ["by", "digest", "spread"], "ranked")
    levels = _levels(in_order, depth, fan, "blocks")
    discard(leaves, in_order)
    subroots = materialize(levels[-1].select(F.lit("").alias("part"), F.col("node.digest").alias("digest"), F.struct(F.col("part").isNotNull().alias("named"), "part").alias("item")), "subroots")
    sources = ranked(subroots, ["item"], "sources")
    over = _levels(sources, depth, fan, "roots")
    discard(subroots, sources)

    def met(blocks: DataFrame, above: DataFrame) -> DataFrame:
        """Leaves of blocks, with the paths from there to the root. Both have one row for each part and block."""
        empty = {c: F.lit(None).cast(t) for c, t in above.dtypes if c not in ("part", "block")}
        both = blocks.withColumns(empty).unionByName(above.withColumn("node", F.lit(None).cast(blocks.schema["node"].dataType)))
        one = both.groupBy("part", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("node", *empty)))
        return one.select("part", *(c for c in empty if c != "path"), F.inline(walked(F.col("node"), F.col("path"), depth, fan)))

    path = F.array().cast(PATH).alias("path")
    above = over[-1].select("part", "block", path, F.col("node.digest").alias("root"))
    for blocks in reversed(over[1:]):
        above = met(blocks, above).select("part", F.col("item").alias("block"), "path", "root")
    above = met(over[0], above).select(F.col("item.part").alias("part"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root")
    for blocks in reversed(levels[1:]):
        above = met(blocks, above).select("part", F.col("item").alias("block"), "path", "subroot", "root")
    return met(levels[0], above).select("item.*", F.col("digest").alias("leaf"), "path", "subroot", "root")
