"""MinHash near-duplicates: fast similarity sketches, banding, exact confirmation on full shingle sets.

1. One pass over the texts gives each document its set's size and digest and the band keys of its sketch. A sketch has
   ``bands * rows`` bins. In round i every shingle falls into one hashed bin with a hashed value; a bin keeps the least
   value of the first round that reaches it. Bins that are empty after as many rounds as there are bins take their least
   value over all shingles in one more round each, so every bin fills, and the share of equal bins concentrates around
   the Jaccard similarity. Large sets need few rounds.
2. Rows with equal digests are one class, with a number of its own and the text of its smallest doc_id: copies cost no
   pairs, and rows that repeat a doc_id with other texts are in classes of their own.
3. Classes that share a band key are joined to that key's smallest class (a star, never all pairs), and the components of
   the stars are groups that no link can leave.
4. Each group gets its members' texts and finds every link by exact intersection sizes. A group with more shingles than
   ``block_shingles`` (a member counts for 1000 at least) is dealt out in blocks: first each block by itself, with some
   pivots of the group beside it, which makes most groups one component. In groups that are not, the members outside the
   largest component meet the others, block by block: all others of the group, where that sends each member MOST_COPIES times
   at most on average (a few stray members), else only those of the same band key (a long chain, whose members must not all
   meet). A task holds two blocks at most, and no pair of one key that could add a link is left out.
5. The components of confirmed links, joined back to all documents.

With 40 bands of 8 rows, two sets at similarity 0.85 miss each other with probability 3e-6, at 0.9 with 2e-10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumengrid.llm.common import connected_components, discard, materialize
from lumengrid.llm.wordhash import factors, mix, shingle_sets, whole_texts

#: Members of a group of several blocks that every block sees in the first round.
PIVOTS = 16
#: A group whose members would be sent more often than this, on average, is gone through by band key.
MOST_COPIES = 16
_LOW = np.uint64(0xFFFFFFFF)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fast_sketch(shingles: np.ndarray, bins: int, seeds: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set of 64-bit hashes; ``seeds`` has 2 * bins numbers."""
    out = np.full(bins, _EMPTY)
    step = max(1, min(bins, 2 * bins // len(shingles)))
    for r in range(0, bins, step):
        x = mix(shingles[None, :] ^ seeds[r : min(r + step, bins), None])
        value = (np.arange(r, r + len(x), dtype=np.uint64)[:, None] << np.uint64(32)) | (x & _LOW)
        np.minimum.at(out, (((x >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).ravel().astype(np.intp), value.ravel())
        if out.max() != _EMPTY:
            return out
    for b in np.flatnonzero(out == _EMPTY):
        out[b] = (np.uint64(bins + b) << np.uint64(32)) | (mix(shingles ^ seeds[bins + b]) & _LOW).min()
    return out


def signatures(docs: DataFrame, bands: int, rows: int, shingle: int) -> DataFrame:
    """doc_id, h (a hash of the text), n_shingles, digest (hex of the full set), keys (one long for each band)."""
    bins = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, column = factors(2 * bins, 5), factors(bins, 7).reshape(bands, rows)
        for batch in batches:
            text = batch.column(1)
            for i, data, offsets in whole_texts(text):
                sets = shingle_sets(data, offsets, shingle)
                keys = [
                    mix((mix(fast_sketch(s, bins, seeds)).reshape(bands, rows) * column).sum(axis=1, dtype=np.uint64)).view(np.int64) if len(s) else np.zeros(0, np.int64)
                    for s in sets
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(sets)),
                        batch.column(2).slice(i, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets], pa.string()),
                        pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys), pa.int64())),
                    ],
                    ["doc_id", "h", "n_shingles", "digest", "keys"],
                )

    return _own(docs).mapInArrow(run, "doc_id long, h long, n_shingles long, digest string, keys array<long>")


def _own(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def overlaps(sets: list[np.ndarray], dense_from: int = 16, width: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of sets, exact. Shingles of few sets are counted by pairs, others by products of 0/1 tiles."""
    m = len(sets)
    both = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    counts = np.diff(np.r_[starts, len(value)])
    for f in range(2, dense_from):
        at = starts[counts == f]
        if len(at):
            own = owner[at[:, None] + np.arange(f)]
            for a in range(f):
                for b in range(a + 1, f):
                    both += np.bincount(own[:, a] * m + own[:, b], minlength=m * m).reshape(m, m) if m <= 64 else 0
                    if m > 64:
                        np.add.at(both, (own[:, a], own[:, b]), 1)
    both += both.T
    heavy = np.flatnonzero(counts >= dense_from)
    for i in range(0, len(heavy), width):
        part = heavy[i : i + width]
        rows = owner[np.concatenate([np.arange(starts[h], starts[h] + counts[h]) for h in part])]
        tile = np.zeros((m, len(part)), np.float32)
        tile[rows, np.repeat(np.arange(len(part)), counts[part])] = 1
        both += tile @ tile.T
    return both


def links_within(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning edges (id, smallest id of its component) of the links among these sets."""
    sizes = np.array([len(s) for s in sets], np.float64)
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(max(ids)), int(min(ids)))] if 100 * both >= percent * (sizes.sum() - both) else []
    both = overlaps(sets).astype(np.float64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    left, out = np.ones(len(ids), bool), []
    for root in np.argsort(ids):
        if left[root]:
            left[root], front = False, [root]
            while front:
                new = np.flatnonzero(linked[front].any(axis=0) & left)
                left[new] = False
                out += [(int(ids[k]), int(ids[root])) for k in new]
                front = new.tolist()
    return out


def confirmed(members: DataFrame, percent: int, shingle: int) -> DataFrame:
    """members: cell (string), node, text. Links (src, dst) that span the components of each cell."""
    members = members.repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, sets = None, [], []

        def links():
            found = links_within(np.array(ids), sets, percent) if len(ids) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["src", "dst"])

        for batch in batches:
            names, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, data, offsets in whole_texts(batch.column(2)):
                for k, s in enumerate(shingle_sets(data, offsets, shingle), i):
                    if names[k] != cell:
                        yield from links()
                        cell, ids, sets = names[k], [], []
                    ids.append(keys[k])
                    sets.append(s)
        yield from links()

    return members.mapInArrow(run, "src long, dst long")


def _hot(df: DataFrame, key: str) -> DataFrame:
    """With a hash of ``key`` to join by: both sides of such a join are shuffled for it, so a hot key can be split."""
    return df.withColumn("k", F.xxhash64(key))


def _deal(rows: DataFrame, unit: str, block_shingles: int) -> DataFrame:
    """rows: ``unit``, node, w, label. One row for each unit with several labels: same (the unit), the largest label, how many
    blocks all members and parts the others make, and how many copies of texts their meeting costs."""
    sizes = rows.groupBy(unit, "label").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    by_size = F.struct("w", "label")
    sums = [F.max_by("label", by_size).alias("largest"), F.sum("w").alias("all"), (F.sum("w") - F.max("w")).alias("rest"), F.sum("n").alias("n"), (F.sum("n") - F.max_by("n", by_size)).alias("others")]
    plan = sizes.groupBy(F.col(unit).alias("same")).agg(*sums).where("rest > 0")
    blocks, parts = (F.ceil(F.col(c) / F.lit(block_shingles)).cast("int") for c in ("all", "rest"))
    plan = plan.select("same", "largest", "n", "others", blocks.alias("blocks"), parts.alias("parts"))
    return plan.withColumn("copies", F.col("n") * F.col("parts") + F.col("others") * F.col("blocks"))


def _cells(rows: DataFrame, plan: DataFrame, unit: str) -> DataFrame:
    """(cell, node): each member outside the unit's largest label shares a cell with every other member of the unit."""
    a, b = _hot(rows, unit), _hot(plan, "same")
    met = a.join(b, (a["k"] == b["k"]) & (a[unit] == b["same"]))
    part = F.when(F.col("label") != F.col("largest"), F.pmod(F.xxhash64(F.lit(1), "node"), "parts"))
    met = met.select(F.concat(F.lit(unit), F.col(unit).cast("string")).alias("u"), "node", "parts", "blocks", part.alias("part"), F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    here = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.concat_ws(":", "u", i, "block"))
    there = F.when(F.col("part").isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.concat_ws(":", "u", "part", j)))
    return met.select(F.explode(F.array_union(here, there)).alias("cell"), "node")


def _apart(large: DataFrame, keys: DataFrame, links: DataFrame, block_shingles: int) -> DataFrame:
    """(cell, node): what the first round left open in groups of several blocks (large: node, component, w). Members outside
    the largest component of their group share a cell with every other member; in groups where that is too many copies,
    only with those of the same band key, in keys whose members are in several components (keys with the same members count
    once). A group that is one component by now gives none."""
    found = connected_components(links, "dedup-first").withColumnsRenamed({"component": "label"})
    labelled = materialize(large.join(found, "node", "left").select("node", "component", "w", F.coalesce("label", "node").alias("label")), "dedup-labels")
    groups = materialize(_deal(labelled, "component", block_shingles), "dedup-open")
    many = F.col("copies") > MOST_COPIES * F.col("n")
    cells = _cells(labelled, groups.where(~many), "component")
    if not groups.where(many).limit(1).count():
        return cells
    a, b = _hot(labelled, "component"), _hot(groups.where(many).select("same"), "same")
    chains = a.join(b, (a["k"] == b["k"]) & (a["component"] == b["same"])).select("node", "w", "label")
    inside = materialize(keys.join(chains, "node"), "dedup-chains")
    several = inside.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.count("*").alias("n")).where("lo <> hi")
    once = several.groupBy("who", "n").agg(F.min("key").alias("same")).select("same")
    return cells.unionByName(_cells(inside, _deal(inside, "key", block_shingles).join(once, "same"), "key"))


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = 5, bands: int = 40, rows: int = 8, block_shingles: int = 250_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash: one row for each row of ``docs`` (doc_id, text; other columns are
    ignored). (doc_id, text_hash) tells rows apart that repeat a doc_id with other texts; text_hash is xxhash64 of the text.

    Links hold between sets with 100 * intersection >= percent * union; ``component_id`` is the smallest doc_id reachable.
    Null or wordless texts: an empty set, linked with nothing. Rows that repeat a doc_id are documents of their own: each
    gets a row and the component of its own text. A null doc_id takes part in no link: component_id null, kept true. An
    empty table gives an empty result.
    """
    sig = materialize(signatures(docs, bands, rows, shingle), "dedup-signatures")
    known = sig.where("digest is not null and doc_id is not null")
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    # a class's number is fixed when it is written, and no two are alike
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("least.doc_id").alias("rep"), F.col("least.h").alias("h"), "n", "keys"), "dedup-classes")
    keys = classes.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select(F.col("key").alias("same"), "pivot")
    a, b = _hot(keys, "key"), _hot(shared, "same")
    stars = a.join(b, (a["k"] == b["k"]) & (a["key"] == b["same"])).where("node <> pivot").select(F.col("node").alias("src"), F.col("pivot").alias("dst"))
    groups = materialize(connected_components(stars, "dedup-groups"), "dedup-groups")
    weighed = groups.join(classes.select("node", "rep", "h", F.greatest("n", F.lit(1000)).alias("w")), "node")
    pivots = F.array_distinct(F.array("component", *[F.min_by("node", F.xxhash64(F.lit(i), "node")) for i in range(PIVOTS)]))
    total = weighed.groupBy("component").agg(F.ceil(F.sum("w") / F.lit(block_shingles)).cast("int").alias("blocks"), pivots.alias("pivots")).withColumnRenamed("component", "same")
    a, b = _hot(weighed, "component"), _hot(total, "same")
    dealt = a.join(b, (a["k"] == b["k"]) & (a["component"] == b["same"])).select("node", "rep", "h", "component", "w", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.array_contains("pivots", F.col("node")).alias("pivot"))
    members = _own(docs).withColumnRenamed("doc_id", "rep").join(dealt, ["rep", "h"]).drop("rep", "h")
    if known.groupBy("doc_id", "h").count().where("count > 1").limit(1).count():
        members = members.dropDuplicates(["node"])  # rows that repeat as they are
    members = materialize(members, "dedup-members")
    blocks = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    cells = members.select(F.explode(blocks).alias("j"), "component", "node", "text").select(F.concat_ws(":", "component", "j").alias("cell"), "node", "text")
    links = materialize(confirmed(cells, percent, shingle), "dedup-links")
    large = members.where("blocks > 1")
    if large.limit(1).count():
        open_cells = _apart(large.select("node", "component", "w"), keys, links, block_shingles).join(large.select("node", "text"), "node").select("cell", "node", "text")
        links = links.unionByName(materialize(confirmed(open_cells, percent, shingle), "dedup-links"))
    discard(members, groups)
    found = materialize(connected_components(links, "dedup-found"), "dedup-found")
    low = found.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("root")).withColumnRenamed("component", "same")
    a, b = _hot(found, "component"), _hot(low, "same")
    rooted = a.join(b, (a["k"] == b["k"]) & (a["component"] == b["same"])).select("node", "root")
    named = classes.join(rooted, "node", "left").select("digest", F.coalesce("root", "rep").alias("root"))
    out = sig.select("doc_id", "n_shingles", "digest", "h").join(named, "digest", "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(root == F.col("doc_id"), F.lit(True)).alias("kept"), F.col("h").alias("text_hash"))
