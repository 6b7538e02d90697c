"""Merkle manifest of a table, with octopus multiproofs.

Every row is a leaf, every group of rows (one language) a binary tree over its
leaves in the order of their ids, and the subroots of the groups, in the order
of the group names, are the leaves of one more tree, whose root stands for the
table.  A last node without a partner is hashed alone.

1. The leaves are hashed natively, range-partitioned by (group, id) and cut into
   leaf partitions: runs of at most ``width`` consecutive leaves of a group.
   Row counts of the partitions give every run its place in its tree.
2. A run hashes the nodes that lie inside it and writes its first and last one
   of each level.  The nodes that span several runs follow from those in rounds
   of ``HEIGHT`` levels: each task holds the nodes of one aligned subtree, at
   most 2^(HEIGHT + 1), never those of a whole tree.
3. A run lists the minimal union of the node coordinates that the proofs of all
   its leaves need and that it can't derive: the octopus.  One join fetches
   them for all runs (levels of few nodes by broadcast, so that a node asked for
   by half of all runs is no hot key), the run derives the interior nodes its
   leaves share and expands the proof of each leaf locally.

A proof is an array with one entry per level: ``L`` or ``R`` (the side on which
the sibling stands) and the sibling's digest, or an empty entry for a node
hashed alone.  :func:`fold` recomputes a root from it with native functions.

Nulls: a null field counts as ``-``; a null group comes first and is a tree of
its own; a null id comes first in its group.  Rows of one id stand in the order
of their leaf digests; whole repeated rows have equal leaves, in any order.
Empty and very long texts are hashed whole.  An empty table has no leaves and
no root.  Further columns of the table are not read.
"""

from __future__ import annotations

import functools
import hashlib
import operator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .cluster import cut, ready, small

WIDTH = 256     # leaves of a run
HEIGHT = 10     # levels that one round adds
TOP_NODES = 10_000  # the uppermost levels with so many nodes in all are fetched by broadcast
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """Hex digest of the values, each as ``-`` (null) or its UTF-8 byte count, ``:`` and itself."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's hex digest and a proof lead to."""
    def up(acc, s):
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(s.startswith("L"), F.concat(other, acc)).when(s.startswith("R"), F.concat(acc, other)).otherwise(acc), 256)
    return F.aggregate(proof, leaf, up)


def siblings(proof: Column) -> Column:
    """The digests of a proof, level by level, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), "")


# ---- trees by coordinates (level, index); a level of n leaves has ceil(n / 2^level) nodes ----

def height(n: int) -> int:
    return max(n - 1, 0).bit_length()


def count(n: int, level: int) -> int:
    return -(-n >> level)


def parent(left: bytes, right: bytes | None) -> bytes:
    return hashlib.sha256((left.hex() + (right.hex() if right is not None else "")).encode()).digest()


def inside(digests: list[bytes], a: int, n: int) -> dict[tuple[int, int], bytes]:
    """All nodes of a tree of ``n`` leaves that lie over the leaves a, a + 1, ... alone."""
    nodes, row, lo = {}, digests, a
    for level in range(height(n) + 1):
        nodes.update(((level, lo + k), d) for k, d in enumerate(row))
        skip = lo & 1  # its left partner stands in another run
        last = lo + len(row) == count(n, level)  # then a node without partner is hashed alone
        row = [parent(row[k], row[k + 1] if k + 1 < len(row) else None) for k in range(skip, len(row), 2) if k + 1 < len(row) or last]
        lo = (lo + 1) // 2
        if not row:
            break
    return nodes


def missing(a: int, b: int, n: int) -> list[tuple[int, int]]:
    """The octopus of the leaves a .. b - 1: the fewest coordinates that their proofs
    need beyond these leaves.  A node is asked for only if neither the leaves nor
    nodes asked for below it give it."""
    out = []
    for level in range(height(n)):
        if a & 1:
            out.append((level, a - 1))
        if (b - 1) % 2 == 0 and b < count(n, level):
            out.append((level, b))
        a, b = a >> 1, (b + 1) >> 1
    return out


def _runs(names: list[str], width: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        held, n_held, tree, start = [], 0, None, 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            cols = [pa.array([part], pa.int64()), pa.array([tree]), pa.array([start], pa.int64()), pa.array([len(rows)], pa.int64())]
            for name in names:
                c = rows.column(name)
                c = c.chunk(0) if c.num_chunks else pa.array([], c.type)
                cols.append(pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), c))
            return pa.RecordBatch.from_arrays(cols, ["part", "tree", "start", "size", *names])

        for batch in batches:
            trees, i = batch.column(0).to_pylist(), 0
            while i < len(trees):
                if n_held and (trees[i] != tree or n_held == width):
                    yield flush()
                    start = start + n_held if trees[i] == tree else 0
                    held, n_held = [], 0
                elif trees[i] != tree:
                    start = 0
                tree, j = trees[i], i
                while j < len(trees) and trees[j] == tree and j - i < width - n_held:
                    j += 1
                held.append(batch.slice(i, j - i))
                n_held += j - i
                i = j
        if n_held:
            yield flush()
    return run


_NODE = "tree string, level int, idx long, digest binary"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


_NODE_COLS = (["tree", "level", "idx", "digest"], [pa.string(), pa.int32(), pa.int64(), pa.binary()])


def _borders(batches):
    """First and last inner node of each level of every run (tree, a, n, digests)."""
    for batch in batches:
        out = []
        for tree, a, n, digests in zip(*(c.to_pylist() for c in batch.columns)):
            ends: dict[int, list[int]] = {}
            nodes = inside(digests, a, n)
            for level, idx in nodes:
                e = ends.setdefault(level, [idx, idx])
                e[1] = idx
            out += [(tree, level, idx, nodes[level, idx]) for level, e in ends.items() for idx in sorted(set(e))]
        yield _batch(out, *_NODE_COLS)


def _upper(base: int):
    """New nodes of the levels above ``base`` in each aligned subtree; rows
    (tree, key, level, idx, n, digest) come in the order of (tree, key)."""
    def close(tree, n, known):
        out = []
        for level in range(base, min(base + HEIGHT, height(n))):
            for (lv, idx), d in sorted(known.items()):
                if lv != level or idx & 1 or (level + 1, idx >> 1) in known:
                    continue
                lone = idx + 1 == count(n, level)
                right = None if lone else known.get((level, idx + 1))
                if lone or right is not None:
                    known[level + 1, idx >> 1] = new = parent(d, right)
                    out.append((tree, level + 1, idx >> 1, new))
        return out

    def run(batches):
        group, n, known = None, 0, {}
        for batch in batches:
            out = []
            for tree, key, level, idx, size, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree, key) != group:
                    if group:
                        out += close(group[0], n, known)
                    group, n, known = (tree, key), size, {}
                known[level, idx] = digest
            yield _batch(out, *_NODE_COLS)
        if group:
            yield _batch(close(group[0], n, known), *_NODE_COLS)
    return run


@dataclass
class Forest:
    """Trees over the leaves of each group: written tables, no driver-side nodes."""
    runs: DataFrame   # part, tree, start, size, at (place of the first leaf), n (leaves of the tree), digest[], further lists
    nodes: DataFrame  # tree, level, idx, digest: the nodes at the borders of runs, and all nodes that span runs
    roots: DataFrame  # tree, digest, n


def forest(leaves: DataFrame, key: str, width: int = WIDTH) -> Forest:
    """Trees over ``leaves(tree, <key>, digest, ...)``: a tree's leaves in the order of key and digest."""
    ready(leaves)
    names = [c for c in leaves.columns if c != "tree"]
    leaves = cut(leaves.select("tree", *names).withColumn("salt", F.monotonically_increasing_id()))
    order = ["tree", key, "digest", "salt"]
    lists = ", ".join(f"`{n}` array<{leaves.schema[n].dataType.simpleString()}>" for n in names)
    runs = cut(leaves.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", *names)
               .mapInArrow(_runs(names, width), f"part long, tree string, start long, size long, {lists}"))
    sizes = cut(runs.groupBy("part", "tree").agg(F.sum("size").alias("rows")))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = sizes.groupBy("tree").agg(F.sum("rows").alias("n"))
    places = cut(sizes.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(n, "tree")
                 .select("part", "tree", "before", "n"))
    runs = (runs.join(small(places), ["part", "tree"])
            .select("part", "tree", "start", "size", (F.col("before") + F.col("start")).alias("at"), "n", *names))
    n = cut(n)
    most = n.agg(F.max("n")).first()[0] or 0
    nodes = cut(runs.select("tree", "at", "n", "digest").mapInArrow(_borders, _NODE))
    for base in range(0, height(most), HEIGHT):
        level = F.col("level")
        around = (nodes.filter((level >= base) & (level <= base + HEIGHT)).join(small(n), "tree")
                  .filter("n > 1").select("tree", F.expr(f"shiftright(idx, {base + HEIGHT} - level)").alias("key"), "level", "idx", "n", "digest"))
        new = cut(around.repartition("tree", "key").sortWithinPartitions("tree", "key").mapInArrow(_upper(base), _NODE))
        nodes = nodes.union(new)
    top = F.expr("case when n > 1 then length(bin(n - 1)) else 0 end")
    roots = cut(nodes.filter("idx = 0").join(small(n), "tree").filter(F.col("level") == top).select("tree", "digest", "n"))
    return Forest(runs, nodes, roots)


def octopus(trees: Forest) -> DataFrame:
    """Per run, the node coordinates that its proofs need from elsewhere, with their
    digests: ``(part, tree, start, fetched)``.  Runs that need none have no row."""
    def coordinates(batches):
        for batch in batches:
            out = [(p, t, s, lv, i) for p, t, s, a, size, n in zip(*(c.to_pylist() for c in batch.columns)) for lv, i in missing(a, a + size, n)]
            yield _batch(out, ["part", "tree", "start", "level", "idx"], [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64()])

    asked = cut(trees.runs.select("part", "tree", "start", "at", "size", "n")
                .mapInArrow(coordinates, "part long, tree string, start long, level int, idx long"))
    per_level = {r[0]: r[1] for r in trees.nodes.groupBy("level").count().collect()}  # a row per level, 64 at most
    low, total = max(per_level, default=0) + 1, 0
    while low > 0 and total + per_level.get(low - 1, 0) <= TOP_NODES:
        low -= 1
        total += per_level.get(low, 0)
    at = ["tree", "level", "idx"]
    nodes = trees.nodes
    found = asked.filter(F.col("level") >= low).join(F.broadcast(nodes.filter(F.col("level") >= low)), at)
    if low:
        found = found.unionByName(asked.filter(F.col("level") < low).join(nodes.filter(F.col("level") < low), at))
    return found.groupBy("part", "tree", "start").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("fetched"))


def _expand(names: list[str], types: list[pa.DataType]):
    """Proofs of a run's leaves from its own nodes and the fetched ones."""
    def run(batches):
        for batch in batches:
            rows = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                tree, a, n = (rows[f][r].as_py() for f in ("tree", "at", "n"))
                digests = rows["digest"][r].as_py()
                nodes = inside(digests, a, n)
                for x in rows["fetched"][r].as_py() or []:
                    nodes[x["level"], x["idx"]] = x["digest"]
                lo, hi = a, a + len(digests) - 1
                steps = []  # by level, the entries of the nodes over these leaves
                for level in range(height(n)):
                    width = count(n, level)
                    row = {}
                    for i in range(lo, hi + 1):
                        sib = nodes.get((level, i ^ 1))
                        row[i] = "" if (i ^ 1) >= width else ("L" if i & 1 else "R") + sib.hex()
                    steps.append(row)
                    lo, hi = lo >> 1, hi >> 1
                    for i in range(lo, hi + 1):  # interiors shared by the leaves below
                        if (level + 1, i) not in nodes:
                            nodes[level + 1, i] = parent(nodes[level, 2 * i], nodes.get((level, 2 * i + 1)))
                root = nodes[height(n), 0]
                proofs = [[row[(a + k) >> level] for level, row in enumerate(steps)] for k in range(len(digests))]
                size = len(digests)
                cols = [pa.array([tree] * size, pa.string())]
                cols += [rows[f].slice(r, 1).flatten().cast(t) for f, t in zip(names, types)]
                cols += [pa.array(proofs, pa.list_(pa.string())), pa.array([root] * size, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["tree", *names, "proof", "root"])
    return run


def prove(trees: Forest) -> DataFrame:
    """``(tree, <the leaf's columns>, proof, root)`` of every leaf."""
    names = trees.runs.columns[trees.runs.columns.index("n") + 1:]
    fetched = cut(octopus(trees))
    at = ["part", "tree", "start"]
    full = trees.runs.join(fetched, at, "left")
    schema = ", ".join(f"`{f}` {trees.runs.schema[f].dataType.elementType.simpleString()}" for f in names)
    types = [to_arrow_type(trees.runs.schema[f].dataType.elementType) for f in names]
    return (full.select("tree", "at", "n", "fetched", *names)
            .mapInArrow(_expand(names, types), f"tree string, {schema}, proof array<string>, root binary"))


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields=FIELDS, changed: dict[str, Column] | None = None,
             width: int = WIDTH) -> DataFrame:
    """``(<group>, <key>, leaf, changed, subroot, root, proof)``, a row per row of ``docs``.

    ``leaf``, ``subroot`` and ``root`` are hex digests, ``proof`` leads from leaf
    to root (:func:`fold`).  ``changed`` maps names of fields to other values for
    them: the column ``changed`` is then the digest of the row with those values
    (null without them), for checks that a changed row doesn't fold to the root.
    """
    values = {f: F.col(f"`{f}`") for f in fields}
    digest, other = F.unhex(leaf_digest(list(values.values()))), F.lit(None).cast("binary")
    if changed:
        differs = functools.reduce(operator.or_, [~c.eqNullSafe(values[f]) for f, c in changed.items()])
        other = F.when(differs, F.unhex(leaf_digest(list((values | changed).values()))))
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col(f"`{key}`").cast("long").alias("key"), digest.alias("digest"),
                         other.alias("other"))
    trees = forest(leaves, "key", width)
    tops = forest(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name", width)
    above = cut(prove(tops).select(F.col("name").alias("tree"), F.col("proof").alias("above"), F.lower(F.hex("root")).alias("top")))
    names = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    hexed = {c: F.lower(F.hex(c)) for c in ("digest", "other", "root")}
    return (prove(trees).join(small(above), "tree")
            .select(names.alias(group), F.col("key").alias(key), hexed["digest"].alias("leaf"),
                    F.coalesce(hexed["other"], hexed["digest"]).alias("changed"), hexed["root"].alias("subroot"),
                    F.col("top").alias("root"), F.concat("proof", "above").alias("proof")))
