"""Near-duplicate documents by an LSH forest over MinHash signatures.

Method.  A document is its set of distinct word shingles.  ``trees`` signature
orders of ``depth`` MinHash values each are sorted; documents whose signatures
share a long prefix stand next to each other.

1. Rows with equal sets collapse into one class (an aggregate on a 128-bit set
   key), so copies cost one row each and never meet in one task.
2. Regions: classes that share the first ``base_depth`` values in some tree.
3. Longest-common-prefix neighbours: the classes of all trees are sorted by
   (tree, signature) over range partitions; each class takes the neighbour with
   the longest common prefix over all trees.  The depth at which it is found
   adapts to how crowded the region is.  These pairs are confirmed on the full
   shingle sets and joined into components.
4. Regions that overlap make a crowd.  A few members of each crowd are compared
   with all its members; then every member that is not yet in the crowd's
   largest component is compared with all of them.  So no link of a region is
   lost, whatever its size, and pairs inside a component, which cannot change
   the result, are never listed.  The comparisons run in blocks of a bounded
   number of shingles, and only confirmed links leave a block.

A pair at similarity ``s`` shares a region with probability
``1 - (1 - s**base_depth)**trees`` (s=0.85: 1 - 4e-7, s=0.8: 1 - 3e-5).
Links are only ever made on full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .cluster import connected_components, cut, ready, small

BASE_DEPTH, DEPTH, TREES, LOOK_BACK = 4, 8, 20, 3
SCOUTS = 16  # members of a crowd that meet all its members first
BLOCK_SHINGLES = 1 << 19  # shingles on either side of a block


def _shingle_sets(batches, text, shingle):
    """(slice, distinct shingle hashes, offsets) of bounded slices of the batches."""
    for rows, data, off in W.chunks(batches, text):
        g, goff = W.ngrams(W.find_words(data, off), shingle)
        yield rows, *W.distinct(g, goff)


def _signer(shingle: int, trees: int, depth: int):
    def run(batches):
        flip, by = W.seeds(trees * depth, 11), W.seeds(trees * depth, 13) | W.U(1)
        for rows, sets, off in _shingle_sets(batches, "text", shingle):
            n = np.diff(off)
            full = np.flatnonzero(n)
            sig = np.zeros((len(n), trees * depth), ">u4")
            k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(full):
                at = off[:-1][full]
                with np.errstate(over="ignore"):
                    k1[full] = W.mix(np.add.reduceat(W.mix(sets), at))
                    k2[full] = W.mix(np.add.reduceat(W.mix(sets ^ flip[0]), at) + n[full].astype(np.uint64))
                    for k in range(trees * depth):
                        low = np.minimum.reduceat((sets ^ flip[k]) * by[k], at)
                        sig[full, k] = (low >> W.U(32)).astype(np.uint32)
            blob = sig.tobytes()
            w = 4 * trees * depth
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n, pa.int64()), W.as_long(k1), W.as_long(k2),
                 pa.array([blob[i * w: (i + 1) * w] for i in range(len(n))], pa.binary())],
                ["doc_id", "n_shingles", "k1", "k2", "sig"])
    return run


def signatures(docs: DataFrame, shingle: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, k1, k2, sig)``; one pass, no shuffle."""
    ready(docs)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _signer(shingle, trees, depth), "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def _set_maker(shingle: int):
    def run(batches):
        for rows, sets, off in _shingle_sets(batches, "text", shingle):
            yield pa.RecordBatch.from_arrays([rows.column(0), W.list_of(W.as_long(sets), off)], ["cid", "shingles"])
    return run


def _neighbours(base_depth: int, depth: int, percent: int):
    """Pairs of a sorted run of (tree, s, cid, n): each class with up to
    LOOK_BACK classes before it that share ``base_depth`` values or more."""
    def run(batches):
        tail: list = []
        for b in batches:
            rows = tail + list(zip(*(b.column(i).to_pylist() for i in range(4))))
            out_a, out_b, out_l = [], [], []
            for i in range(len(tail), len(rows)):
                tree, s, cid, n = rows[i]
                for j in range(i - 1, max(-1, i - 1 - LOOK_BACK), -1):
                    t2, s2, c2, n2 = rows[j]
                    if t2 != tree or s2[: 4 * base_depth] != s[: 4 * base_depth]:
                        break
                    if c2 == cid or 100 * min(n, n2) < percent * max(n, n2):
                        continue
                    lcp = base_depth
                    while lcp < depth and s[4 * lcp: 4 * lcp + 4] == s2[4 * lcp: 4 * lcp + 4]:
                        lcp += 1
                    out_a.append(cid), out_b.append(c2), out_l.append(lcp)
            tail = rows[-LOOK_BACK:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_l, pa.int32())], ["a", "b", "lcp"])
    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have ``100 * |A & B| >= percent * |A | B|``."""
    j = (pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
         .join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b"))
    both = F.size(F.array_intersect("sa", "sb"))
    return j.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _block_links(percent: int):
    """Links between the queries (role 0) and members (role 1) of each key, in
    rows (key, role, cid, shingles) sorted by key and role."""
    def links(ids, sets, roles):
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        off = np.concatenate([[0], np.cumsum(n)])
        first = int(np.searchsorted(roles, 1))
        if not first or first == len(ids):
            return
        known, code = np.unique(np.concatenate(sets), return_inverse=True)
        members = code[off[first]:]
        at = off[first:-1] - off[first]
        mark = np.zeros(len(known), bool)
        for i in range(first):
            mark[:] = False
            mark[code[off[i]: off[i + 1]]] = True
            both = np.add.reduceat(mark[members], at, dtype=np.int64)
            for j in np.flatnonzero(100 * both >= percent * (n[i] + n[first:] - both)):
                if ids[first + j] != ids[i]:
                    yield ids[i], ids[first + j]

    def run(batches):
        key, ids, sets, roles = None, [], [], []

        def flush():
            got = list(links(ids, sets, np.array(roles)))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], ["a", "b"])
        for b in batches:
            values = b.column(3)
            flat, off = values.flatten().to_numpy(), np.asarray(values.offsets)
            off = off - off[0]
            for i, (k, role, cid) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                if k != key and ids:
                    yield flush()
                    ids, sets, roles = [], [], []
                key = k
                ids.append(cid), roles.append(role), sets.append(flat[off[i]: off[i + 1]])
        if ids:
            yield flush()
    return run


def compare(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the queries of each group with all its members, among
    ``members(g, cid, n, query)``.  Queries and members of a group are dealt out
    over as many blocks as their shingles need."""
    size = cut(members.groupBy("g").agg(
        F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("mb"),
        F.ceil(F.sum(F.when(F.col("query"), F.col("n"))) / BLOCK_SHINGLES).cast("int").alias("qb")).filter("qb > 0"))
    m = members.join(small(size), "g").withColumn("h", F.xxhash64("cid"))
    as_member = m.select("cid", F.lit(1).alias("role"), "g", F.pmod("h", "mb").alias("i"),
                         F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("j"))
    as_query = m.filter("query").select("cid", F.lit(0).alias("role"), "g", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"),
                                        F.pmod("h", "qb").alias("j"))
    rows = as_member.union(as_query).select("cid", "role", F.xxhash64("g", "i", "j").alias("key")).join(sets, "cid")
    return (rows.select("key", "role", "cid", "shingles").repartition("key").sortWithinPartitions("key", "role")
            .mapInArrow(_block_links(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = TREES,
                    base_depth: int = BASE_DEPTH, depth: int = DEPTH) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of
    similarity ``percent`` / 100 or more; ``kept`` marks the one document of
    each group that stays.  Null, empty and blank texts have an empty set and
    link with nothing.  Repeated rows of a ``doc_id`` are one document, each
    row is returned.  A null ``doc_id`` links with nothing (component null,
    kept true).  Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(signatures(docs, shingle, trees, depth))
    classes = cut(signed.filter("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))

    def forest(c: DataFrame) -> DataFrame:
        s = F.expr(f"substring(sig, {4 * depth} * tree + 1, {4 * depth})")
        return (c.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("s", s)
                .withColumn("region", F.xxhash64("tree", F.expr(f"substring(s, 1, {4 * base_depth})"))))

    # classes that share a region with another; all that follows is about them
    crowded = cut(forest(classes).groupBy("region").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"))
                  .filter("lo <> hi").select("region"))
    wanted = forest(classes).select("region", "cid").join(crowded, "region", "left_semi").select("cid").distinct()
    near = cut(classes.join(cut(wanted), "cid"))
    sets = cut(docs.withColumnRenamed("doc_id", "cid").join(near.select("cid").distinct().hint("merge"), "cid", "left_semi")
               .select("cid", "text").mapInArrow(_set_maker(shingle), "cid long, shingles array<long>"))

    trunk = forest(near).select("tree", "s", "cid", "n")
    pairs = (trunk.repartitionByRange("tree", "s", "cid").sortWithinPartitions("tree", "s", "cid")
             .mapInArrow(_neighbours(base_depth, depth, percent), "a long, b long, lcp int"))
    best = pairs.groupBy("a").agg(F.max(F.struct("lcp", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    links = confirm(best, sets, percent)

    # crowds: classes of overlapping regions
    member = forest(near).select("region", "cid")
    low = cut(member.groupBy("region").agg(F.min("cid").alias("b"), F.max("cid").alias("hi")).filter("b <> hi").drop("hi"))
    crowd = cut(connected_components(member.join(small(low), "region").select(F.col("cid").alias("a"), "b")))
    crowd = cut(near.select("cid", "n").join(crowd.select(F.col("node").alias("cid"), F.col("component").alias("g")), "cid"))
    scouts = crowd.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    order = F.xxhash64("cid")
    # the SCOUTS first by hash: the threshold that so many of m hashes stay under, on average
    limit = F.expr(f"-9223372036854775808 + 18446744073709551615.0 * least(1.0, {SCOUTS} / cast(m as double))")
    scouted = crowd.join(small(cut(scouts)), "g").withColumn("query", order.cast("double") <= limit).select("g", "cid", "n", "query")
    links = cut(links.union(compare(cut(scouted), sets, percent)))
    comp = cut(connected_components(links))

    # members outside their crowd's largest component meet all its members
    placed = cut(crowd.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    parts = placed.groupBy("g", "component").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("g").agg(F.max(F.struct("m", "component")).alias("x"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_ = placed.join(small(cut(main.select("g", F.col("x.component").alias("main")))), "g")
    open_ = cut(open_.select("g", "cid", "n", (F.col("component") != F.col("main")).alias("query")))
    comp = cut(connected_components(links.union(compare(open_, sets, percent))))

    named = cut(classes.select("k1", "k2", "cid").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
                .select("k1", "k2", F.coalesce("component", "cid").alias("component_id")))
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    # an empty set and a row without id stand alone
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    c = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", c.alias("component_id"), c.eqNullSafe(F.col("doc_id")).alias("kept"))
