"""Embedding near-dedup by NN-descent.

1. Equal vectors become one (a partial aggregation), so copies are never compared.
2. First neighbour lists: random hyperplanes deal vectors into cells, ``TABLES``
   times; a cell of more than ``CELL`` vectors is dealt further by hash, so no
   task holds an unbounded cell. Within a cell all are compared.
3. NN-descent: every vector's neighbours and (at most as many) reverse
   neighbours are compared with each other, lists keep the best ``KEEP``, until
   a round brings few new links.
4. A saturated list (all of its entries are links) may hide links to other
   components behind closer members of its own. So vectors with such lists are
   searched again, with lists of members of other components only, and linked
   components merge, until no such list holds a link.
5. Saturated lists are enlarged to all members of their component, compared in
   blocks of ``BLOCK``; only counts leave a block, so no list grows in memory.
6. Recall is audited: ``AUDIT`` vectors drawn by hash of those without a link
   found, of those in small groups and of those in components with a saturated
   list, against all rows. Below ``RECALL`` the search goes on with new tables;
   if it is not reached in ``TRIES`` the result is refused.

A link is a cosine, in double precision, of the threshold or more.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

THRESHOLD = 0.9
TABLES, CELL, LEAF, KEEP, ROUNDS, BLOCK = 24, 256, 64, 10, 3, 512
#: Copies of a large component's blocks at most, so that they are compared in as many tasks.
SALTS = 8
AUDIT, RECALL, TRIES = 256, 0.98, 8


def unit(vectors: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype).reshape(len(vectors), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_length(vectors: list[bytes]):
    """(places, vectors) of each length: vectors of different lengths have no cosine and are never compared."""
    size = np.array([len(v) for v in vectors])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, [vectors[i] for i in at]


def valid(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, v: bytes) of the vectors that can be compared, and their number type."""
    kind = "<f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "<f4"
    real = "double" if kind == "<f8" else "float"

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            flat = batch.column("e")
            off = flat.offsets.to_numpy()
            v = flat.values.to_numpy(zero_copy_only=False).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v[a:b].tobytes() for a, b in zip(off, off[1:], strict=False)], pa.binary())], ["vec_id", "v"])

    e = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{real}>").alias("e")).filter("vec_id is not null and e is not null and size(e) > 0")
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    return e.filter(fine).mapInArrow(pack, "vec_id long, v binary"), kind


def cells(vecs: DataFrame, kind: str, bits: int, tables: range) -> DataFrame:
    """(t, dim, cell, id) for each vector and table; dim, the bytes of a vector, keeps lengths apart."""

    def deal(batches):
        import pyarrow as pa

        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at, same in by_length(batch.column("v").to_pylist()):
                x, ids = unit(same, kind), batch.column("id").take(pa.array(at))
                for t in tables:
                    p = planes.setdefault((t, x.shape[1]), np.random.default_rng(1000 + t).standard_normal((x.shape[1], max(bits, 1))))
                    code = ((x @ p > 0) @ (1 << np.arange(max(bits, 1)))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(np.full(len(x), len(same[0]), np.int32)), pa.array(code), ids], ["t", "dim", "cell", "id"])

    return vecs.mapInArrow(deal, "t int, dim int, cell long, id long")


def compared(groups: DataFrame, kind: str) -> DataFrame:
    """(u, w, c): for each vector of a group(ids, vs) its ``KEEP`` nearest of the group, and c their cosine. With comps, nearest of other components only."""
    apart = "comps" in groups.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            us, ws, cs = [], [], []
            comps = batch.column("comps").to_pylist() if apart else [None] * len(batch)
            for ids, vs, own in zip(batch.column("ids").to_pylist(), batch.column("vs").to_pylist(), comps, strict=True):
                if len(ids) < 2 or apart and len(set(own)) < 2:
                    continue
                x, ids = unit(vs, kind), np.array(ids)
                s = x @ x.T
                np.fill_diagonal(s, -2)
                if apart:
                    own = np.array(own)
                    s[own[:, None] == own] = -2
                k = min(KEEP, len(ids) - 1)
                best = np.argpartition(-s, k - 1, 1)[:, :k]
                got = np.take_along_axis(s, best, 1).ravel()
                us.append(np.repeat(ids, k)[got > -2])
                ws.append(ids[best].ravel()[got > -2])
                cs.append(got[got > -2])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, ws, cs)], ["u", "w", "c"])

    return groups.mapInArrow(run, "u long, w long, c double")


def gathered(rows: DataFrame, *by: str) -> DataFrame:
    """(ids, vs) of each group of rows(id, v), and comps where rows have comp."""
    g = rows.groupBy(*by).agg(F.collect_list(F.struct(*[k for k in ("id", "v", "comp") if k in rows.columns])).alias("g"))
    return g.select(F.col("g.id").alias("ids"), F.col("g.v").alias("vs"), *[F.col("g.comp").alias("comps")] * ("comp" in rows.columns))


def best(edges: DataFrame) -> DataFrame:
    """The ``KEEP`` best entries of each list."""
    top = edges.groupBy("u", "w").agg(F.max("c").alias("c")).groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("d"), "w"))), 1, KEEP).alias("l"))
    return top.select("u", F.explode("l").alias("x")).select("u", F.col("x.w").alias("w"), (-F.col("x.d")).alias("c"))


def start(vecs: DataFrame, kind: str, n: int, tables: range) -> DataFrame:
    bits = max(0, math.ceil(math.log2(max(1, n) / LEAF)))
    at = c.cut(cells(vecs.select("id", "v"), kind, bits, tables), "cells")
    large = at.groupBy("t", "dim", "cell").agg(F.count("*").alias("m")).filter(F.col("m") > CELL)
    dealt = at.join(large, ["t", "dim", "cell"], "left").withColumn("part", F.when(F.col("m").isNotNull(), F.pmod(F.xxhash64("t", "id"), F.ceil(F.col("m") * 2 / CELL))).otherwise(0))
    return compared(gathered(dealt.join(vecs, "id"), "t", "dim", "cell", "part"), kind)


def refine(edges: DataFrame, vecs: DataFrame, kind: str) -> DataFrame:
    """One round of NN-descent: what neighbours of a vector find in each other."""
    salted = edges.select(F.col("w").alias("u"), F.col("u").alias("w"), F.pmod(F.xxhash64("u", "w"), F.lit(KEEP)).alias("slot"))
    reverse = salted.groupBy("u", "slot").agg(F.min("w").alias("w")).select("u", "w")
    member = edges.select("u", "w").union(reverse).union(edges.select("u", F.col("u").alias("w"))).distinct()
    return compared(gathered(member.join(vecs, member.w == vecs.id), "u"), kind)


def merged(vecs: DataFrame, edges: DataFrame, comp: DataFrame, kind: str, threshold: float, tables: int) -> DataFrame:
    """The components (node, comp) after merging those between which vectors with saturated lists have a link.

    Such a vector's list has no place left for what is farther than ``KEEP`` of
    its own. Here its list holds only the nearest of other components, so a cap
    hides no component that has a link: a round merges each component with at
    least one it is linked to, and new rounds with new tables follow until none
    finds a link.
    """
    links = edges.filter(F.col("c") >= threshold)
    full = c.cut(links.groupBy("u").agg(F.count("*").alias("k")).filter(F.col("k") >= KEEP).select(F.col("u").alias("node")), "full")
    own = links.join(full, links.u == full.node, "left_semi").select("u", "w", "c")
    while True:
        at = c.cut(full.join(comp, "node").join(vecs.select(F.col("id").alias("node"), "v"), "node").select(F.col("node").alias("id"), "v", "comp"), "apart")
        n = at.agg(F.count("*").alias("n"), F.min("comp") != F.max("comp")).first()
        if not n[1]:
            return comp
        near = c.cut(best(start(at, kind, n[0], range(tables, tables + TABLES))), "near")
        tables += TABLES
        for _ in range(ROUNDS):
            if near.filter(F.col("c") >= threshold).limit(1).count():
                break
            old, near = near, c.cut(best(near.union(refine(own.union(near), at, kind))), "near")
            c.drop(old)
        label = at.select("id", "comp")
        pairs = near.filter(F.col("c") >= threshold).join(label.select(F.col("id").alias("u"), F.col("comp").alias("a")), "u").join(label.select(F.col("id").alias("w"), F.col("comp").alias("b")), "w").select("a", "b").distinct()
        pairs = c.cut(pairs, "pairs")
        if not pairs.limit(1).count():
            return comp
        to = c.components(pairs).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        comp = c.cut(comp.join(to, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "components")


def enlarged(vecs: DataFrame, comp: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(id, links, near): how many links each member of the components (node, comp) has within its component, itself among them, with copies and without, block against block."""
    at = comp.join(vecs, comp.node == vecs.id).select("comp", "id", "v", "copies")
    size = comp.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    at = at.join(size, "comp").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = c.cut(at.groupBy("comp", "part", "parts").agg(F.collect_list(F.struct("id", "v", "copies")).alias("g")), "blocks")
    left = blocks.select("comp", "part", F.col("g.id").alias("ids"), F.col("g.v").alias("vs"), F.explode(F.sequence(F.lit(0), F.least(F.lit(SALTS), "parts") - 1)).alias("salt"))
    right = blocks.select("comp", F.pmod("part", F.least(F.lit(SALTS), "parts")).alias("salt"), F.col("g.v").alias("ws"), F.col("g.copies").alias("ms"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for m in batch.to_pylist():
                x, y = unit(m["vs"], kind), unit(m["ws"], kind)
                hit = x @ y.T >= threshold
                yield pa.RecordBatch.from_arrays([pa.array(m["ids"]), pa.array((hit * np.array(m["ms"], np.int64)).sum(1)), pa.array(hit.sum(1).astype(np.int64))], ["id", "links", "near"])

    return left.join(right, ["comp", "salt"]).select("ids", "vs", "ws", "ms").mapInArrow(run, "id long, links long, near long").groupBy("id").agg(F.sum("links").alias("links"), F.sum("near").alias("near"))


def audit(vecs: DataFrame, per: DataFrame, deep: DataFrame, kind: str, threshold: float) -> float:
    """Recall of per(id, near): the mean over vectors that have links of the share found, the lesser of that outside and that inside the components deep(node, comp).

    Each of three parts (no link found, small groups, deep components) is drawn
    from alike, so a hot group does not outweigh the rest; outside deep the two
    parts count by their sizes. Links are those to other vectors, all of them.
    """
    part = F.when(F.col("node").isNotNull(), 2).when(F.col("near") > 0, 1).otherwise(0)
    at = vecs.select("id", "v").join(per.select("id", "near"), "id", "left").join(deep.select("node"), F.col("id") == F.col("node"), "left").select("id", "v", F.coalesce("near", F.lit(0)).alias("near"), part.alias("part"))
    at = c.cut(at, "audit")
    sizes = {r.part: r["count"] for r in at.groupBy("part").count().collect()}
    drawn = [r for k in sorted(sizes) for r in at.filter(F.col("part") == k).orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(AUDIT).collect()]
    if not drawn:
        return 1.0
    ids = np.array([r.id for r in drawn])
    held = vecs.sparkSession.sparkContext.broadcast((ids, {len(same[0]): (places, unit(same, kind)) for places, same in by_length([r.v for r in drawn])}))

    def run(batches):
        import pyarrow as pa

        ids, drawn = held.value
        n = np.zeros(len(ids), np.int64)
        for batch in batches:
            for at, same in by_length(batch.column("v").to_pylist()):
                if len(same[0]) in drawn:
                    places, x = drawn[len(same[0])]
                    own = batch.column("id").to_numpy()[at]
                    n[places] += ((unit(same, kind) @ x.T >= threshold) & (own[:, None] != ids[places])).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["u", "n"])

    there = {r.u: r.n for r in vecs.select("id", "v").mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")).collect()}
    c.drop(at)
    found, linked = np.zeros(3), np.zeros(3)
    for r in drawn:
        if there[r.id]:
            weight = sizes[r.part] / min(AUDIT, sizes[r.part])
            found[r.part] += weight * min(1, r.near / there[r.id])
            linked[r.part] += weight
    return min((f / n for f, n in ((found[:2].sum(), linked[:2].sum()), (found[2], linked[2])) if n), default=1.0)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, n_links, component_id, kept), one row per input row.

    Vectors that are null, empty, zero, or hold null or non-finite components have
    no links and are their own component. Vectors of different lengths aren't linked.
    Equal vectors are linked with each other. Rows that repeat a vec_id are
    vectors of their own for n_links and one node for components. A null vec_id
    is linked with nothing and kept. An empty table gives an empty result. If
    the audit does not measure ``RECALL`` in ``TRIES``, RuntimeError is raised.
    """
    packed, kind = valid(vectors)
    packed = c.cut(packed, "vectors")
    vecs = c.cut(packed.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).groupBy("id").agg(F.first("v").alias("v"), F.sum("copies").alias("copies")), "distinct")
    n = vecs.count()
    edges, done = None, 0
    for _ in range(TRIES):
        new = start(vecs.select("id", "v"), kind, n, range(done, done + TABLES))
        done += TABLES
        edges = c.cut(best(new if edges is None else edges.union(new)), "lists")
        before = edges.filter(F.col("c") >= threshold).count()
        for _ in range(ROUNDS):
            old, edges = edges, c.cut(best(edges.union(refine(edges, vecs.select("id", "v"), kind))), "lists")
            c.drop(old)
            now = edges.filter(F.col("c") >= threshold).count()
            if now <= before * 1.002:
                break
            before = now
        links = edges.filter(F.col("c") >= threshold)
        comp = merged(vecs, edges, c.cut(c.components(links, "u", "w"), "components"), kind, threshold, done)
        count = links.select("u", "w").union(links.select("w", "u")).distinct()
        full = links.groupBy("u").agg(F.count("*").alias("k")).filter(F.col("k") >= KEEP)
        deep = comp.join(full.join(comp, F.col("u") == F.col("node")).select("comp").distinct(), "comp", "left_semi")
        deep = c.cut(deep.select("node", "comp"), "saturated")
        listed = count.join(vecs.select(F.col("id").alias("w"), "copies"), "w").groupBy("u").agg(F.sum("copies").alias("links"), F.count("*").alias("near")).join(deep, F.col("u") == F.col("node"), "left_anti").select(F.col("u").alias("id"), "links", "near")
        whole = enlarged(vecs, deep, kind, threshold).join(vecs.select("id", "copies"), "id").select("id", (F.col("links") - F.col("copies")).alias("links"), (F.col("near") - 1).alias("near"))
        per = c.cut(listed.union(whole), "counts")
        recall = audit(vecs, per, deep, kind, threshold)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"recall of links is {recall:.3f} after {done} tables; at least {RECALL} is needed")
    info = vecs.join(per, "id", "left").join(comp, F.col("id") == F.col("node"), "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("comp", "id").alias("comp"))
    known = packed.join(info, "v").select("vec_id", "n", "comp").groupBy("vec_id").agg(F.max("n").alias("n"), F.min("comp").alias("comp"))
    out = vectors.select(F.col("vec_id").cast("long")).join(known, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"), F.coalesce(F.coalesce("comp", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
