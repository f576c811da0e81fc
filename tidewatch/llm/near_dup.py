"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, star components.

How a group that holds a third of all rows is handled:

* Equal shingle sets meet in a partial aggregation (one representative each);
  copies never become pairs.
* Round 0 pairs every representative with one member of each of its buckets
  (drawn by hash, so bands differ) and confirms its two likeliest pairs. A bucket
  of m members costs m pairs.
* What is left are buckets whose members are still in different components.
  Documents that have too many shingles of their own to reach the threshold with
  any other go (an exact test). Then every member outside the bucket's largest
  component is compared with all members of other components, in large buckets
  chunk by block inside rows, so that no pairs are emitted. Every pair that shares a
  bucket is therefore compared, ruled out, or already in one component: no cap,
  and no link is lost.
* Joins on hot keys are plain equi-joins that AQE splits.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

SHINGLE = 5
BANDS, ROWS = 32, 4
#: A pair at the threshold agrees in 96 of 128 minima, give or take 4.9; fewer than 70 rule it out.
SLACK = 26
#: Members up to which a bucket's pairs are rows of their own; members of a chunk and of a block of a larger bucket.
SMALL, CHUNK, BLOCK = 32, 64, 128
#: A large bucket's blocks are dealt to so many tasks or more, its chunks copied to each: as often as copies make up the bucket's size, as chunks are mostly few.
SALTS = 8
#: Shingles of a chunk or a block, about: very long documents make more and smaller ones.
SHINGLES = 100_000
#: So many 8-byte ids at most are broadcast (under 64 MB with their hash table).
LISTED = 2_000_000


def shingle_sets(texts, shingle: int = SHINGLE):
    """For each text its sorted distinct 64-bit shingle hashes: words lower-cased in A-Z, ``shingle`` words each.

    A text of fewer words has its whole sequence as its one shingle; none without words.
    """
    values = c.byte_values(lower=True)
    odd = c.byte_values(lower=False, seed=11)[: shingle + 1] | c.U(1)
    for _, _, off, data in c.chunks(texts):
        starts, ends, first = c.word_spans(off, data)
        h = c.span_hashes(data, starts, ends, values)
        n = len(h) - shingle + 1
        if n > 0:
            s = h[:n] * odd[0]
            for k in range(1, shingle):
                s += h[k : k + n] * odd[k]
            c.fmix(s)
        for i in range(len(off) - 1):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= shingle:
                yield np.unique(s[lo : hi - shingle + 1])
            elif hi > lo:
                yield c.fmix((h[lo:hi] * odd[: hi - lo]).sum(keepdims=True, dtype=c.U) + odd[shingle : shingle + 1] * c.U(hi - lo))
            else:
                yield h[:0]


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, set_key, sig): set_key names the set; sig has, for each band, 16 bits of each of its four minima in one number, under a mask of the band, so that equal minima in different bands don't meet in a bucket."""
    if rows != 4:
        raise ValueError("a band has four minima, 16 bits of each")
    k = bands * rows

    def run(batches):
        import pyarrow as pa

        rng = np.random.default_rng(20)
        a = rng.integers(1, 1 << 63, k, dtype=np.int64).astype(c.U) | c.U(1)
        b = rng.integers(0, 1 << 63, k, dtype=np.int64).astype(c.U)
        masks = rng.integers(-(1 << 63), (1 << 63) - 1, bands, dtype=np.int64)
        for batch in batches:
            sizes, keys, sigs = [], [], []
            held, held_n = [], 0

            def flush():
                if not held:
                    return
                x = np.concatenate(held)
                at = np.r_[0, np.cumsum([len(s) for s in held])[:-1]]
                low = np.empty((len(held), k), np.uint16)
                for j in range(k):
                    low[:, j] = (np.minimum.reduceat(x * a[j] + b[j], at) >> c.U(32)).astype(np.uint16)
                sigs.extend(low.view(np.int64) ^ masks)
                held.clear()

            for s in shingle_sets(batch.column("text"), shingle):
                sizes.append(len(s))
                if not len(s):
                    flush()
                    keys.append(None)
                    sigs.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                held.append(s)
                held_n = held_n + len(s) if len(held) > 1 else len(s)
                if held_n > 100_000:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "sig"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig array<long>")


def minima(x) -> np.ndarray:
    """The signatures of an Arrow list array as rows of 16-bit minima."""
    return x.flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(len(x), -1)


def likely(pairs: DataFrame, least: int) -> DataFrame:
    """(a, b, n) of pairs(a, b, x, y) whose signatures x and y agree in n >= least minima."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                n = (minima(batch.column("x")) == minima(batch.column("y"))).sum(1)
                ok = n >= least
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok)), pa.array(n[ok].astype(np.int32))], ["a", "b", "n"])

    return pairs.select("a", "b", "x", "y").mapInArrow(count, "a long, b long, n int")


def picked(rows: DataFrame, ids: DataFrame, on: str = "doc_id") -> DataFrame:
    """The rows whose ``on`` is among ids(doc_id), a written frame: up to ``LISTED`` ids, counted, are broadcast, so that rows stay where they are; more are joined by a shuffle."""
    ids = ids.select(F.col("doc_id").alias(on))
    return rows.join(F.broadcast(ids) if ids.count() <= LISTED else ids.distinct(), on, "left_semi")


def sets_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, s): the shingle sets, as bytes, of the documents in ids(doc_id)."""

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), shingle)], pa.binary())], ["id", "s"])

    return c.cut(picked(docs, ids).mapInArrow(build, "id long, s binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have den * intersection >= num * union."""

    def test(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), c.U), np.frombuffer(y.as_buffer(), c.U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(den * common >= num * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = c.cut(pairs.select("a", "b"), "pairs")
    sets = picked(sets, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), "id")
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    out = c.cut(full.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long"), "links")
    c.drop(pairs)
    return out


def hopeless(sets: DataFrame, ids: DataFrame, num: int, den: int) -> DataFrame:
    """The ids of whose shingles more than 1 - num / den are in no other set of ids: they can have no partner there, so leaving them out loses nothing."""
    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            n = [len(x.as_buffer()) // 8 for x in batch.column("s")]
            flat = np.frombuffer(b"".join(x.as_py() for x in batch.column("s")), np.int64)
            for lo in range(0, len(flat), 1 << 16):
                hi = min(len(flat), lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), n)[lo:hi]), pa.array(flat[lo:hi])], ["id", "x"])

    each = picked(sets, ids, "id").mapInArrow(unpack, "id long, x long")
    seen = each.groupBy("x").agg(F.min("id").alias("lo"), F.count("*").alias("n"))
    alone = seen.filter("n = 1").groupBy(F.col("lo").alias("id")).agg(F.count("*").alias("alone"))
    size = sets.select("id", (F.length("s") / 8).cast("long").alias("size"))
    return size.join(alone, "id").filter(F.col("alone") * den > (den - num) * F.col("size")).select(F.col("id").alias("doc_id"))


def across(many: DataFrame, uniq: DataFrame, sets: DataFrame, num: int, den: int, least: int) -> DataFrame:
    """Links (a, b) between components of large buckets, from rows (key, doc_id, n, comp, big) with the bucket's members m and their shingles total, and the same of members outside big, away and away_n.

    A bucket's members outside its largest component, ``CHUNK`` at a time, meet all
    its members, ``BLOCK`` at a time, inside one row of the plan: their signatures,
    then their full sets are compared there, pair by pair, and only links leave (one
    for each two components that a chunk and a block join). A pair is compared in
    the first bucket it shares. So rows grow with members, not with pairs, and no
    task holds more than a chunk and a block.
    """
    ids = c.cut(many.select("doc_id").distinct(), "ids")
    full = many.join(picked(uniq.select("doc_id", "sig"), ids), "doc_id").join(picked(sets.select(F.col("id").alias("doc_id"), "s"), ids), "doc_id")
    one = F.struct("doc_id", "comp", "n", "sig", "s")
    part = lambda m, total, size: F.pmod(F.xxhash64("doc_id", "key"), F.greatest(F.ceil(F.col(m) / size), F.ceil(F.col(total) / SHINGLES)))
    many_blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / SHINGLES))
    salts = F.least(many_blocks, F.greatest(F.lit(SALTS).cast("bigint"), F.floor(F.col("m") / F.greatest("away", F.lit(1)))))
    chunks = full.filter("comp <> big").groupBy("key", part("away", "away_n", CHUNK).alias("chunk"), salts.alias("salts")).agg(F.collect_list(one).alias("x")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    blocks = full.groupBy("key", part("m", "total", BLOCK).alias("block"), salts.alias("salts")).agg(F.collect_list(one).alias("y")).withColumn("salt", F.pmod("block", "salts"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            sides = [batch.column(k) for k in ("x", "y")]
            offs = [t.offsets.to_pylist() for t in sides]
            for row, key in enumerate(batch.column("key").to_pylist()):
                x, y = (t.values.slice(o[row], o[row + 1] - o[row]) for t, o in zip(sides, offs, strict=True))
                col = lambda t, k: t.field(k).to_numpy(zero_copy_only=False)
                bx, by = (t.field("sig").flatten().to_numpy().reshape(len(t), -1) for t in (x, y))
                same = bx[:, None, :] == by[None, :, :]
                at = np.argmax(bx == key, 1)
                ok = (np.argmax(same, 2) == at[:, None]) & (col(x, "comp")[:, None] != col(y, "comp")[None, :])
                nx, ny = col(x, "n")[:, None], col(y, "n")[None, :]
                ok &= (nx * den >= ny * num) & (ny * den >= nx * num)
                ix, iy, cy = col(x, "doc_id"), col(y, "doc_id"), col(y, "comp")
                sx, sy = (minima(t.field("sig")) for t in (x, y))
                setx, sety = x.field("s"), y.field("s")
                for i in np.flatnonzero(ok.any(1)):
                    js = np.flatnonzero(ok[i])
                    n = (sy[js] == sx[i]).sum(1)
                    js, n = js[n >= least], n[n >= least]
                    a, done = np.frombuffer(setx[i].as_buffer(), c.U), set()
                    for j in js[np.argsort(-n, kind="stable")]:
                        if cy[j] in done:
                            continue
                        both = np.concatenate([a, np.frombuffer(sety[j].as_buffer(), c.U)])
                        both.sort(kind="stable")
                        common = int((both[1:] == both[:-1]).sum())
                        if den * common >= num * (len(both) - common):
                            found.append((ix[i], iy[j]))
                            done.add(cy[j])
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    with c.batch_rows(many.sparkSession, 8):
        return c.cut(chunks.join(blocks, ["key", "salt"]).select("key", "x", "y").mapInArrow(run, "a long, b long"), "far")


def unsettled(rows: DataFrame) -> DataFrame:
    """Rows (key, doc_id, n, comp) of the buckets that hold more than one component, with the component ``big`` that has most of a bucket's members."""
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("big"), F.count("*").alias("comps")).filter("comps > 1")
    return rows.join(per.select("key", "big"), "key")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, num: int = 75, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked where den * |A and B| >= num * |A or B|.

    Input: doc_id long, text string; other columns are ignored. Null and empty
    texts have no shingles and are linked with nothing. Equal sets are linked.
    Rows that repeat a doc_id with the same text each get that document's result;
    with different texts they count as one document for linking. A null doc_id
    is linked with nothing and kept. An empty table gives an empty result.
    A pair at the threshold shares no band with probability 5.2e-6, and agrees in
    too few minima with 1e-7: both together lose 5.3e-6 of such pairs.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    base = c.cut(signatures(docs, shingle, bands, rows), "signatures")
    known = base.filter("doc_id is not null and set_key is not null")
    reps = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    uniq = c.cut(known.groupBy("set_key").agg(F.min_by(F.struct("doc_id", "n_shingles", "sig"), "doc_id").alias("r")).select("r.*"), "representatives")
    slots = uniq.select("doc_id", F.col("n_shingles").alias("n"), F.explode("sig").alias("key"))
    mixed = F.col("doc_id").bitwiseXOR(F.shiftrightunsigned("key", 1))  # a bucket's own order of doc_ids, so bands differ in their pivot
    first = slots.groupBy("key").agg(F.min(F.struct(mixed.alias("x"), "n")).alias("p"), F.count("*").alias("m")).filter("m > 1")
    first = first.select("key", F.col("p.x").bitwiseXOR(F.shiftrightunsigned("key", 1)).alias("pivot"), F.col("p.n").alias("pn"))
    shared = c.cut(slots.join(first, "key").select("key", "doc_id", "n", "pivot", "pn"), "buckets")
    sig, least = uniq.select("doc_id", "sig"), bands * rows * num // den - SLACK * bands * rows // 128

    def alike(x: str, y: str) -> Column:
        return (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = c.cut(pairs, "candidates")
        some = picked(sig, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
        return likely(pairs.join(some.select(F.col("doc_id").alias("a"), F.col("sig").alias("x")), "a").join(some.select(F.col("doc_id").alias("b"), F.col("sig").alias("y")), "b"), least)

    star = shared.filter((F.col("doc_id") != F.col("pivot")) & alike("n", "pn")).select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    best = verified(star).groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b1"), F.min_by("b", F.struct(-F.col("n"), "b")).alias("b2"))
    star = best.select("a", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("b"))
    ids = c.cut(shared.select("doc_id").distinct(), "ids")
    sets = sets_of(docs, ids, shingle)
    links = confirmed(star, sets, num, den)
    comp = c.cut(c.components(links), "components")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(comp, F.col("doc_id") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "doc_id")).drop("node")

    open_ = c.cut(unsettled(placed(shared.select("key", "doc_id", "n"))), "open")
    left = c.cut(open_.select("doc_id").distinct(), "ids")
    out = hopeless(sets, left, num, den)
    rest = open_.join(out, "doc_id", "left_anti").drop("comp", "big")
    rest = c.cut(unsettled(placed(rest)), "rest")
    c.drop(open_)
    away = F.col("comp") != F.col("big")
    count = rest.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.count_if(away).alias("away"), F.coalesce(F.sum(F.when(away, F.col("n"))), F.lit(0)).alias("away_n"))
    few = rest.join(count.filter(F.col("m") <= SMALL).select("key"), "key")
    x = few.filter("comp <> big").select("key", F.col("doc_id").alias("i"), F.col("n").alias("ni"), F.col("comp").alias("ci"))
    pairs = x.join(few.select("key", "doc_id", "n", "comp"), "key").filter((F.col("ci") != F.col("comp")) & alike("n", "ni"))
    pairs = pairs.select(F.greatest("i", "doc_id").alias("a"), F.least("i", "doc_id").alias("b")).distinct()
    more = confirmed(verified(pairs).select("a", "b").distinct(), sets, num, den)
    many = c.cut(rest.join(count.filter(F.col("m") > SMALL), "key"), "large")
    far = across(many, uniq, sets, num, den, least)
    for t in (shared, sets, rest, many, uniq, ids, left):
        c.drop(t)
    comp = c.cut(c.components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more).union(far)), "components")
    of = reps.join(comp, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("comp", "rep").alias("comp"))
    has = base.select("doc_id", "n_shingles", "set_key").filter("doc_id is not null and set_key is not null").join(of, "set_key", "left").select("doc_id", "n_shingles", "comp")
    alone = base.filter("doc_id is null or set_key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("comp"))
    out = has.unionByName(alone)
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), F.coalesce(F.coalesce("comp", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
