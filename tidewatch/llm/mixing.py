"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Total size is cut into blocks of ``block`` words. Sources get blocks by highest
quotients target / (2k + 1), then the shards of a source share its blocks the
same way by their sizes. Within a shard documents lie in seeded order on a line
of words; the shard's integer quota is so many whole passes over its blocks and
a seeded selection of the rest.

The driver holds one row per source and per shard: at most ``SHARDS`` shards and
``SOURCES`` sources, both checked. A hot source has as many shards as its rows
ask for, so it is spread like any other.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _common as c

#: The weights of sources, by code point, repeating; the most a source is repeated.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents of a shard at least, and shards at most (besides one per source).
SHARD_ROWS, SHARDS, SOURCES = 500, 50_000, 100_000
#: Words of a block at most; smaller for small inputs, so that a source is met to a thousandth of the mean source.
BLOCK = 256


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Shares of the total by weight; a target stops at most * size and its excess goes to the others by weight, until none is above."""
    total, fixed, free = sum(sizes), {}, set(range(len(sizes)))
    while free:
        left, w = total - sum(fixed.values()), sum(weights[i] for i in free)
        over = [i for i in free if Fraction(left * weights[i], w) > most * sizes[i]]
        if not over:
            break
        for i in over:
            fixed[i] = most * sizes[i]
            free.discard(i)
    left, w = total - sum(fixed.values()), sum(weights[i] for i in free)
    return [float(fixed[i]) if i in fixed else float(Fraction(left * weights[i], w)) for i in range(len(sizes))]


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2k + 1), first entry on ties, none above its most.

    The bulk comes from one divisor (votes / d rounded down to just under the
    final count), the last seats one by one from a heap, so it costs the number
    of entries, not of seats.
    """
    most = most or [seats] * len(votes)
    seats = min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))
    lo, hi = 0.0, 2 * max(votes, default=0) + 1
    v, m = np.array(votes, float), np.array(most, float)
    at = lambda d: np.where(v > 0, np.minimum(m, np.floor(v / d + 0.5)), 0)
    for _ in range(200):
        mid = (lo + hi) / 2
        if at(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    got = [max(0, int(x) - 1) for x in at(hi)]
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and got[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source) -> (doc_id, size, source, source_size, target, taken, block, shard, quota, first_word).

    size: words of the text (null: 0). The sum of taken of a source differs from
    its target by about a block; no document is taken more than ``most`` times
    its size. The same rows and seed give the same result, whatever their order
    or partitions. Rows that repeat a doc_id are separate documents of the mix;
    full repeats share one place in the order by their number. A source without
    words has target 0. An empty table gives an empty result. More than
    ``SOURCES`` sources raise ValueError.
    """
    spark = docs.sparkSession
    rows = c.cut(docs.select(F.col("doc_id").cast("long"), "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(c.WORD)).cast("long").alias("size"), F.xxhash64("text").alias("h")), "sizes")
    of = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(SOURCES + 1).collect()
    if len(of) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    of.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in of]
    total, n = sum(sizes), sum(r.n for r in of)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(of))], most)
    block = max(1, min(block, total // (1000 * max(1, len(of)))))
    per = max(SHARD_ROWS, -(-n // SHARDS))
    names = spark.createDataFrame([(r.source, i, -(-r.n // per), goal[i], r["size"]) for i, r in enumerate(of)], "source string, s int, shards long, target double, source_size long")
    rows = rows.join(F.broadcast(names), rows["source"].eqNullSafe(names["source"])).drop(names["source"])
    order = F.xxhash64(F.lit(seed), "doc_id", "h")
    rows = rows.withColumn("order", order).withColumn("shard", F.pmod(F.col("order"), F.col("shards")))
    cells = rows.groupBy("s", "shard").agg(F.sum("size").alias("size")).collect()
    cells.sort(key=lambda r: (r.s, r.shard))
    blocks = [-(-r["size"] // block) for r in cells]
    by: dict[int, list[int]] = {}
    for k, r in enumerate(cells):
        by.setdefault(r.s, []).append(k)
    room = [most * sum(blocks[k] for k in by.get(i, ())) for i in range(len(of))]
    seats = sainte_lague(goal, round(sum(goal) / block), room)
    quota = {}
    for i, ks in by.items():
        for k, q in zip(ks, sainte_lague([cells[k]["size"] for k in ks], seats[i], [most * blocks[k] for k in ks]), strict=True):
            quota[k] = q
    plan = spark.createDataFrame([(r.s, r.shard, blocks[k], quota[k]) for k, r in enumerate(cells)], "s int, shard long, blocks long, quota long")
    line = W.partitionBy("s", "shard").orderBy("order", "doc_id", "h")
    rows = rows.withColumn("first_word", F.sum("size").over(line.rowsBetween(W.unboundedPreceding, -1))).fillna(0, ["first_word"])
    rows = rows.join(F.broadcast(plan), ["s", "shard"]).withColumn("seed", F.pmod(F.xxhash64(F.lit(seed), "s", "shard"), F.lit(1 << 30)))
    out = rows.withColumn("passes", F.expr(PASSES.format(b=block)))
    taken = F.expr(f"aggregate(passes, 0L, (a, p) -> a + p.times * (least(first_word + size, (p.block + 1) * {block}L) - greatest(first_word, p.block * {block}L)))")
    return out.select("doc_id", "size", "source", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"), F.lit(block).alias("block"), "first_word", "passes", "h")


#: Blocks that a document touches and how often each is taken: whole passes, and one more for those that a seeded walk over the shard's blocks reaches first.
#: (j * a + c) mod blocks, a prime above any number of blocks and so a permutation.
PASSES = """if(size > 0, transform(sequence(first_word div {b}L, (first_word + size - 1) div {b}L),
 j -> struct(j as block, quota div blocks + if(pmod((j % blocks) * (2147483647L % blocks) + seed, blocks) < quota % blocks, 1L, 0L) as times)), array())"""


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each pass over a document, its text the words that this pass takes.

    A pass that takes a whole document keeps its text as it is; else the words
    taken are joined by single spaces. n_chars, if there, is that of the new text.
    Documents of which nothing is taken, those without words among them, go.
    """
    got = mix(docs.select("doc_id", "text", "source"), **kw).withColumn("most", F.array_max(F.transform("passes", lambda p: p["times"]))).filter("taken > 0")
    got = got.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "h", "source").orderBy("first_word")))
    got = got.select("doc_id", "h", "first_word", "passes", "block", "size", F.explode(F.sequence(F.lit(1), F.col("most").cast("int"))).alias("pass"), "copy", F.col("source").alias("src"))
    whole_row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", F.xxhash64("text").alias("h"))
    numbered = whole_row.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "h", "source").orderBy(F.lit(1))))
    both = numbered.alias("d").join(got.alias("g"), (F.col("d.doc_id").eqNullSafe(F.col("g.doc_id"))) & (F.col("d.h") == F.col("g.h")) & (F.col("d.copy") == F.col("g.copy")) & F.col("d.source").eqNullSafe(F.col("g.src")))
    runs = F.expr("filter(g.passes, p -> p.times >= g.pass)")
    words = F.regexp_extract_all("d.text", F.lit(f"({c.WORD})"), F.lit(1))
    part = F.expr("""array_join(flatten(transform(taken_runs, p -> slice(words, int(greatest(p.block * block, first_word) - first_word) + 1,
        int(least((p.block + 1) * block, first_word + size) - greatest(p.block * block, first_word))))), ' ')""")
    both = both.select("d.row", "d.text", "g.block", "g.first_word", "g.size", runs.alias("taken_runs"), F.size("g.passes").alias("all"))
    whole = F.size("taken_runs") == F.col("all")
    both = both.withColumn("words", F.when(~whole, words)).withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return both.select(*[own.get(x, F.col("row").getField(x)).alias(x) for x in docs.columns])
