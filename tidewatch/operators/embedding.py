"""The embedding baseline: word vectors of sentences, a graph of nearest neighbours, communities of it (EM2-EM4, JN13, MX21)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config
from ..functions import scalar
from .stage import stage

#: Rows of a block: two blocks are compared by one matrix product.
BLOCK = 1024
#: Settings of the sensitivity study: the published ones, and each varied alone (MX21). Fixed values.
DEFAULTS = {"services": 10, "min_packets": 10, "window": 25, "dim": 50, "knn": 3, "resolution": 1.0}
VARIED = {"services": (5, 20), "min_packets": (5, 20), "window": (10, 50), "dim": (25, 100), "knn": (5, 7), "resolution": (0.5,)}


def settings() -> list[dict]:
    """MX21: twelve settings, the default first."""
    return [dict(DEFAULTS), *[DEFAULTS | {k: v} for k, vs in VARIED.items() for v in vs]]


def word_vectors(sentences: DataFrame, dim: int = 50, window: int = 25, epochs: int = 5, least: int = 1, seed: int = 7, parts: int = 1) -> DataFrame:
    """EM2: (word, vector) of sentences(words: array<string>), by Spark ML's skip-gram. It trains by hierarchical softmax where the baseline samples negatives: the same model, another loss."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=dim, windowSize=window, maxIter=epochs, minCount=least, seed=seed, numPartitions=parts, inputCol="words", outputCol="v", maxSentenceLength=100_000).fit(sentences.select("words"))
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def neighbours(vectors: DataFrame, k: int) -> DataFrame:
    """JN13: (u, v, w): for each of vectors(id long, vector) its k nearest others by cosine, those above 0, ties to the smaller id.

    Block against block: a block of 1024 vectors meets every other in one row of the
    plan and leaves its k best there, so rows grow with blocks squared, no pair is a
    row, and a task holds two blocks. Zero vectors have no neighbours.
    """
    parts = max(1, -(-vectors.count() // BLOCK))
    at = vectors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).groupBy("b").agg(F.collect_list(F.struct("id", F.col("vector").cast("array<double>").alias("v"))).alias("g"))
    at = stage(at, "blocks")
    left = at.select(F.col("g").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("b"))

    def run(batches):
        import pyarrow as pa

        def unit(col, i):
            part = col.values.slice(col.offsets[i].as_py(), col.offsets[i + 1].as_py() - col.offsets[i].as_py())
            m = part.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            return part.field("id").to_numpy(zero_copy_only=False), m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)

        for batch in batches:
            for i in range(len(batch)):
                (a, x), (b, y) = unit(batch.column("x"), i), unit(batch.column("y"), i)
                s = np.round(x @ y.T, 12)
                s[a[:, None] == b[None, :]] = -2
                order = np.lexsort((np.broadcast_to(b, s.shape), -s), axis=1)[:, :k]
                top = np.take_along_axis(s, order, 1).ravel()
                ok = top > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a, order.shape[1])[ok]), pa.array(b[order].ravel()[ok]), pa.array(top[ok])], ["u", "v", "w"])

    best = left.join(at.select("b", F.col("g").alias("y")), "b").select("x", "y").mapInArrow(run, "u long, v long, w double")
    return best.withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("w"), "v"))).filter(F.col("r") <= k).select("u", "v", "w")


def graph(vectors: DataFrame, k: int) -> DataFrame:
    """EM3: (u, v, w), u < v: the undirected graph of nearest neighbours, the larger weight of the two directions."""
    n = neighbours(vectors, k)
    return n.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("w").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Newman's modularity of labels(node, c) on edges(u, v, w); loops count once."""
    total = edges.agg(F.sum("w")).first()[0] or 0.0
    if not total:
        return 0.0
    both = edges.select("u", "w").union(edges.select("v", "w")).groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")).join(labels, "node").groupBy("c").agg(F.sum("k").alias("k"))
    a, b = labels.select(F.col("node").alias("u"), F.col("c").alias("a")), labels.select(F.col("node").alias("v"), F.col("c").alias("b"))
    inside = edges.join(a, "u").join(b, "v").filter("a = b").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    return inside / total - resolution * (both.agg(F.sum(F.pow(F.col("k") / (2 * total), F.lit(2.0)))).first()[0] or 0.0)


def _moved(edges: DataFrame, degree: DataFrame, total: float, resolution: float, rounds: int) -> DataFrame:
    """Louvain's local moves as joins: in each round half of the nodes, by hash, go to the neighbouring community of most gain (ties: the smaller)."""
    both = stage(edges.filter("u <> v").select("u", "v", "w").union(edges.filter("u <> v").select("v", "u", "w")), "both")
    label = stage(degree.select("node", F.col("node").alias("c")), "labels")
    still = 0
    for r in range(rounds):
        sums = label.join(degree, "node").groupBy("c").agg(F.sum("k").alias("tot"))
        turn = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
        near = both.join(label.select(F.col("node").alias("v"), "c"), "v").groupBy(F.col("u").alias("node"), "c").agg(F.sum("w").alias("in"))
        own = label.withColumnRenamed("c", "now").join(degree, "node").filter(turn)
        cand = near.union(label.select("node", "c", F.lit(0.0).alias("in"))).groupBy("node", "c").agg(F.sum("in").alias("in")).join(own, "node").join(sums, "c")
        rest = F.col("tot") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("in") - resolution * F.col("k") * rest / (2 * total), 12)
        best = cand.withColumn("gain", gain).groupBy("node").agg(F.max(F.struct("gain", (F.col("c") == F.col("now")).alias("stays"), (-F.col("c")).alias("c"))).alias("x")).select("node", (-F.col("x.c")).alias("to"))
        new = stage(label.join(best, "node", "left").select("node", F.coalesce("to", "c").alias("c")), "labels")
        moved = new.join(label.withColumnRenamed("c", "was"), "node").filter("c <> was").limit(1).count()
        label, still = new, 0 if moved else still + 1
        if still >= 4:
            break
    return label


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 24, levels: int = 6) -> DataFrame:
    """EM4: (node, c) by Louvain's method: local moves, then the same on the graph of communities, until no level changes anything. c is the smallest node of its community.

    Every step is a join or a partial aggregate; the driver holds counts only.
    """
    total = edges.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    label = stage(ends.select("node", F.col("node").alias("c")), "labels")
    now = edges
    for _ in range(levels if total else 0):
        degree = stage(now.select(F.col("u").alias("node"), "w").union(now.select("v", "w")).groupBy("node").agg(F.sum("w").alias("k")), "degrees")
        moved = _moved(now, degree, total, resolution, rounds)
        if moved.select("c").distinct().count() == moved.count():
            break
        label = stage(label.join(moved.select(F.col("node").alias("c"), F.col("c").alias("to")), "c").select("node", F.col("to").alias("c")), "labels")
        a, b = moved.select(F.col("node").alias("u"), F.col("c").alias("a")), moved.select(F.col("node").alias("v"), F.col("c").alias("b"))
        now = stage(now.join(a, "u").join(b, "v").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w")), "merged")
    least = label.groupBy("c").agg(F.min("node").alias("least"))
    return label.join(least, "c").select("node", F.col("least").alias("c"))


def labels(found: DataFrame, least: int) -> DataFrame:
    """EM4: (node, label): communities numbered by size, then smallest node; -1 for those of under ``least`` members. Only the list of communities is ordered."""
    size = found.groupBy("c").agg(F.count("*").alias("n"))
    no = size.filter(F.col("n") >= least).select("c", (F.row_number().over(W.orderBy(F.desc("n"), "c")) - 1).cast("bigint").alias("label"))
    return found.join(no, "c", "left").select("node", F.coalesce("label", F.lit(-1)).alias("label"))


def purity(members: DataFrame, value: str, least: int = 1) -> DataFrame:
    """AG24, Q17: one row: clusters, and the median over clusters of the share of their most frequent value."""
    n = members.groupBy("camp", value).agg(F.count("*").alias("n")).groupBy("camp").agg(F.max("n").alias("most"), F.sum("n").alias("all")).filter(F.col("all") >= least)
    return n.agg(F.count("*").alias("clusters"), F.median(F.col("most") / F.col("all")).alias("purity_median"), F.sum("all").alias("covered"))


def seed_order(id_: str, cfg: Config = Config()):  # noqa: ANN201, B008
    """SO7: a reproducible random order of ids."""
    return scalar.draw(F.col(id_) * 7919 + cfg.seed, scalar.M31)
