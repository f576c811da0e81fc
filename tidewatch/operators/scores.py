"""Scores of a clustering against known classes, from the contingency table alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def clustering_scores(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: ari, homogeneity, completeness, v_measure, nmi, b3_precision, b3_recall."""
    c = contingency(rows, truth, pred)
    a, b = c.groupBy("t").agg(F.sum("n").alias("nt")), c.groupBy("p").agg(F.sum("n").alias("np"))
    j = c.join(a, "t").join(b, "p")
    choose = lambda x: x * (x - 1) / 2
    ct = j.agg(F.sum("n").alias("n"), F.sum(choose(F.col("n"))).alias("sij"), F.sum(F.col("n") * F.log(F.col("n") / F.col("np"))).alias("htp"), F.sum(F.col("n") * F.log(F.col("n") / F.col("nt"))).alias("hpt"),
               F.sum(F.col("n") * F.col("n") / F.col("np")).alias("bp"), F.sum(F.col("n") * F.col("n") / F.col("nt")).alias("br"))
    st = a.agg(F.sum(choose(F.col("nt"))).alias("si"), F.sum(F.col("nt") * F.log("nt")).alias("lt"))
    sp = b.agg(F.sum(choose(F.col("np"))).alias("sj"), F.sum(F.col("np") * F.log("np")).alias("lp"))
    r = ct.join(st).join(sp)
    n = F.col("n")
    ht, hp = F.log(n) - F.col("lt") / n, F.log(n) - F.col("lp") / n
    hom = F.when(ht <= 0, 1.0).otherwise(1 + F.col("htp") / n / ht)
    com = F.when(hp <= 0, 1.0).otherwise(1 + F.col("hpt") / n / hp)
    expect = F.col("si") * F.col("sj") / choose(n)
    return r.select(((F.col("sij") - expect) / ((F.col("si") + F.col("sj")) / 2 - expect)).alias("ari"), hom.alias("homogeneity"), com.alias("completeness"), F.coalesce(F.try_divide(2 * hom * com, hom + com), F.lit(0.0)).alias("v_measure"),
                    ((ht + F.col("htp") / n) / ((ht + hp) / 2)).alias("nmi"), (F.col("bp") / n).alias("b3_precision"), (F.col("br") / n).alias("b3_recall"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve by rank sums over distinct scores, ties counted half."""
    g = rows.groupBy(score).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) == 0).cast("bigint")).alias("neg"))
    from pyspark.sql import Window as W

    below = F.sum("neg").over(W.orderBy(score).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("neg")
    return g.withColumn("below", below).agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
