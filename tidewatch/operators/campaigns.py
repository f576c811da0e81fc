"""Blocks and campaigns: membership, residue, landscape, signature, drift, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import bitmap


def blocks(p: DataFrame, min_size: int) -> DataFrame:
    """(src, camp, key): sources by port and fingerprint, blocks of min_size and more, numbered by key. Only the list of blocks is ordered globally."""
    key = F.concat(F.lit("p"), F.col("top1").cast("string"), F.lit("‖"), F.col("fpc").cast("string"))
    keyed = p.select("src", key.alias("key"))
    sized = keyed.groupBy("key").count().filter(F.col("count") >= min_size)
    ids = sized.select("key", F.row_number().over(W.orderBy("key")).alias("camp"))
    return keyed.join(ids, "key").select("src", "camp", "key")


def top(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group with counts, smallest value on ties."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), value))).filter(F.col("rank") <= k)


def residue(flows: DataFrame, members: DataFrame, least: int, share: float) -> DataFrame:
    """(camp, valid, top_dst, conv, residue): how many members' modal destination is the same one. Ties: most records, then the smallest."""
    per = flows.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("pk").alias("pk"))
    modal = per.groupBy("src").agg(F.max_by("dst", F.struct("n", "pk", -F.col("dst"))).alias("dmode"))
    d = members.join(modal, "src").groupBy("camp", "dmode").agg(F.count("*").alias("n"))
    g = d.groupBy("camp").agg(F.sum("n").alias("valid"), F.max_by("dmode", F.struct("n", -F.col("dmode"))).alias("top_dst"), F.max("n").alias("most"))
    conv = F.when(F.col("valid") >= least, F.col("most") / F.col("valid")).otherwise(F.lit(0.0))
    return g.select("camp", "valid", "top_dst", conv.alias("conv"), ((F.col("valid") >= least) & (conv >= share)).alias("residue"))


def landscape(p: DataFrame, members: DataFrame) -> DataFrame:
    m = members.join(p, "src")
    return m.groupBy("camp", "key").agg(
        F.count("*").alias("bots"), F.expr("mode(pm, true)").alias("proto"), F.median("pph").alias("pph_med"), F.sum("pk").alias("pk_sum"), F.median("span").alias("span_med"),
        F.min("hfirst").alias("hfirst_min"), F.max("hlast").alias("hlast_max"), F.count_distinct("cc").alias("n_cc"), F.count_distinct("asn").alias("n_asn"), F.percentile("duty", 0.9).alias("duty_p90"), F.expr("mode(org, true)").alias("top_org"),
    )


def hourly_active(p: DataFrame, members: DataFrame) -> DataFrame:
    """(camp, h, active, share): members active in each hour."""
    m = members.join(p.select("src", "words"), "src")
    size = members.groupBy("camp").agg(F.count("*").alias("m"))
    e = m.select("camp", F.explode(bitmap.hours(F.col("words"))).alias("h")).groupBy("camp", "h").agg(F.count("*").alias("active"))
    return e.join(F.broadcast(size), "camp").select("camp", "h", "active", (F.col("active") / F.col("m")).alias("share"))


def kth_onset(p: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(camp, first_detected): the hour in which the k-th member began, or the last if there are fewer."""
    r = members.join(p.select("src", "hfirst"), "src").withColumn("r", F.row_number().over(W.partitionBy("camp").orderBy("hfirst", "src")))
    return r.filter(F.col("r") <= k).groupBy("camp").agg(F.max("hfirst").alias("first_detected"))


def onset_bursts(p: DataFrame, members: DataFrame, hours: int, w: int, censor: int) -> DataFrame:
    """(camp, h, k): members that begin within w hours from h on, onsets in the first hours left out."""
    on = members.join(p.select("src", "hfirst"), "src").filter(F.col("hfirst") >= censor).groupBy("camp", F.col("hfirst").alias("h")).agg(F.count("*").alias("n"))
    spread = on.select("camp", F.explode(F.sequence(F.greatest(F.col("h") - w + 1, F.lit(censor).cast("bigint")), F.least(F.col("h"), F.lit(hours - w).cast("bigint")))).alias("h"), "n")
    return spread.groupBy("camp", "h").agg(F.sum("n").alias("k"))


def drift(p: DataFrame, days: int) -> DataFrame:
    """One row: share of sources seen on one day and on all, next-day persistence, sources per day."""
    on = [(F.get("words", d) != 0).cast("int") for d in range(days)]
    n = sum(on[1:], on[0])
    return p.agg(
        F.count("*").alias("sources"), F.avg((n == 1).cast("double")).alias("one_day"), F.avg((n == days).cast("double")).alias("all_days"),
        *[(F.sum(on[d] * on[d + 1]) / F.greatest(F.sum(on[d]), F.lit(1))).alias(f"stay{d}") for d in range(days - 1)], *[F.sum(on[d]).alias(f"day{d}") for d in range(days)],
    )


def port_drift(p: DataFrame, days: int, least: int) -> DataFrame:
    """(top1, cv, peak): how unevenly a port's sources spread over days."""
    d = p.select("top1", F.posexplode("words").alias("d", "w")).groupBy("top1", "d").agg(F.sum((F.col("w") != 0).cast("int")).alias("n"))
    g = d.groupBy("top1").agg(F.sum("n").alias("total"), (F.stddev_samp("n") / F.avg("n")).alias("cv"), (F.max("n") / F.avg("n")).alias("peak"))
    return g.filter(F.col("total") >= least)
