"""Reduction per source and hour, mergeable accumulation per source, and profiles.

Every aggregate is partial (bit_or, sums, minima, maps summed in two levels), so
batch, incremental and repartitioned runs agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import bitmap


def reduce_hours(flows: DataFrame) -> DataFrame:
    """One row per source and hour. Attributes are those of the first record (by id)."""
    per_port = flows.groupBy("h", "src", "port").agg(
        F.bit_or("pmask").alias("pm"), F.count("*").alias("n"), F.sum("pk").alias("pk"), F.sum("bytes").alias("bytes"), F.min(F.nullif("t", F.lit(0))).alias("t0"), F.max("t").alias("t1"),
        F.min(F.struct("id", "cc", "asn", "org")).alias("first"),
    )
    return per_port.groupBy("h", "src").agg(
        F.bit_or("pm").alias("pmask"), F.sum("n").alias("nrec"), F.count("*").alias("nports"), F.sum("pk").alias("pk"), F.sum("bytes").alias("bytes"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
        F.min("first").alias("first"), F.map_from_entries(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "port"))), 1, 5), lambda s: F.struct(s["port"], -s["k"]))).alias("topports"),
    ).select("h", "src", "pmask", "nrec", "nports", "pk", "bytes", "t0", "t1", F.col("first.cc").alias("cc"), F.col("first.asn").alias("asn"), F.col("first.org").alias("org"), "topports")


def accumulate(hours: DataFrame, days: int = 7) -> DataFrame:
    """One row per source from source-hour rows: sums, first attributes, day words, packets by hour, the most frequent port (smallest on ties)."""
    ports = hours.select("src", F.explode("topports").alias("port", "n")).groupBy("src", "port").agg(F.sum("n").alias("n"))
    ports = ports.groupBy("src").agg(F.max_by("port", F.struct("n", -F.col("port"))).alias("top1"), F.count("*").alias("nports"))
    base = hours.groupBy("src").agg(
        F.bit_or("pmask").alias("pm"), F.sum("nrec").alias("nrec"), F.sum("pk").alias("pk"), F.sum("bytes").alias("bytes"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
        bitmap.day_words(F.col("h"), days).alias("words"), F.min("h").alias("hfirst"), F.max("h").alias("hlast"), F.map_from_entries(F.collect_list(F.struct("h", "pk"))).alias("hour_pk"), F.min(F.struct("h", "cc", "asn", "org")).alias("first"),
    )
    return base.join(ports, "src").select("src", "pm", "nrec", "nports", "top1", "pk", "bytes", "t0", "t1", "words", "hfirst", "hlast", "hour_pk", F.col("first.cc").alias("cc"), F.col("first.asn").alias("asn"), F.col("first.org").alias("org"))


def series(acc: DataFrame) -> DataFrame:
    """acc with x: packets of each hour from the first to the last active one."""
    return acc.withColumn("x", F.transform(F.sequence("hfirst", "hlast"), lambda h: F.coalesce(F.try_element_at("hour_pk", h), F.lit(0)).cast("double")))


def profile(acc: DataFrame) -> DataFrame:
    """Statistics of each source. Undefined ones are null."""
    p = series(acc).withColumn("nact", bitmap.popcount(F.col("words"))).withColumn("span", F.col("hlast") - F.col("hfirst") + 1)
    n = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / n
    p = p.withColumn("mean", mean)
    var = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v) / n - F.col("mean") * F.col("mean")
    return p.select(
        "src", "pm", "nrec", "nports", "top1", "pk", "bytes", "words", "nact", "span", "hfirst", "hlast", (F.col("nact") / F.col("span")).alias("duty"), (F.col("pk") / F.greatest("nact", F.lit(1))).alias("pph"),
        F.when((n >= 3) & (F.col("mean") > 0), var / F.col("mean")).alias("fano"), "cc", "asn", "org", (F.col("asn") % 2).alias("fpc"), "x",
    )


def runs(p: DataFrame) -> DataFrame:
    """Wald-Wolfowitz runs of the series about its median, values equal to it dropped: (src, n1, n2, runs, z); z null where a side has under 2."""
    e = p.filter(F.size("x") >= 6).select("src", F.posexplode("x").alias("i", "v"))
    mid = e.groupBy("src").agg(F.expr("median(v)").alias("med"))
    e = e.join(mid, "src").filter("v <> med").withColumn("up", F.col("v") > F.col("med"))
    e = e.withColumn("turn", (F.col("up") != F.lag("up").over(W.partitionBy("src").orderBy("i"))).cast("int"))
    g = e.groupBy("src").agg(F.sum(F.col("up").cast("int")).alias("n1"), F.sum((~F.col("up")).cast("int")).alias("n2"), (F.coalesce(F.sum("turn"), F.lit(0)) + 1).alias("runs"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    mu, var = 2 * n1 * n2 / n + 1, 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
    return g.withColumn("z", F.when((F.col("n1") >= 2) & (F.col("n2") >= 2) & (var > 0), (F.col("runs") - mu) / F.sqrt(var)))


def mann_kendall(p: DataFrame, value: str = "x") -> DataFrame:
    """(src, s, z) of the Mann-Kendall trend with tie correction and continuity, for series of 4 values and more."""
    a = F.col(value)
    idx = F.sequence(F.lit(1), F.size(a))
    s = F.aggregate(idx, F.lit(0.0), lambda t, j: t + F.aggregate(F.slice(a, F.lit(1), j - 1), F.lit(0.0), lambda u, v: u + F.signum(F.element_at(a, j) - v)))
    ties = F.aggregate(F.transform(F.array_distinct(a), lambda v: F.size(F.filter(a, lambda y: y == v)).cast("double")), F.lit(0.0), lambda t, k: t + k * (k - 1) * (2 * k + 5))
    q = p.filter(F.size(a) >= 4).select("src", s.alias("s"), F.size(a).cast("double").alias("n"), ties.alias("ties"))
    var = (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("ties")) / 18
    return q.select("src", F.col("s").cast("bigint").alias("s"), F.when(var > 0, F.when(F.col("s") == 0, 0.0).otherwise((F.col("s") - F.signum("s")) / F.sqrt(var))).alias("z"))


def dispersion(flows: DataFrame) -> DataFrame:
    """(src, n, entropy, ru): normalised entropy of the sources' destination /24s, for 4 records and more."""
    per = flows.groupBy("src", F.shiftright("dst", 8).alias("d24")).agg(F.count("*").alias("k"))
    g = per.groupBy("src").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("kl")).filter("n >= 4")
    ent = F.log("n") - F.col("kl") / F.col("n")
    return g.select("src", "n", ent.alias("entropy"), (ent / F.log("n")).alias("ru"))


def chi_square(flows: DataFrame, d_size: int) -> DataFrame:
    """(src, n, bins, chi2) of destinations over equal bins, min(16, max(2, n div 5)) of them, for 10 records and more."""
    n = flows.groupBy("src").agg(F.count("*").alias("n")).filter("n >= 10").withColumn("bins", F.least(F.lit(16), F.greatest(F.lit(2), F.floor(F.col("n") / 5))).cast("int"))
    b = flows.join(n, "src").groupBy("src", "n", "bins", F.floor(F.col("dst") * F.col("bins") / d_size).alias("b")).agg(F.count("*").alias("k"))
    return b.groupBy("src", "n", "bins").agg((F.sum(F.col("k") * F.col("k")) * F.col("bins") / F.col("n") - F.col("n")).alias("chi2"))
