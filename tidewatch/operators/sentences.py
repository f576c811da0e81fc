"""Sentences of sources for embeddings: who contacted a service in an hour, in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sentences(hours: DataFrame, ports: DataFrame, n_services: int = 10, min_packets: int = 10, most: int = 5, longest: int = 1000) -> DataFrame:
    """(service, h, part, words) from hours(h, src, t0, t1, pk) and ports(h, src, port, n).

    A source needs min_packets packets; the n_services ports that most source-hours
    use are services 0, 1, ... (smallest port on ties), all others share one. A source
    stands in a sentence as often as its share of the hour's packets says, once at
    least and ``most`` times at most, spread evenly over its time. Sentences are cut
    after ``longest`` words, so a service with a third of all words fills no single row.
    """
    keep = hours.groupBy("src").agg(F.sum("pk").alias("total")).filter(F.col("total") >= min_packets).select("src")
    used = ports.join(keep, "src", "left_semi")
    best = used.groupBy("port").agg(F.count("*").alias("pop")).orderBy(F.desc("pop"), "port").limit(n_services)
    service = best.select("port", (F.row_number().over(W.orderBy(F.desc("pop"), "port")) - 1).alias("service"))
    share = used.withColumn("of", F.sum("n").over(W.partitionBy("h", "src"))).join(hours.select("h", "src", "t0", "t1", "pk"), ["h", "src"]).join(F.broadcast(service), "port", "left")
    times = F.least(F.lit(most), F.greatest(F.lit(1), F.bround(F.col("pk") * F.col("n") / F.col("of")).cast("int")))
    timed = (F.col("t1") >= F.col("t0")) & (F.col("t0") > 0)
    lo, hi = F.when(timed, F.col("t0")).otherwise(F.col("h") * 3600), F.when(timed, F.col("t1")).otherwise(F.col("h") * 3600 + 3599)
    words = share.select(F.coalesce("service", F.lit(n_services)).alias("service"), "h", "src", times.alias("k"), lo.alias("lo"), hi.alias("hi")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("i") + 0.5) / F.col("k")
    placed = words.select("service", "h", "src", at.alias("at")).withColumn("pos", F.row_number().over(W.partitionBy("service", "h").orderBy("at", "src")) - 1)
    cut = placed.groupBy("service", "h", F.floor(F.col("pos") / longest).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", "src"))).alias("w"))
    return cut.select("service", "h", "part", F.transform("w", lambda x: x["src"]).alias("words"))
