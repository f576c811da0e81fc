"""Linking clusterings over time by shared members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def overlaps(members: DataFrame, keep: int, threshold: float) -> DataFrame:
    """members(day, camp, src) -> (day, camp, next_camp, common, jaccard): of each campaign the ``keep`` campaigns of the next day with most shared members, those of jaccard >= threshold."""
    size = members.groupBy("day", "camp").agg(F.count("*").alias("m"))
    nxt = members.select((F.col("day") - 1).alias("day"), F.col("camp").alias("next_camp"), "src")
    n = members.join(nxt, ["day", "src"]).groupBy("day", "camp", "next_camp").agg(F.count("*").alias("common"))
    r = n.withColumn("r", F.row_number().over(W.partitionBy("day", "camp").orderBy(F.desc("common"), "next_camp"))).filter(F.col("r") <= keep)
    r = r.join(size, ["day", "camp"]).join(size.select((F.col("day") - 1).alias("day"), F.col("camp").alias("next_camp"), F.col("m").alias("next_m")), ["day", "next_camp"])
    return r.withColumn("jaccard", F.col("common") / (F.col("m") + F.col("next_m") - F.col("common"))).filter(F.col("jaccard") >= threshold).select("day", "camp", "next_camp", "common", "jaccard")


def tracks(members: DataFrame, links: DataFrame) -> DataFrame:
    """(day, camp, length): tracks by where they begin; links are taken by jaccard, each campaign continued once and continuing one.

    The links of a window are few (some per campaign and day), so they are folded on the driver.
    """
    spark = members.sparkSession
    after: dict[tuple, tuple] = {}
    taken: set[tuple] = set()
    for r in sorted(links.collect(), key=lambda r: (-r.jaccard, r.day, r.camp, r.next_camp)):
        a, b = (r.day, r.camp), (r.day + 1, r.next_camp)
        if a not in after and b not in taken:
            after[a] = b
            taken.add(b)
    rows = []
    for d, k in sorted((r.day, r.camp) for r in members.select("day", "camp").distinct().collect()):
        if (d, k) not in taken:
            n, at = 1, (d, k)
            while at in after:
                at, n = after[at], n + 1
            rows.append((d, k, n))
    return spark.createDataFrame(rows, "day bigint, camp bigint, length bigint")
