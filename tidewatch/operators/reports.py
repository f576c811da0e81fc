"""What a viewer asks for: lists as of an hour, search, facets, shares, remainders, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def as_of(campaigns: DataFrame, hour: int, fresh: int = 6) -> DataFrame:
    """Campaigns detected by an hour, with ``is_new`` for those of the last hours."""
    return campaigns.filter(F.col("first_detected") <= hour).withColumn("is_new", F.col("first_detected") > hour - fresh)


def matches(query: str, text: Column, camp: Column) -> Column:
    """All terms of a query occur in the text, or name the campaign as c12 or #12."""
    out = F.lit(True)
    for t in query.lower().split():
        hit = F.lower(text).contains(t)
        if t[0] in "c#" and t[1:].isdigit():
            hit = hit | (camp == int(t[1:]))
        out = out & hit
    return out


def with_others(rows: DataFrame, key: str, n: str, k: int) -> DataFrame:
    """The k largest keys, and the rest as ``others``: (key, n, members, share)."""
    r = rows.withColumn("tw_r", F.row_number().over(W.orderBy(F.desc(n), key)))
    g = r.withColumn("key", F.when(F.col("tw_r") <= k, F.col(key)).otherwise("others")).groupBy("key").agg(F.sum(n).alias("n"), F.count("*").alias("members"))
    return g.select("key", "n", "members", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))


def largest_remainder(rows: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """(key, part): whole parts of a total in proportion to n, left-over ones by largest fraction."""
    x = F.col(n) * total / F.sum(n).over(W.partitionBy())
    r = rows.select(F.col(key).alias("key"), x.alias("x")).withColumn("low", F.floor("x"))
    left = F.lit(total) - F.sum("low").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.desc(F.round(F.col("x") - F.col("low"), 9)), "key"))
    return r.withColumn("left", left).withColumn("r", rank).select("key", (F.col("low") + (F.col("r") <= F.col("left")).cast("bigint")).alias("part"))


def tail(rows: DataFrame, n: str) -> DataFrame:
    """(size, ccdf): the share of rows of each size or more, from counts per size."""
    g = rows.groupBy(F.col(n).alias("size")).agg(F.count("*").alias("k"))
    at = F.sum("k").over(W.orderBy(F.desc("size")))
    return g.select("size", (at / F.sum("k").over(W.partitionBy())).alias("ccdf"))
