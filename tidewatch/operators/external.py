"""An external per-packet scan tested among the window's sources: bots per slice, as-of views, replay of updates, thresholds and event statistics (Q12, Q13, Q18, SM11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import bitmap


def bots(packets: DataFrame, t0: int, hours: int, slice_bits: int = 19, least: int = 2) -> DataFrame:
    """FIL14, AG6, AG30, AG31: (slice, src, pk, nact, words, cc, dmode, t_prof) of the sources that send ``least`` packets and more to a slice in [t0, t0 + hours): country of the first packet, modal destination (most packets, then earliest), time of the second packet.

    The range of t is a plain comparison, so files sorted by t are pruned. packets: (t, src, cc, dst24, slice).
    """
    x = packets.filter((F.col("t") >= t0) & (F.col("t") < t0 + hours * 3600)).withColumn("h", F.floor((F.col("t") - t0) / 3600)).withColumn("off", F.col("dst24").bitwiseAND(F.lit((1 << slice_bits) - 1)))
    g = x.groupBy("slice", "src").agg(F.count("*").alias("pk"), bitmap.day_words(F.col("h"), -(-hours // 24)).alias("words"), F.min(F.struct("t", "dst24", "cc")).alias("first")).filter(F.col("pk") >= least)
    per = x.groupBy("slice", "src", "off").agg(F.count("*").alias("n"), F.min("t").alias("t")).groupBy("slice", "src").agg(F.min(F.struct((-F.col("n")).alias("n"), "t", "off")).alias("m"))
    second = x.withColumn("r", F.row_number().over(W.partitionBy("slice", "src").orderBy("t", "dst24"))).filter("r <= 2").filter("r = 2").select("slice", "src", F.col("t").alias("t_prof"))
    return g.join(per, ["slice", "src"]).join(second, ["slice", "src"]).select("slice", "src", "pk", bitmap.popcount(F.col("words")).cast("bigint").alias("nact"), "words", F.col("first.cc").alias("cc"), F.col("m.off").alias("dmode"), "t_prof")


def as_of(p: DataFrame, n: int) -> DataFrame:
    """FIL15, JN18, PRJ4: profiles as they stand after n hours: hours from n on cleared, sources without any dropped, nact counted anew; ``words`` cut to the trailing whole days."""
    days = n // 24
    seen = p.withColumn("seen", bitmap.first_hours(F.col("words"), n)).withColumn("nact", bitmap.popcount(F.col("seen")).cast("bigint")).filter("nact > 0")
    return seen.withColumn("words", trailing(F.col("seen"), n - 24 * days, days)).drop("seen")


def trailing(words: Column, off: int, days: int) -> Column:
    """PRJ4: a window's hours from ``off`` on, as ``days`` day words: bits move down by ``off`` within and across days."""
    q, r = divmod(off, 24)
    here = F.slice(words, q + 1, days)
    after = F.slice(F.concat(words, F.array(F.lit(0))), q + 2, days)
    if not r:
        return here
    high = F.lit((1 << 24) - 1)
    return F.zip_with(here, after, lambda a, b: F.call_function("shiftright", a, F.lit(r)).bitwiseOR(F.call_function("shiftleft", F.coalesce(b, F.lit(0)), F.lit(24 - r)).bitwiseAND(high)).cast("int"))


def bh_threshold(family: DataFrame, p: str, q: float) -> DataFrame:
    """WN9: one row (tau): the largest p that BH would pass if it were added to a family of tests. K q / (n + 1), K being the largest k such that k - 1 of the family are at or below k q / (n + 1)."""
    w = W.orderBy(p)
    r = family.select(F.col(p).alias("p"), F.row_number().over(w).alias("i"), F.count("*").over(W.partitionBy()).alias("n"))
    # the k-th place of the joint family is open if the (k-1)-th smallest p is at most k q / (n + 1)
    fits = r.filter(F.col("p") <= (F.col("i") + 1) * q / (F.col("n") + 1)).agg(F.max(F.col("i") + 1).alias("k"))
    n = family.agg(F.count("*").alias("n"))
    return n.crossJoin(fits).select((F.coalesce("k", F.lit(1)) * q / (F.col("n") + 1)).alias("tau"))


def flag_rates(tests: DataFrame, tau: float, tau_rot: float, by: list[str]) -> DataFrame:
    """AG23, Q13: groups, residue, tested and testable ones, shares flagged at the thresholds, unadjusted rates, medians. tests: (*by, residue, testable, p, p_rot)."""
    t = ~F.col("residue")
    rate = lambda c, x: F.avg(F.when(t, (F.col(c) < x).cast("double")))
    return tests.groupBy(*by).agg(
        F.count("*").alias("groups"), F.count_if("residue").alias("residue"), F.count_if(t).alias("tested"), F.avg(F.when(t, F.col("testable").cast("double"))).alias("testable"), F.avg(F.when(t, (F.col("p") <= tau).cast("double"))).alias("flag"), F.avg(F.when(t, (F.col("p_rot") <= tau_rot).cast("double"))).alias("flag_rot"),
        rate("p", 0.05).alias("raw05"), rate("p", 0.01).alias("raw01"), rate("p_rot", 0.05).alias("raw05_rot"), rate("p_rot", 0.01).alias("raw01_rot"), F.median(F.when(t, F.col("p"))).alias("p_med"), F.median(F.when(t, F.col("p_rot"))).alias("p_rot_med"),
    )


def residue_event(p: DataFrame, members: DataFrame, residue: DataFrame) -> DataFrame:
    """Q11: one row: sources, those in residue, the most that share a modal destination, the most whose only active hour is the same."""
    bad = members.join(residue.filter("residue").select("camp"), "camp", "left_semi").select("src")
    top = p.filter("dmode >= 0").groupBy("dmode").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("top_dest_sources"))
    one = p.filter("nact = 1").groupBy("hfirst").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("single_hour_max"))
    return p.agg(F.count("*").alias("sources")).crossJoin(p.join(bad, "src", "left_semi").agg(F.count("*").alias("residue"))).crossJoin(top).crossJoin(one)


def phases(timeline: DataFrame, day: int = 6, fall: float = 0.9, rise: float = 10.0, idle: tuple[int, int] = (8, 11)) -> DataFrame:
    """WN12, WN11: one row of an hourly series(h, y): onset (first hour), decline (first hour of a day below ``fall`` of the same hour the day before), restart and stop (first hour after the next day above ``rise`` idle medians, and the end of the last such), idle level, peak."""
    y = timeline.select("h", "y").withColumn("before", F.lag("y", 24).over(W.orderBy("h")))
    level = y.filter((F.col("h") >= 24 * idle[0]) & (F.col("h") < 24 * idle[1])).agg(F.median("y").alias("idle"))
    x = y.crossJoin(F.broadcast(level))
    on = (F.col("h") >= 24 * (day + 1)) & (F.col("y") > rise * F.col("idle"))
    return x.agg(
        F.min("h").alias("onset"), F.min(F.when((F.col("h") >= 24 * day) & (F.col("h") < 24 * (day + 1)) & (F.col("y") < fall * F.col("before")), F.col("h"))).alias("decline"), F.min(F.when(on, F.col("h"))).alias("restart"), (F.max(F.when(on, F.col("h"))) + 1).alias("stop"), F.max("idle").alias("idle"), F.max("y").alias("peak"),
    )


def onset_stats(rows: DataFrame, slices: int, least: int = 10) -> DataFrame:
    """Q18: one row of updates(ev, s, h, n, testable, flag, small_flag): of the onset's updates the first with a campaign in some slice, how many slices have one and how many are flagged then, the first with all flagged, the last with one testable, the share of small groups flagged."""
    r = rows.filter("ev = 'onset'").withColumn("camp", F.col("n") >= least)
    first = r.filter("camp").agg(F.min("h").alias("h1"))
    by = r.groupBy("h").agg(F.count("*").alias("k"), F.count_if(F.col("camp") & F.col("flag")).alias("hit"), F.count_if("camp").alias("camps"), F.max("testable").alias("testable"))
    then = by.join(first, by.h == first.h1).select("h1", F.col("camps").alias("camps_first"), F.col("hit").alias("flag_first"))
    rest = by.agg(F.min(F.when((F.col("k") == slices) & (F.col("hit") == slices), F.col("h"))).alias("h_all"), F.max(F.when(F.col("testable"), F.col("h"))).alias("last_testable_h"))
    return then.crossJoin(rest).crossJoin(r.agg(F.avg(F.col("small_flag").cast("double")).alias("small_window")))


def series(rows: DataFrame, flag: str) -> DataFrame:
    """AG23: (ev, h, share): the share of slices flagged at each update."""
    return rows.groupBy("ev", "h").agg(F.avg(F.col(flag).cast("double")).alias("share"))


def equivalence(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Q20: (field, rows, same): how many rows of two results agree in each field, matched by key; a row that one lacks agrees in none."""
    j = a.select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(True).alias("in_a")).join(b.select(key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(True).alias("in_b")), key, "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    same = F.array(*[F.struct(F.lit(f).alias("field"), (both & F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).alias("same")) for f in fields])
    return j.select(F.explode(same).alias("x")).groupBy("x.field").agg(F.count("*").alias("rows"), F.count_if("x.same").alias("same"))
