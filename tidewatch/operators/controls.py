"""Negative controls and robustness checks of the synchrony test (ST17-ST24, ST28): what it says where nothing is orchestrated, and how much it hangs on its settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config
from ..functions import bitmap, scalar
from . import inference, synchrony
from .stage import stage


def pseudo_campaigns(p: DataFrame, members: DataFrame, tested: DataFrame, seed: int, country: bool = False) -> DataFrame:
    """(camp, src): for each campaign in ``tested`` as many unrelated sources of its port as it has members, with ``country`` of its members' most frequent country too (ST17, ST18).

    The sources of a port are numbered; a walk from a drawn start, by a step that has
    no factor in common with their number, meets each once. Its first members + own
    places hold members enough that aren't the campaign's, so no candidate list is
    made. Campaigns whose pool is too small are left out.
    """
    by = ["port", "cc"] if country else ["port"]
    q = p.select("src", F.col("top1").alias("port"), "cc")
    m = members.join(tested.select("camp"), "camp", "left_semi").select("camp", "src").join(q, "src")
    most = [F.expr("mode(port, true)").alias("port"), *[F.expr("mode(cc, true)").alias("cc")] * country]
    camp = m.groupBy("camp").agg(F.count("*").alias("m"), *most)
    own = m.join(camp.select("camp", *by), ["camp", *by], "left_semi").groupBy("camp").agg(F.count("*").alias("own"))
    pop = q.groupBy(*by).agg(F.count("*").alias("pop"))
    c = camp.join(pop, by).join(own, "camp", "left").fillna(0, ["own"]).filter(F.col("pop") - F.col("own") >= F.col("m"))
    walk = c.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") + F.col("own") - 1)))
    at = F.pmod(scalar.draw(F.col("camp") * 7919 + seed, F.col("pop")) + F.col("i") * F.pmod(F.lit(scalar.M31).cast("bigint"), F.col("pop")), F.col("pop"))
    found = walk.withColumn("r", at).join(synchrony.numbered(q, by), [*by, "r"]).select("camp", "m", "i", F.col("peer").alias("src")).join(members.select("camp", "src"), ["camp", "src"], "left_anti")
    return found.withColumn("k", F.row_number().over(W.partitionBy("camp").orderBy("i"))).filter(F.col("k") <= F.col("m")).select("camp", "src")


def negative_control(p: DataFrame, members: DataFrame, decisions: DataFrame, cfg: Config, seed: int = 11, country: bool = False) -> tuple[DataFrame, DataFrame]:
    """(decisions, skipped) of pseudo-campaigns through the identical test; ``decisions`` in: (camp, residue, testable). Residue is nobody's peer; pseudo-campaigns that converge on one address are skipped."""
    bad = members.join(decisions.filter("residue").select("camp"), "camp", "left_semi").select("src")
    q = stage(p.join(bad, "src", "left_anti"), "control-peers")
    pseudo = stage(pseudo_campaigns(q, members, decisions.filter("testable and not residue"), seed, country), "pseudo")
    conv = stage(inference.convergence(q, pseudo, cfg), "pseudo-convergence")
    rest = pseudo.join(conv.filter("not residue").select("camp"), "camp", "left_semi")
    none = conv.select("camp").filter(F.lit(False))
    return stage(synchrony.decide_staged(q, stage(rest, "pseudo-tested"), none, cfg), "control"), conv.filter("residue").select("camp")


def raw_rates(tests: DataFrame, floor: float) -> DataFrame:
    """ST24: one row: tests, how many pass, unadjusted rejection rates, and how many p-values lie at the least value that so many draws allow."""
    rate = lambda c, a: F.avg((F.col(c) < a).cast("double"))
    return tests.agg(
        F.count("*").alias("tests"), F.count_if(F.col("orchestrated")).alias("flagged"), F.count_if(F.col("orchestrated_rot")).alias("flagged_rot"), F.avg(F.col("orchestrated").cast("double")).alias("rate"),
        *[rate(c, a).alias(f"{n}_lt_{str(a)[2:]}") for c, n in (("p", "p"), ("p_rot", "p_rot")) for a in (0.05, 0.01)], *[F.count_if(F.col(c) <= floor + 1e-12).alias(f"{c}_floor") for c in ("p", "p_rot")],
    )


def ratio_diagnostic(p: DataFrame, members: DataFrame, ratios: list[float], keys: dict[str, Column]) -> DataFrame:
    """ST19: (key, ratio, campaigns, testable, share): how many campaigns have peers enough, by what counts as their port and how many peers a member needs."""
    out = None
    for name, key in keys.items():
        q = p.select("src", key.alias("top1"))
        for ratio in ratios:
            one = synchrony.peer_counts(q, members, ratio).agg(F.lit(name).alias("key"), F.lit(float(ratio)).alias("ratio"), F.count("*").alias("campaigns"), F.count_if("testable").alias("testable"), F.avg(F.col("testable").cast("double")).alias("share"))
            out = one if out is None else out.unionByName(one)
    return out


def resampled(p: DataFrame, hours: int, seed: int = 17) -> DataFrame:
    """ST20, SO8: (src, words): each source's active hours redrawn without replacement, as many as before, in proportion to its port's activity in each hour.

    The draw is a Gumbel top-k: an hour's key is the log of its weight plus a reproducible
    Gumbel variable; a source ranks its own hours, at most as many as the window has.
    """
    e = p.select("src", "top1", "nact", F.explode(bitmap.hours(F.col("words"))).alias("h"))
    weight = e.groupBy("top1", "h").agg(F.count("*").alias("w"))
    grid = p.select("top1").distinct().crossJoin(p.sparkSession.range(hours).select(F.col("id").alias("h"))).join(weight, ["top1", "h"], "left").select("top1", "h", F.log(F.coalesce("w", F.lit(0)) + 1e-3).alias("logw"))
    per_port = grid.groupBy("top1").agg(F.array_sort(F.collect_list(F.struct("h", "logw"))).alias("profile"))
    x = p.select("src", "top1", "nact").join(per_port, "top1").select("src", "nact", F.explode("profile").alias("x")).select("src", "nact", "x.h", "x.logw")
    u = (scalar.draw(F.col("src") * 7919 + F.col("h") * 104729 + seed, 999983) + 0.5) / 999983
    k = F.row_number().over(W.partitionBy("src").orderBy(F.round(F.col("logw") - F.log(-F.log(u)), 9).desc(), "h"))
    return x.withColumn("k", k).filter(F.col("k") <= F.col("nact")).groupBy("src").agg(bitmap.day_words(F.col("h"), hours // 24).alias("words"))


def fallback_undetermined(p: DataFrame, members: DataFrame, decisions: DataFrame, cfg: Config) -> DataFrame:
    """ST21: one row: testable campaigns most of whose members have too few peers of their country, orchestrated ones among them, and what BH passes when these count as undetermined (p = 1)."""
    tested = decisions.filter("testable and not residue")
    tiers = stage(synchrony.peer_tiers(p, members, cfg.min_pool, country=True), "tiers")
    major = synchrony.country_fallback(p, members, tiers, tested).filter("majority").select("camp", F.lit(True).alias("major"))
    t = decisions.filter("not residue").join(major, "camp", "left").withColumn("major", F.coalesce("major", F.lit(False))).withColumnRenamed("orchestrated", "was")
    again = synchrony.step_up(t.withColumn("p", F.when(F.col("major"), 1.0).otherwise(F.col("p"))), "p", cfg.q)
    return again.agg(F.count_if("major").alias("majority_fallback"), F.count_if(F.col("major") & F.col("was")).alias("majority_fallback_orchestrated"), F.count_if("was").alias("orchestrated"), F.count_if("passed").alias("orchestrated_after"))


def normal_against_empirical(decisions: DataFrame, q: float) -> DataFrame:
    """ST22: one row: decisions by normal p-values of the z-scores beside those by counted draws, their agreement and Jaccard index."""
    norm = lambda z: F.when(F.col(z) == 0, 1.0).otherwise(scalar.normal_tail(F.col(z)))
    t = decisions.filter("not residue").withColumn("p_norm", F.greatest(norm("z_rot"), F.when(F.col("testable"), norm("z_pop")).otherwise(1.0)))
    t = synchrony.step_up(t, "p_norm", q).withColumnRenamed("passed", "by_norm")
    both, either = F.col("orchestrated") & F.col("by_norm"), F.col("orchestrated") | F.col("by_norm")
    return t.agg(F.count("*").alias("campaigns"), F.count_if("orchestrated").alias("empirical"), F.count_if("by_norm").alias("normal"), F.avg((F.col("orchestrated") == F.col("by_norm")).cast("double")).alias("agreement"), (F.count_if(both) / F.greatest(F.count_if(either), F.lit(1))).alias("jaccard"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """ST23, SET3: one row of how two runs of decisions (camp, testable, orchestrated) differ."""
    j = a.select("camp", F.col("testable").alias("ta"), F.col("orchestrated").alias("oa")).join(b.select("camp", F.col("testable").alias("tb"), F.col("orchestrated").alias("ob")), "camp", "full")
    j = j.fillna(False)
    return j.agg(F.count("*").alias("campaigns"), F.count_if("ta").alias("testable_a"), F.count_if("tb").alias("testable_b"), F.count_if("oa").alias("orchestrated_a"), F.count_if("ob").alias("orchestrated_b"), F.count_if(F.col("oa") & F.col("ob")).alias("both"), F.count_if(F.col("oa") & ~F.col("ob")).alias("a_only"), F.count_if(~F.col("oa") & F.col("ob")).alias("b_only"))


def refined(tests: DataFrame, again: DataFrame, cut: float, q: float) -> DataFrame:
    """ST23: one row: a control's tests with p below ``cut`` replaced by those of ``again`` (camp, p), and what BH passes before and after."""
    t = tests.select("camp", "p", F.col("orchestrated").alias("was")).join(again.select("camp", F.col("p").alias("p2")), "camp", "left")
    small = (F.col("p") < cut) & F.col("p2").isNotNull()
    t = synchrony.step_up(t.withColumn("small", small).withColumn("p2", F.when(small, F.col("p2")).otherwise(F.col("p"))), "p2", q)
    return t.agg(F.count("*").alias("tests"), F.count_if("small").alias("refined"), F.count_if("was").alias("flagged_before"), F.count_if("passed").alias("flagged_after"), F.avg((F.col("p2") < 0.01).cast("double")).alias("p_lt_01_after"), F.min("p2").alias("min_p"))


def case_panels(p: DataFrame, members: DataFrame, camp: int, most: int, days: int, seed: int = 3) -> DataFrame:
    """ST28, SO4: (panel, place, src, onset, nact, words): the first ``most`` members of a campaign by hash, the same turned by whole days, as many peers of its port signature, and as many sources of its fingerprint elsewhere; rows by onset, then activity."""
    order = scalar.draw(F.col("src") * 7919 + seed, scalar.M31)
    own = members.filter(F.col("camp") == camp).select("src")
    mine = p.join(own, "src", "left_semi").orderBy(order, "src").limit(most).select("src", "words", "portsig", "fpc")
    far = p.join(own, "src", "left_anti")
    kind = mine.agg(F.expr("mode(portsig, true)").alias("sig"), F.expr("mode(fpc, true)").alias("tool"))
    turned = mine.withColumn("words", bitmap.rotate_days(F.col("words"), scalar.draw(F.col("src") * 7919 + seed + 1, days)))
    like = lambda name, test: far.crossJoin(F.broadcast(kind)).filter(test).orderBy(order, "src").limit(most).select(F.lit(name).alias("panel"), "src", "words")
    rows = mine.select(F.lit("observed").alias("panel"), "src", "words").unionByName(turned.select(F.lit("shifted").alias("panel"), "src", "words")).unionByName(like("peers", F.col("portsig") == F.col("sig"))).unionByName(like("cotooled", F.col("fpc") == F.col("tool")))
    rows = rows.withColumn("onset", F.array_min(bitmap.hours(F.col("words")))).withColumn("nact", bitmap.popcount(F.col("words")))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("panel").orderBy("onset", F.desc("nact"), "src"))).select("panel", "place", "src", "onset", "nact", "words")


def panel_coactivity(panels: DataFrame) -> DataFrame:
    """ST28: (panel, n, coact): mean Jaccard of all pairs of a panel's rows; a panel is a bounded sample."""
    a, b = panels.alias("a"), panels.alias("b")
    j = a.join(b, (F.col("a.panel") == F.col("b.panel")) & (F.col("a.place") < F.col("b.place"))).groupBy(F.col("a.panel").alias("panel")).agg(F.avg(bitmap.jaccard(F.col("a.words"), F.col("b.words"))).alias("coact"))
    return panels.groupBy("panel").agg(F.count("*").alias("n")).join(j, "panel", "left")
