"""Do a campaign's members act together? Co-activity against two nulls, with multiple-testing control.

Draws come from a reproducible hash of (source, draw number, seed), so a test is
a chain of joins: pairs (at most ``pairs`` a campaign) x draws, never members x members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config
from ..functions import bitmap, scalar
from .stage import stage


def member_pairs(members: DataFrame, most: int, seed: int) -> DataFrame:
    """(camp, a, b): all pairs of a campaign, or ``most`` random ones where there are more."""
    m = members.select("camp", "src", (F.row_number().over(W.partitionBy("camp").orderBy("src")) - 1).cast("bigint").alias("o"))
    n = members.groupBy("camp").agg(F.count("*").alias("n"))
    few = n.filter(F.col("n") * (F.col("n") - 1) / 2 <= most).select("camp")
    small = m.join(few, "camp", "left_semi")
    x, y = small.alias("x"), small.alias("y")
    every = x.join(y, (F.col("x.camp") == F.col("y.camp")) & (F.col("x.o") < F.col("y.o"))).select(F.col("x.camp").alias("camp"), F.col("x.src").alias("a"), F.col("y.src").alias("b"))
    d = n.filter(F.col("n") * (F.col("n") - 1) / 2 > most).select("camp", "n", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("d"))
    d = d.select("camp", scalar.draw(F.col("camp") * 7919 + F.col("d").cast("bigint") * 104729 + seed, F.col("n")).alias("i"), scalar.draw(F.col("camp") * 7919 + F.col("d").cast("bigint") * 104729 + seed + 50_000_017, F.col("n")).alias("j")).filter("i <> j")
    some = d.join(m.select("camp", F.col("o").alias("i"), F.col("src").alias("a")), ["camp", "i"]).join(m.select("camp", F.col("o").alias("j"), F.col("src").alias("b")), ["camp", "j"]).select("camp", "a", "b")
    return every.unionByName(some)


def coactivity(pairs: DataFrame, p: DataFrame) -> DataFrame:
    w = p.select("src", "words")
    j = pairs.join(w.select(F.col("src").alias("a"), F.col("words").alias("wa")), "a").join(w.select(F.col("src").alias("b"), F.col("words").alias("wb")), "b")
    return j.groupBy("camp").agg(F.count("*").alias("n_pairs"), F.avg(bitmap.jaccard(F.col("wa"), F.col("wb"))).alias("coact"))


def verdict(draws: DataFrame, obs: DataFrame, name: str) -> DataFrame:
    """(camp, p_<name>, z_<name>) from draws(camp, b, t): exact Monte-Carlo p, and a z-score, 0 where the null has no spread."""
    g = draws.join(F.broadcast(obs.select("camp", "coact")), "camp").groupBy("camp").agg(
        ((F.count_if(F.col("t") >= F.col("coact") - 1e-12) + 1) / (F.count("*") + 1)).alias(f"p_{name}"), F.avg("t").alias("mu"), F.stddev_pop("t").alias("sd"), F.max("coact").alias("coact"))
    return g.select("camp", f"p_{name}", F.when(F.col("sd") < 1e-9, 0.0).otherwise((F.col("coact") - F.col("mu")) / F.col("sd")).alias(f"z_{name}"))


def rotation_null(pairs: DataFrame, p: DataFrame, obs: DataFrame, b: int, days: int, seed: int, unit: int | None = None) -> DataFrame:
    """ST6: each member's hours turned by a random number of units (whole days in windows of two days and more, hours in shorter ones).

    Turned alike, two members share as many hours as before, so a draw's likeness is
    that of one member turned by the difference: those are worked out once a pair,
    and a draw only looks up its own. Draws multiply rows after the last shuffle of
    pairs and meet again in a partial average.
    """
    unit = unit or (24 if days >= 2 else 1)
    most = max(2, days * 24 // unit)
    w = p.select("src", "words")
    x = pairs.select("camp", "a", F.col("b").alias("c"))
    x = x.join(w.select(F.col("src").alias("a"), F.col("words").alias("wa")), "a").join(w.select(F.col("src").alias("c"), F.col("words").alias("wc")), "c")
    turn = lambda w, by: bitmap.rotate_days(w, by) if unit == 24 else bitmap.rotate_hours(w, by * unit)
    by_difference = F.transform(F.sequence(F.lit(1 - most), F.lit(most - 1)), lambda by: bitmap.jaccard(F.col("wa"), turn(F.col("wc"), by)))
    x = x.select("camp", "a", "c", by_difference.alias("j")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(b))))
    off = lambda s: scalar.draw(F.col(s) * 7919 + F.col("b").cast("bigint") * 104729 + seed, most)
    return verdict(x.groupBy("camp", "b").agg(F.avg(F.get("j", (off("c") - off("a") + (most - 1)).cast("int"))).alias("t")), obs, "rot")


def peer_counts(p: DataFrame, members: DataFrame, ratio: float) -> DataFrame:
    """(camp, port, m, peers, testable): members, and sources of the campaign's port outside it."""
    port = members.join(p.select("src", "top1"), "src").groupBy("camp").agg(F.expr("mode(top1, true)").alias("port"), F.count("*").alias("m"))
    pop = p.groupBy(F.col("top1").alias("port")).agg(F.count("*").alias("pop"))
    own = members.join(p.select("src", "top1"), "src").join(port, "camp").groupBy("camp").agg(F.sum((F.col("top1") == F.col("port")).cast("bigint")).alias("own"))
    out = port.join(pop, "port").join(own, "camp").withColumn("peers", F.col("pop") - F.col("own"))
    return out.select("camp", "port", "m", "peers", (F.col("peers") >= F.col("m") * ratio).alias("testable"))


#: Slots that sources of a stratum are numbered in, so that numbering is spread over tasks.
SLOTS = 64
#: Draws of a peer at most, as members of the campaign itself are drawn anew.
TRIES = 9


def numbered(p: DataFrame, by: list[str]) -> DataFrame:
    """(*by, r, peer): the sources of each stratum numbered from 0 on by (src mod SLOTS, src). A stratum's slots are numbered apart and shifted by the counts of the slots before."""
    q = p.withColumn("slot", F.pmod("src", F.lit(SLOTS)))
    n = q.groupBy(*by, "slot").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.sum("n").over(W.partitionBy(*by).orderBy("slot").rowsBetween(W.unboundedPreceding, -1))).select(*by, "slot", F.coalesce("before", F.lit(0)).alias("before"))
    q = q.withColumn("i", F.row_number().over(W.partitionBy(*by, "slot").orderBy("src")) - 1).join(before, [*by, "slot"])
    return q.select(*by, (F.col("i") + F.col("before")).cast("bigint").alias("r"), F.col("src").alias("peer"))


def _per_bin(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """(*by, name): how many rows of each activity bin, as an array."""
    return rows.groupBy(*by).agg(F.array(*[F.count_if(F.col("bin") == k) for k in range(BINS)]).alias(name))


BINS = 7


def peer_tiers(p: DataFrame, members: DataFrame, min_pool: int, country: bool = False) -> DataFrame:
    """(camp, [cc,] bin, port, tier, n, counts): for each activity bin of a campaign's members the first tier that has enough peers, from counts alone (JN11, JN12).

    Tiers: the same bin (1), one less (2), one more (3), those three (4), any on the
    port (5; needs no minimum). With ``country`` there is a row for each (camp, cc,
    bin), and before those come four tiers within the country: the same bin (-3),
    one less (-2), one more (-1), any bin (0). n: peers that are not members;
    counts: sources of each bin that a draw takes from, members included.
    """
    own = ["cc"] if country else []
    q = p.select("src", F.col("top1").alias("port"), *own, scalar.activity_bin(F.col("nact")).alias("bin"))
    m = members.select("src", "camp").join(q, "src")
    port = m.groupBy("camp").agg(F.expr("mode(port, true)").alias("port"))
    m = m.withColumnRenamed("port", "at").join(port, "camp").withColumn("same", F.col("at") == F.col("port"))
    strata = m.select("camp", *own, "bin", "port").distinct()
    mine = m.filter("same")
    out = strata.join(_per_bin(q, ["port"], "all"), "port").join(_per_bin(mine, ["camp"], "own"), "camp", "left")
    none = F.array(*[F.lit(0).cast("bigint")] * BINS)
    if country:
        out = out.join(_per_bin(q, ["port", "cc"], "all_cc"), ["port", "cc"], "left").join(_per_bin(mine, ["camp", "cc"], "own_cc"), ["camp", "cc"], "left")
    i = F.sequence(F.lit(0), F.lit(BINS - 1))
    found = []
    for base, first in ((("all_cc", "own_cc"), -3), (("all", "own"), 1)) if country else ((("all", "own"), 1),):
        every, own_ = (F.coalesce(x, none) for x in base)
        for tier, test in ((first, lambda k: k == F.col("bin")), (first + 1, lambda k: k == F.col("bin") - 1), (first + 2, lambda k: k == F.col("bin") + 1), *([] if first < 0 else [(4, lambda k: F.abs(k - F.col("bin")) <= 1)]), (0 if first < 0 else 5, lambda k: k >= 0)):
            only = lambda x, test=test: F.zip_with(x, i, lambda n, k: F.when(test(k), n).otherwise(F.lit(0).cast("bigint")))
            counts = only(every)
            free = F.aggregate(only(F.zip_with(every, own_, lambda x, y: x - y)), F.lit(0).cast("bigint"), lambda a, x: a + x)
            found.append(F.struct(F.lit(tier).alias("tier"), free.alias("n"), counts.alias("counts")))
    pick = F.filter(F.array(*found), lambda x: (x["n"] >= min_pool) | (x["tier"] == 5))[0]
    return out.select("camp", *own, "bin", "port", pick.alias("x")).select("camp", *own, "bin", "port", "x.*")


def country_fallback(p: DataFrame, members: DataFrame, tiers: DataFrame, tested: DataFrame) -> DataFrame:
    """(camp, members, fallback, majority): members of the campaigns in ``tested`` whose country has too few peers on the port, and whether most of a campaign's are such (ST21)."""
    got = tiers.filter("tier <= 0").select("camp", "cc", "bin").withColumn("own", F.lit(True))
    m = members.join(tested.select("camp"), "camp", "left_semi").join(p.select("src", "cc", scalar.activity_bin(F.col("nact")).alias("bin")), "src").join(got, ["camp", "cc", "bin"], "left")
    g = m.groupBy("camp").agg(F.count("*").alias("members"), F.count_if(F.col("own").isNull()).alias("fallback"))
    return g.withColumn("majority", F.col("fallback") * 2 > F.col("members"))


def drawn_peers(used: DataFrame, p: DataFrame, members: DataFrame, tiers: DataFrame, b: int, seed: int) -> DataFrame:
    """(camp, src, b, peer) for used(camp, src, [cc,] bin): for each draw a random source of the stratum's tier, drawn anew while it is a member of the campaign, TRIES times at most (the last stands).

    A drawn number is a bin of the tier and a place in it; places are looked up in
    numbered(), so no row per candidate exists.
    """
    own = ["cc"] if "cc" in tiers.columns else []
    q = p.select("src", F.col("top1").alias("port"), *own, scalar.activity_bin(F.col("nact")).alias("at"))
    at = tiers.filter(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x) > 0)
    zero = F.lit(0).cast("bigint")
    # Where each bin ends among the numbers drawn, worked out once a stratum: a draw only compares.
    ends = F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda k: F.aggregate(F.slice("counts", F.lit(1), k), zero, lambda a, x: a + x))
    u = used.join(at.withColumn("ends", ends), ["camp", *own, "bin"])
    u = u.select("camp", "src", "port", *own, "tier", "ends", F.get("ends", BINS - 1).alias("total"), F.explode(F.sequence(F.lit(1), F.lit(b))).alias("b"))
    lists = {False: numbered(q, ["port", "at"])}
    if own:
        lists[True] = numbered(q, ["port", "cc", "at"])

    def looked_up(rows: DataFrame) -> DataFrame:
        g = scalar.draw(F.col("src") * 7919 + F.col("b").cast("bigint") * 104729 + F.col("try") * 50_000_017 + seed + 1, F.col("total"))
        # Never null, or the joins would filter by these expressions, with the draw copied into each comparison.
        rows = rows.withColumn("g", g).withColumn("at", F.coalesce(sum(((F.col("g") >= F.get("ends", k)).cast("int") for k in range(BINS)), F.lit(0)), F.lit(-1)))
        rows = rows.withColumn("r", F.coalesce(F.col("g") - F.when(F.col("at") > 0, F.get("ends", F.col("at") - 1)).otherwise(zero), F.lit(-1).cast("bigint"))).drop("g", "ends")
        out = rows.filter("tier > 0").join(lists[False], ["port", "at", "r"])
        if own:
            out = out.drop("cc").unionByName(rows.filter("tier <= 0").join(lists[True], ["port", "cc", "at", "r"]).drop("cc"))
        out = out.join(members.select("camp", F.col("src").alias("peer"), F.lit(True).alias("member")), ["camp", "peer"], "left")
        return out.select("camp", "src", "b", "try", "peer", F.coalesce("member", F.lit(False)).alias("member"))

    one = stage(looked_up(u.withColumn("try", F.lit(0).cast("bigint"))), "peers-first")
    again = u.join(one.filter("member").select("camp", "src", "b"), ["camp", "src", "b"], "left_semi").withColumn("try", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(TRIES - 1).cast("bigint"))))
    more = looked_up(again).groupBy("camp", "src", "b").agg(F.min_by("peer", F.struct("member", F.when(F.col("member"), -F.col("try")).otherwise(F.col("try")))).alias("peer"))
    return one.filter("not member").select("camp", "src", "b", "peer").unionByName(more)


def population_null(pairs: DataFrame, p: DataFrame, members: DataFrame, tiers: DataFrame, obs: DataFrame, b: int, seed: int) -> DataFrame:
    """ST7: each member replaced by a random peer of its stratum (of its country's, where tiers have a country)."""
    own = [k for k in ("cc",) if k in tiers.columns]
    q = p.select("src", "words", *own, scalar.activity_bin(F.col("nact")).alias("bin"))
    used = pairs.select("camp", F.col("a").alias("src")).union(pairs.select("camp", "b")).distinct().join(q.select("src", *own, "bin"), "src")
    got = drawn_peers(used, p, members, tiers, b, seed).join(q.select(F.col("src").alias("peer"), "words"), "peer").select("camp", "src", "b", "words")
    x = pairs.select("camp", "a", F.col("b").alias("c"))
    j = x.join(got.select("camp", F.col("src").alias("a"), "b", F.col("words").alias("wa")), ["camp", "a"]).join(got.select("camp", F.col("src").alias("c"), "b", F.col("words").alias("wc")), ["camp", "c", "b"])
    return verdict(j.groupBy("camp", "b").agg(F.avg(bitmap.jaccard(F.col("wa"), F.col("wc"))).alias("t")), obs, "pop")


def refine(null, pairs: DataFrame, obs: DataFrame, name: str, draws: list[int], screens: list[float], seed: int) -> DataFrame:
    """verdict() rows, tested anew with more, fresh draws where p is small: draws[k+1] draws for the campaigns whose p after draws[k] is at most screens[k].

    ``null(pairs, obs, draws, seed)`` gives the rows of one test. Each pass is written, as the next one reads it twice, and covers only the pairs of the campaigns left; one that no campaign is left for is not run.
    """
    out = stage(null(pairs, obs, draws[0], seed), f"{name}-0")
    for k, (b, most) in enumerate(zip(draws[1:], screens, strict=True), 1):
        left = out.filter(F.col(f"p_{name}") <= most).select("camp")
        if left.isEmpty():
            continue
        again = stage(null(pairs.join(left, "camp", "left_semi"), obs.join(left, "camp", "left_semi"), b, seed + 1000 * k), f"{name}-{k}")
        out = out.join(again, "camp", "left_anti").unionByName(again)
    return out


def step_up(tests: DataFrame, p: str, q: float, by: list[str] | None = None, harmonic: bool = False) -> DataFrame:
    """tests with ``passed``: Benjamini-Hochberg, or with ``harmonic`` Benjamini-Yekutieli, over all rows or per group. Tests are campaigns, not sources."""
    w = W.partitionBy(*(by or [F.lit(1)]))
    k, n = F.row_number().over(w.orderBy(p)), F.count("*").over(w)
    rows = tests.withColumn("tw_k", k).withColumn("tw_n", n)
    scale = F.aggregate(F.sequence(F.lit(1), F.col("tw_n").cast("int")), F.lit(0.0), lambda s, i: s + 1 / i) if harmonic else F.lit(1.0)
    rows = rows.withColumn("tw_last", F.max(F.when(F.col(p) <= q * F.col("tw_k") / (F.col("tw_n") * scale), F.col("tw_k"))).over(w))
    return rows.withColumn("passed", F.coalesce(F.col("tw_k") <= F.col("tw_last"), F.lit(False))).drop("tw_k", "tw_n", "tw_last")


def decide(p: DataFrame, members: DataFrame, cfg: Config, days: int = 7) -> DataFrame:
    """Both nulls, the larger p, and what passes: one row a campaign. Untestable ones enter with p = 1."""
    pairs = stage(member_pairs(members, cfg.pairs, cfg.seed), "pairs")
    obs = stage(coactivity(pairs, p), "coactivity")
    test = peer_counts(p, members, cfg.peer_ratio)
    rot = stage(rotation_null(pairs, p, obs, cfg.draws, days, cfg.seed), "rotation")
    pop = stage(population_null(pairs, p, members, stage(peer_tiers(p, members, cfg.min_pool), "tiers"), obs, cfg.draws, cfg.seed), "population")
    t = test.join(obs, "camp", "left").join(rot, "camp", "left").join(pop, "camp", "left")
    ok = F.col("testable") & F.col("p_pop").isNotNull()
    t = t.withColumn("p_pop", F.when(ok, F.col("p_pop")).otherwise(1.0)).withColumn("z_pop", F.when(ok, F.col("z_pop")).otherwise(0.0)).withColumn("p", F.greatest("p_rot", "p_pop"))
    return step_up(t, "p", cfg.q).withColumnRenamed("passed", "orchestrated")


def decide_staged(p: DataFrame, members: DataFrame, residue: DataFrame, cfg: Config, days: int = 7, slices: int = 32, residue_peers: bool = False) -> DataFrame:
    """The whole test: decide() with p refined in both nulls, peers of the members' countries, and residue left out.

    ``residue`` (camp) lists campaigns whose members converge on one destination:
    they are not tested, enter no correction, and their sources are nobody's
    peers (``residue_peers`` admits them). They stand in the result with p = 1. A
    source may be in several campaigns. The pairs lie in ``slices`` files,
    as draws multiply each row up to ``draws3`` times.
    """
    bad = stage(members.join(residue.select("camp"), "camp", "left_semi"), "residue")
    p, tested = stage(p if residue_peers else p.join(bad, "src", "left_anti"), "peers"), stage(members.join(bad.select("camp").distinct(), "camp", "left_anti"), "tested")
    pairs = stage(member_pairs(tested, cfg.pairs, cfg.seed).repartition(slices), "pairs")
    obs = stage(coactivity(pairs, p), "coactivity")
    test = stage(peer_counts(p, tested, cfg.peer_ratio), "counts")
    tiers = stage(peer_tiers(p, tested, cfg.min_pool, country=True), "tiers")
    draws, screens = [cfg.draws, *[x for x in (cfg.draws2, cfg.draws3) if x]], [y for x, y in ((cfg.draws2, cfg.screen2), (cfg.draws3, cfg.screen3)) if x]
    rot = refine(lambda x, o, b, seed: rotation_null(x, p, o, b, days, seed), pairs, obs, "rot", draws, screens, cfg.seed)
    fit = test.filter("testable").select("camp")
    pop = refine(lambda x, o, b, seed: population_null(x, p, tested, tiers, o, b, seed), pairs.join(fit, "camp", "left_semi"), obs.join(fit, "camp", "left_semi"), "pop", draws, screens, cfg.seed)
    t = test.join(obs, "camp", "left").join(rot, "camp", "left").join(pop, "camp", "left").withColumn("residue", F.lit(False))
    t = t.fillna(1.0, ["p_rot", "p_pop"]).fillna(0.0, ["coact", "z_rot", "z_pop"]).withColumn("p", F.greatest("p_rot", "p_pop"))
    t = t.withColumn("z", F.least("z_rot", "z_pop"))
    out = step_up(step_up(t, "p", cfg.q).withColumnRenamed("passed", "orchestrated"), "p_rot", cfg.q).withColumnRenamed("passed", "orchestrated_rot")
    out = out.select("camp", "residue", "testable", "coact", "p_rot", "z_rot", "p_pop", "z_pop", "p", "z", "orchestrated", "orchestrated_rot")
    one, none, no = F.lit(1.0), F.lit(0.0), F.lit(False)
    left = bad.select("camp").distinct().select("camp", F.lit(True).alias("residue"), no.alias("testable"), none.alias("coact"), one.alias("p_rot"), none.alias("z_rot"), one.alias("p_pop"), none.alias("z_pop"), one.alias("p"), none.alias("z"), no.alias("orchestrated"), no.alias("orchestrated_rot"))
    return out.unionByName(left)
