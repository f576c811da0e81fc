"""From profiles to campaigns and decisions: features, blocks and modes, residue, onset bursts, signatures, landscape, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import Config
from . import cluster, synchrony
from .campaigns import top
from .stage import stage

#: Features by the group that an ablation drops (CL4). Fixed names.
FEATURES = {
    "rate": ["l_pph"], "coverage": ["l_ud"], "temporal": ["duty_f"], "dispersion": ["rho_c", "ru_c"], "strategy": ["frac_seq_c", "dir_seq_f", "st_seq_fwd", "st_seq_rev", "st_uperm", "st_perm"], "targets": ["l_nports"], "policy": ["ipinc_n", "spstable_n"],
}


def features(p: DataFrame) -> DataFrame:
    """SC34: p with the 14 clustering features. Absolute time is none of them, as synchrony is what is tested later."""
    log = lambda c, least: F.log10(F.greatest(F.col(c).cast("double"), F.lit(least)))
    undet = F.col("strategy") == "undet"
    half = lambda yes, some: F.when(yes, 1.0).when(some, 0.5).otherwise(0.0)
    return p.withColumns({
        "l_pph": log("pph", 1e-3), "l_ud": log("ud", 1.0), "duty_f": F.col("duty"), "rho_c": F.coalesce("rho", F.lit(0.5)), "ru_c": F.coalesce("ru", F.lit(0.5)), "frac_seq_c": F.coalesce("frac_seq", F.lit(0.0)), "dir_seq_f": F.col("dir_seq"), "l_nports": log("nports", 1.0),
        **{f"st_{s}": F.when(undet, 0.25).otherwise((F.col("strategy") == s).cast("double")) for s in ("seq_fwd", "seq_rev", "uperm", "perm")},
        "ipinc_n": half(F.col("ipid") == "ipinc", F.col("ipid").isin("ip1", "na")), "spstable_n": half(F.col("sportp").isin("spfix", "spnarrow"), F.col("sportp") == "sp1"),
    })


def used_features(drop: tuple[str, ...] = ()) -> list[str]:
    return [f for g, fs in FEATURES.items() if g not in drop for f in fs]


def standardised(p: DataFrame, names: list[str]) -> DataFrame:
    """SC35: the named columns as z-scores over all rows, by population standard deviation; 0 for a column of one value. One row of statistics is joined to all."""
    stat = p.agg(*[f(x).alias(f"{x}_{k}") for x in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {x: F.coalesce(F.try_divide(F.col(x) - F.col(f"{x}_m"), F.col(f"{x}_s")), F.lit(0.0)) for x in names}
    return p.crossJoin(F.broadcast(stat)).withColumns(z).drop(*stat.columns)


def block_key(drop: tuple[str, ...] = (), use_fp: bool = True) -> Column:
    """CL1: port signature and core fingerprint; without targets the fingerprint alone, without fingerprints ports (or protocols) alone."""
    fp = use_fp and "fingerprint" not in drop
    if "targets" in drop:
        return F.col("fpc") if fp else F.col("pm").cast("string")
    return F.concat("portsig", F.lit("‖"), "fpc") if fp else F.col("portsig")


def campaigns(p: DataFrame, cfg: Config, drop: tuple[str, ...] = (), use_fp: bool = True, use_modes: bool = True) -> DataFrame:
    """Q3, CL1-CL4: (src, key, mode, camp), members of campaigns: blocks of min_size and more, split into density modes, numbered by key and mode. Only the list of campaigns is ordered as a whole."""
    rows = p.withColumn("key", block_key(drop, use_fp))
    large = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= cfg.min_size).select("key")
    rows = rows.join(large, "key")
    if use_modes:
        names = used_features(drop)
        z = standardised(features(p), names).withColumn("key", block_key(drop, use_fp)).join(large, "key")
        found = cluster.split(z.select("src", "key", *names), names, cfg).filter("mode >= 0")
    else:
        found = rows.select("src", "key", F.lit(0).cast("bigint").alias("mode"))
    found = stage(found, "modes")
    size = found.groupBy("key", "mode").agg(F.count("*").alias("n")).filter(F.col("n") >= cfg.min_size)
    ids = size.select("key", "mode", F.row_number().over(W.orderBy("key", "mode")).cast("bigint").alias("camp"))
    return found.join(ids, ["key", "mode"]).select("src", "key", "mode", "camp")


def port_onset(p: DataFrame, min_size: int) -> DataFrame:
    """CL5: the baseline that groups sources by port signature and first hour."""
    key = F.concat("portsig", F.lit("|"), F.col("hfirst").cast("string"))
    rows = p.select("src", key.alias("key"))
    size = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_size)
    return rows.join(size.select("key", F.row_number().over(W.orderBy("key")).cast("bigint").alias("camp")), "key").select("src", "key", "camp")


def convergence(p: DataFrame, members: DataFrame, cfg: Config) -> DataFrame:
    """AG25: (camp, valid, top_dst, conv, residue): the share of members, of those that have one, whose modal destination is the most frequent one."""
    d = members.select("camp", "src").join(p.select("src", "dmode"), "src").filter("dmode >= 0").groupBy("camp", "dmode").agg(F.count("*").alias("n"))
    g = d.groupBy("camp").agg(F.sum("n").alias("valid"), F.max_by("dmode", F.struct("n", -F.col("dmode"))).alias("top_dst"), F.max("n").alias("most"))
    enough = F.col("valid") >= cfg.residue_members
    conv = F.when(enough, F.col("most") / F.col("valid")).otherwise(0.0)
    every = members.select("camp").distinct().join(g.select("camp", "valid", "top_dst", conv.alias("conv")), "camp", "left")
    return every.select("camp", F.coalesce("valid", F.lit(0)).alias("valid"), F.coalesce("top_dst", F.lit(-1)).alias("top_dst"), F.coalesce("conv", F.lit(0.0)).alias("conv"), (F.coalesce("conv", F.lit(0.0)) >= cfg.residue).alias("residue"))


def poisson_tail(k: Column, lam: Column) -> Column:
    """P(X >= k): the upper terms of the series, so that small tails keep their digits. Each term is worked out by itself: where they are too small for all digits of a double, multiples of a rounded first term go astray."""
    one = F.lit(1).cast("bigint")
    fact = F.aggregate(F.sequence(one, F.greatest(k, one)), F.lit(0.0), lambda t, i: t + F.log(i))
    start = F.struct(fact.alias("fact"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(k, k + (200 + 4 * lam).cast("bigint")), start, lambda a, j: F.struct((a["fact"] + F.log(j + 1)).alias("fact"), (a["sum"] + F.exp(j * F.log(lam) - lam - a["fact"])).alias("sum")))["sum"]
    return F.when(k <= 0, 1.0).otherwise(F.least(F.lit(1.0), tail))


def onset_bursts(p: DataFrame, keyed: DataFrame, hours: int, least: int, w: int = 3, censor: int = 2) -> DataFrame:
    """ST15, WN6: (key, h, k, z, p), windows of w hours in which unusually many of a block's sources begin.

    keyed: (src, key). A block's rate is the median of its onsets an hour, 0.25 at
    least; onsets of the first hours are left out, as these sources may be older.
    Of overlapping windows the one of smallest p stays (then the earliest): a fold
    over a block's windows, which are at most as many as hours.
    """
    on = keyed.join(p.select("src", "hfirst"), "src").filter(F.col("hfirst") >= censor).groupBy("key", F.col("hfirst").alias("h")).agg(F.count("*").alias("n"))
    counts = on.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m"), F.sum("n").alias("total")).filter(F.col("total") >= least)
    at = F.transform(F.sequence(F.lit(censor), F.lit(hours - 1)), lambda h: F.coalesce(F.try_element_at("m", h.cast("bigint")), F.lit(0).cast("bigint")))
    c = counts.withColumn("c", at).withColumn("sorted", F.array_sort("c"))
    n = hours - censor
    rate = (F.get("sorted", (n - 1) // 2) + F.get("sorted", n // 2)) / 2
    c = c.withColumn("lam", F.greatest(rate, F.lit(0.25)) * w)
    win = F.transform(F.sequence(F.lit(0), F.lit(n - w)), lambda i: F.struct((i + censor).cast("bigint").alias("h"), F.aggregate(F.slice(F.col("c"), i + 1, F.lit(w)), F.lit(0).cast("bigint"), lambda t, x: t + x).alias("k")))
    c = c.select("key", "lam", F.explode(F.filter(win, lambda x: x["k"] >= least)).alias("x")).select("key", "lam", "x.h", "x.k").withColumn("p", poisson_tail(F.col("k"), F.col("lam"))).withColumn("z", (F.col("k") - F.col("lam")) / F.sqrt("lam"))
    g = c.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p", "h", "k", "z"))).alias("all"))
    none = F.filter(F.col("all"), lambda x: F.lit(False))
    chosen = F.aggregate("all", none, lambda kept, x: F.when(F.forall(kept, lambda y: F.abs(y["h"] - x["h"]) >= w), F.concat(kept, F.array(x))).otherwise(kept))
    return g.select("key", F.explode(chosen).alias("x")).select("key", "x.h", "x.k", "x.z", "x.p")


def burst_roles(bursts: DataFrame, p: DataFrame, keyed: DataFrame, members: DataFrame, cfg: Config, w: int = 3) -> DataFrame:
    """CL6: (key, h, k, p, passed, host, hosted, role) of each burst. A burst that passes BH and holds half of its host campaign (the one most of its sources are in) or more flags it;
    another is extracted, unless a stronger burst flagged its host: then it is a later wave. Bursts of a block don't overlap and blocks share no source, so no order of extraction matters."""
    tests = synchrony.step_up(bursts, "p", cfg.q)
    at = keyed.join(p.select("src", F.col("hfirst").alias("first")), "src")
    inside = tests.join(at, "key").filter((F.col("first") >= F.col("h")) & (F.col("first") < F.col("h") + w)).join(members.select("src", "camp"), "src", "left")
    per = inside.groupBy("key", "h", F.coalesce("camp", F.lit(-1)).alias("camp")).agg(F.count("*").alias("n"))
    host = per.groupBy("key", "h").agg(F.max(F.struct("n", (-F.col("camp")).alias("c"))).alias("x")).select("key", "h", (-F.col("x.c")).alias("host"), F.col("x.n").alias("hosted"))
    size = members.groupBy(F.col("camp").alias("host")).agg(F.count("*").alias("size"))
    r = tests.join(host, ["key", "h"]).join(size, "host", "left")
    r = r.withColumn("flags", F.col("passed") & (F.col("host") >= 0) & (F.col("hosted") >= 0.5 * F.col("size")))
    order = F.struct("p", "key", "h")
    first = r.filter("flags").groupBy("host").agg(F.min(order).alias("flagged"))
    r = r.join(first, "host", "left").withColumn("later", F.col("flagged").isNotNull() & (order > F.col("flagged")) & (F.col("host") >= 0))
    role = F.when(~F.col("passed"), "none").when(F.col("later"), "wave").when(F.col("flags"), "flag").otherwise("extract")
    return r.select("key", "h", "k", "z", "p", "passed", "host", "hosted", role.alias("role"))


def split_bursts(roles: DataFrame, p: DataFrame, keyed: DataFrame, members: DataFrame, least: int, w: int = 3) -> DataFrame:
    """CL6: (src, camp, burst): membership after extraction. Extracted bursts are campaigns numbered after the others; what is left of a campaign stays if it has ``least`` members."""
    cut = roles.filter("role = 'extract'").select("key", "h", F.row_number().over(W.orderBy("p", "key", "h")).cast("bigint").alias("no"))
    at = keyed.join(p.select("src", F.col("hfirst").alias("first")), "src")
    taken = stage(cut.join(at, "key").filter((F.col("first") >= F.col("h")) & (F.col("first") < F.col("h") + w)).select("src", "no"), "taken")
    rest = members.select("src", "camp").join(taken, "src", "left_anti")
    large = rest.groupBy("camp").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("camp")
    last = members.agg(F.coalesce(F.max("camp"), F.lit(0)).alias("last"))
    new = taken.crossJoin(F.broadcast(last)).select("src", (F.col("no") + F.col("last")).alias("camp"), F.lit(True).alias("burst"))
    return rest.join(large, "camp").select("src", "camp", F.lit(False).alias("burst")).unionByName(new)


def signature(p: DataFrame, members: DataFrame, d_size: int) -> DataFrame:
    """AG16: 24 fields of each campaign; values with their shares as arrays of (value, share), smallest value first on ties."""
    m = stage(members.select("src", "camp").join(p, "src"), "members")
    most = lambda c: F.expr(f"mode({c}, true)")
    out = m.groupBy("camp").agg(
        F.count("*").alias("bots"), most("portsig").alias("portsig"), most("pm").alias("proto"), most("phead").alias("phead"), F.median("pph").alias("pph_med"), F.sum("ud").alias("ud_sum"), F.least(F.lit(1.0), F.sum("ud") / d_size).alias("cov_union_ub"), F.median("duty").alias("duty_med"),
        F.median("hfirst").alias("hfirst_med"), F.median("hlast").alias("hlast_med"), F.count_distinct("asn").alias("n_asn"), F.count_distinct("cc").alias("n_cc"), *[F.avg((F.col(c) > 0.5).cast("double")).alias(a) for a, c in (("zmap", "zmf"), ("masscan", "msf"), ("mirai", "mif"))], F.avg(F.col("research").cast("double")).alias("research"),
    )
    most_k = {"fp": 1, "strategy": 3, "disp": 1, "ipid": 1, "ttl": 1, "sportp": 1, "cc": 3, "org": 3}
    long = m.select("camp", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lit(k).alias("most"), F.col(c).cast("string").alias("value")) for c, k in most_k.items()])).alias("x")).select("camp", "x.*")
    n = long.groupBy("camp", "field", "most", "value").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("k"), "value")
    best = n.withColumn("rank", F.row_number().over(W.partitionBy("camp", "field").orderBy(order))).filter(F.col("rank") <= F.col("most")).join(out.select("camp", "bots"), "camp")
    lists = best.groupBy("camp", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", (F.col("n") / F.col("bots")).alias("share")))), lambda x: F.struct(x["value"].alias("value"), x["share"].alias("share"))).alias("l"))
    tops = lists.groupBy("camp").agg(*[F.first(F.when(F.col("field") == c, F.col("l")), ignorenulls=True).alias(f"top_{c}") for c in most_k])
    return out.join(tops, "camp")


def tool_flag() -> Column:
    """PRJ2: the tool that most of a source's records are marked with; of several masscan, then zmap, then mirai."""
    return F.when(F.col("msf") > 0.5, "masscan").when(F.col("zmf") > 0.5, "zmap").when(F.col("mif") > 0.5, "mirai").otherwise("none")


def landscape(p: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """AG17: 30 fields of each campaign, the decision's among them."""
    m = stage(members.select("src", "camp").join(p.withColumn("flag", tool_flag()), "src"), "members")
    most = lambda c: F.expr(f"mode({c}, true)")
    g = m.groupBy("camp").agg(
        F.count("*").alias("bots"), most("portsig").alias("portsig"), most("pm").alias("proto"), most("fpc").alias("fpc"), most("strategy").alias("strategy"), F.median("pph").alias("pph_med"), F.sum("ud").alias("ud_sum"), F.median("span").alias("span_med"), F.min("hfirst").alias("hfirst_min"),
        F.max("hlast").alias("hlast_max"), F.count_distinct("cc").alias("n_cc"), F.count_distinct("asn").alias("n_asn"), F.avg(F.col("research").cast("double")).alias("research"),
    )
    flag = top(m, ["camp"], "flag", 1).select("camp", "flag", F.col("n").alias("flagged"))
    maps = [top(m, ["camp"], c, k).groupBy("camp").agg(F.map_from_entries(F.collect_list(F.struct(c, "n"))).alias(f"top_{c}")) for c, k in (("cc", 3), ("org", 2))]
    out = g.join(flag, "camp").withColumn("flag_share", F.col("flagged") / F.col("bots")).drop("flagged").join(decisions, "camp")
    for t in maps:
        out = out.join(t, "camp")
    return out


def recovered(truth: DataFrame, members: DataFrame) -> DataFrame:
    """(truth, camp): the campaign that holds half of a true one's sources and more, and is half made of them; null where there is none. truth: (src, truth)."""
    t = truth.join(members.select("src", "camp"), "src", "left")
    size, full = truth.groupBy("truth").agg(F.count("*").alias("nt")), members.groupBy("camp").agg(F.count("*").alias("np"))
    pair = t.filter("camp is not null").groupBy("truth", "camp").agg(F.count("*").alias("n")).join(size, "truth").join(full, "camp")
    hit = pair.filter((F.col("n") >= 0.5 * F.col("nt")) & (F.col("n") >= 0.5 * F.col("np"))).groupBy("truth").agg(F.max("camp").alias("camp"))
    return size.select("truth").join(hit, "truth", "left")


def evaluate(p: DataFrame, truth: DataFrame, members: DataFrame, decisions: DataFrame) -> DataFrame:
    """ST26: one row. truth: (src, truth, strategy, orchestrated); sources without a campaign are clusters of their own, and other sources count in a campaign's size."""
    t = stage(truth.join(p.select("src", F.col("strategy").alias("told")), "src").join(members.select("src", "camp"), "src", "left"), "truth")
    pred = F.coalesce(F.col("camp"), -1 - F.col("src"))
    x = t.withColumn("pred", pred)
    cell = x.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    a, b = cell.groupBy("truth").agg(F.sum("n").alias("nt")), cell.groupBy("pred").agg(F.sum("n").alias("np"))
    choose = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    plogp = lambda c: F.sum(F.col(c) * F.log(c))
    s = cell.agg(F.sum("n").cast("double").alias("n"), choose("n").alias("sij"), plogp("n").alias("lij")).crossJoin(a.agg(choose("nt").alias("si"), plogp("nt").alias("li"))).crossJoin(b.agg(choose("np").alias("sj"), plogp("np").alias("lj")))
    n = F.col("n")
    expect = F.col("si") * F.col("sj") / (n * (n - 1) / 2)
    ari = (F.col("sij") - expect) / ((F.col("si") + F.col("sj")) / 2 - expect)
    ht, hp = F.log(n) - F.col("li") / n, F.log(n) - F.col("lj") / n
    nmi = (F.col("lij") / n - F.col("li") / n - F.col("lj") / n + F.log(n)) / ((ht + hp) / 2)
    full = members.groupBy("camp").agg(F.count("*").alias("np"))
    b3 = t.groupBy("truth", "camp").agg(F.count("*").alias("k")).join(a, "truth").join(full, "camp", "left")
    alone = F.col("camp").isNull()
    b3 = b3.agg(F.sum(F.when(alone, F.col("k").cast("double")).otherwise(F.col("k") * F.col("k") / F.col("np"))).alias("sp"), F.sum(F.when(alone, F.col("k") / F.col("nt")).otherwise(F.col("k") * F.col("k") / F.col("nt"))).alias("sr"))
    found = recovered(t.select("src", "truth"), members).join(t.groupBy("truth").agg(F.max("orchestrated").alias("is")), "truth").join(decisions.select("camp", "orchestrated", "orchestrated_rot"), "camp", "left")
    rate = lambda hit, of: F.try_divide(F.count_if(of & F.coalesce(hit, F.lit(False))), F.count_if(of))
    got = F.col("camp").isNotNull()
    r = found.agg(F.avg(got.cast("double")).alias("campaign_recall"), *[rate(F.col(c), got & (F.col("is") == y)).alias(name) for name, c, y in (("tpr", "orchestrated", True), ("fpr", "orchestrated", False), ("tpr_rot", "orchestrated_rot", True), ("fpr_rot", "orchestrated_rot", False))])
    right = F.col("strategy") == F.col("told")
    acc = t.agg(F.avg(right.cast("double")).alias("strategy_acc"), F.avg(F.when(F.col("told") != "undet", right.cast("double"))).alias("strategy_acc_det"), F.count("*").alias("n_syn"))
    out = s.crossJoin(b3).crossJoin(r).crossJoin(acc)
    bp, br = F.col("sp") / n, F.col("sr") / n
    return out.select(ari.alias("ari"), nmi.alias("nmi"), bp.alias("b3_p"), br.alias("b3_r"), (2 * bp * br / (bp + br)).alias("b3_f1"), "campaign_recall", "tpr", "fpr", "tpr_rot", "fpr_rot", "strategy_acc", "strategy_acc_det", "n_syn")


def weak_label_scores(p: DataFrame, members: DataFrame) -> DataFrame:
    """ST27: one row: homogeneity, completeness and V of campaigns against the tool flags of flagged sources, unassigned ones clusters of their own."""
    from .scores import clustering_scores

    x = p.select("src", tool_flag().alias("flag")).filter("flag <> 'none'").join(members.select("src", "camp"), "src", "left")
    s = clustering_scores(x.withColumn("pred", F.coalesce("camp", -1 - F.col("src"))), "flag", "pred").select("homogeneity", "completeness", "v_measure")
    return s.crossJoin(x.agg(F.count("*").alias("flagged"), F.avg(F.col("camp").isNotNull().cast("double")).alias("flagged_covered")))


def characterise(p: DataFrame, members: DataFrame, decisions: DataFrame, payload, m_min: int = 10) -> DataFrame:
    """AG18, Q10, MX23: a row for each campaign of m_min members and more: payload class and its share, spread of destinations and sources, onset and hour of the m-th member. payload: Column of (phead, port)."""
    x = stage(members.select("src", "camp").join(p, "src"), "members")
    size = x.groupBy("camp").agg(F.count("*").alias("bots"), F.expr("mode(top1, true)").alias("port")).filter(F.col("bots") >= m_min)
    x = x.join(size.select("camp", "port"), "camp")
    best = top(x.withColumn("payload", payload(F.col("phead"), F.col("port"))), ["camp"], "payload", 1).select("camp", "payload", F.col("n").alias("k"))
    onset = x.withColumn("r", F.row_number().over(W.partitionBy("camp").orderBy("hfirst", "src"))).filter(F.col("r") <= m_min).groupBy("camp").agg(F.min("hfirst").alias("h1"), F.max("hfirst").alias("h_m"))
    g = x.groupBy("camp").agg(
        F.expr("mode(pm, true)").alias("proto"), F.median("ud").alias("ud_med"), F.median("ud24").alias("ud24_med"), F.avg((F.col("ud") <= 1).cast("double")).alias("frac_ud1"), F.count_distinct(F.shiftright("src", 8)).alias("n_src24"), F.count_distinct("asn").alias("n_asn"), F.count_distinct("cc").alias("n_cc"),
        F.avg(F.col("research").cast("double")).alias("research"), F.median("span").alias("span_med"), (F.max("hlast") - F.min("hfirst") + 1).alias("dur"),
    )
    return size.join(g, "camp").join(best, "camp").join(onset, "camp").join(decisions, "camp").withColumn("payload_share", F.col("k") / F.col("bots")).drop("k")


def summary(rows: DataFrame, subsets: dict[str, Column]) -> DataFrame:
    """Q10: a row for each named subset of characterise(): shares of campaigns and of sources, medians, hours from onset to the m-th member (onsets of the first day left out)."""
    share = lambda c: F.avg(c.cast("double"))
    weighed = lambda c: F.try_divide(F.sum(F.when(c, F.col("bots")).otherwise(0)), F.sum("bots"))
    wait = F.when(F.col("h1") >= 24, F.col("h_m") - F.col("h1"))
    out = None
    for name, test in subsets.items():
        one = rows.filter(test).agg(
            F.lit(name).alias("subset"), F.count("*").alias("n"), F.sum("bots").alias("bots"), share(F.col("proto") == 1).alias("tcp"), share(F.col("proto") == 2).alias("udp"), weighed(F.col("proto") == 1).alias("tcp_bots"), weighed(F.col("proto") == 2).alias("udp_bots"), F.median("ud_med").alias("ud_med_median"),
            share(F.col("ud_med") >= 3).alias("spread_ge3"), share(F.col("ud_med") <= 1).alias("single_addr"), share(F.col("n_src24") == 1).alias("one_src24"), share(F.col("n_asn") == 1).alias("one_asn"), share(F.col("n_cc") == 1).alias("one_cc"), share(F.col("research") >= 0.5).alias("research_half"),
            F.median("span_med").alias("span_med_median"), F.count(wait).alias("waits"), F.median(wait).alias("wait_median"), F.percentile(wait, 0.75).alias("wait_p75"), F.percentile(wait, 0.9).alias("wait_p90"),
        )
        out = one if out is None else out.unionByName(one)
    return out
