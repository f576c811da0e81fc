"""Source profiles of 52 columns: behaviour, timing tests, fingerprints (Q2, PRJ2, PRJ3, SC7-SC16, ST1-ST3).

All statistics are JVM expressions over arrays that the reservoir bounds (160
samples) or the window does (hours), so no aggregate sees an unbounded list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bitmap, scalar

#: Windows told apart in a core fingerprint; words that mark research scanners, in rDNS or organisation. Fixed values.
KNOWN_WINDOWS = ("512", "1024", "2048", "3072", "4096", "5840", "8192", "14600", "16384", "29200", "32768", "42340", "64240", "65228", "65535")
RESEARCH = ("censys", "shodan", "shadowserver", "rapid7", "stretchoid", "internet-measurement", "binaryedge", "onyphe", "leakix", "criminalip", "netsystemsresearch", "recyber", "internettl", "alphastrike", "ipip", "cyber.casa")


def most_frequent(a: Column, default) -> Column:
    """AG7: the most frequent value of an array, the smallest of several; ``default`` for an empty one."""
    start = F.struct(F.lit(0).alias("n"), F.lit(default).alias("v"))
    return F.aggregate(F.array_sort(F.array_distinct(a)), start, lambda s, v: F.when(F.size(F.filter(a, lambda y: y == v)) > s["n"], F.struct(F.size(F.filter(a, lambda y: y == v)).alias("n"), v.alias("v"))).otherwise(s))["v"]


def middle(a: Column) -> Column:
    """The median of an array, of an even number of values their mean; null for none."""
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def two_sided(z: Column) -> Column:
    return 2 * scalar.normal_tail(F.abs(z))


def with_runs_p(p: DataFrame, x: str, out: str) -> DataFrame:
    """ST1: p with ``out``, p of the runs test about the median of an array of 6 values and more; 1 where it can't be told. Steps are columns of their own, so that none is evaluated twice."""
    p = p.withColumn("tw_med", middle(F.col(x))).withColumn("tw_up", F.transform(F.filter(x, lambda v: v != F.col("tw_med")), lambda v: v > F.col("tw_med")))
    up, less = F.col("tw_up"), F.greatest(F.size("tw_up") - 1, F.lit(0))
    p = p.withColumn("tw_n1", F.size(F.filter(up, lambda b: b)).cast("double")).withColumn("tw_turns", F.size(F.filter(F.zip_with(F.slice(up, F.lit(2), less), F.slice(up, F.lit(1), less), lambda a, b: a != b), lambda c: c)))
    p = p.withColumn("tw_n", F.size(up).cast("double")).withColumn("tw_q", 2 * F.col("tw_n1") * (F.col("tw_n") - F.col("tw_n1")))
    n, q, n1 = F.col("tw_n"), F.col("tw_q"), F.col("tw_n1")
    p = p.withColumn("tw_var", F.try_divide(q * (q - n), n * n * (n - 1)))
    can = (F.size(x) >= 6) & (n1 >= 2) & (n - n1 >= 2) & (F.col("tw_var") > 0)
    p = p.withColumn("tw_z", F.when(can, (F.col("tw_turns") + 1 - (q / n + 1)) / F.sqrt("tw_var")))
    return p.withColumn(out, F.coalesce(two_sided(F.col("tw_z")), F.lit(1.0))).drop("tw_med", "tw_up", "tw_n1", "tw_turns", "tw_n", "tw_q", "tw_var", "tw_z")


def with_trend_z(p: DataFrame, a: str, out: str) -> DataFrame:
    """ST2: p with ``out``, Mann-Kendall's z of an array, ties corrected; 0 where it can't be told."""
    x, n = F.col(a), F.size(a).cast("double")
    s = F.aggregate(F.transform(x, lambda v, j: F.size(F.filter(x, lambda w, i: (i < j) & (w < v))) - F.size(F.filter(x, lambda w, i: (i < j) & (w > v)))), F.lit(0), lambda t, d: t + d)
    ties = F.aggregate(F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda y: y == v)).cast("double")), F.lit(0.0), lambda t, k: t + k * (k - 1) * (2 * k + 5))
    p = p.withColumn("tw_s", s.cast("double")).withColumn("tw_ties", ties).withColumn("tw_var", (n * (n - 1) * (2 * n + 5) - F.col("tw_ties")) / 18)
    z = F.when((n >= 4) & (F.col("tw_var") > 0) & (F.col("tw_s") != 0), (F.col("tw_s") - F.signum("tw_s")) / F.sqrt("tw_var")).otherwise(0.0)
    return p.withColumn(out, z).drop("tw_s", "tw_ties", "tw_var")


def chi_square(a: Column, size: int) -> tuple[Column, Column]:
    """ST3: (bins, statistic) of values from 0 to size - 1 over equal bins, min(16, max(2, n div 5)) of them."""
    n = F.size(a)
    k = F.least(F.lit(16), F.greatest(F.lit(2), F.floor(n / 5).cast("int")))
    bins = F.transform(a, lambda x: F.floor(x * k / size).cast("int"))
    square = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda t, b: t + F.pow(F.size(F.filter(bins, lambda x: x == b)).cast("double"), F.lit(2.0)))
    return k, square * k / n - n


def chi_square_tail(x: Column, bins: Column, most: int = 16) -> Column:
    """P(chi square with bins - 1 degrees of freedom > x), in closed form for 2 to ``most`` bins."""
    half, out = x / 2, None
    for k in range(2, most + 1):
        df = k - 1
        if df % 2:
            p = 2 * scalar.normal_tail(F.sqrt(x))
            for i in range(1, df // 2 + 1):
                p = p + F.exp(-half) * F.pow(half, F.lit(i - 0.5)) / math.gamma(i + 0.5)
        else:
            p = F.lit(0.0)
            for i in range(df // 2):
                p = p + F.exp(-half) * F.pow(half, F.lit(float(i))) / math.factorial(i)
        out = F.when(bins == k, p) if out is None else out.when(bins == k, p)
    return F.when(x <= 0, 1.0).otherwise(out)


def strategy(steps: Column, frac: Column, way: Column, n: Column, z: Column, p: Column, p_chi: Column) -> Column:
    """SC16."""
    toward = lambda x: F.when(x > 0, "seq_fwd").otherwise("seq_rev")
    return F.when((steps >= 3) & (frac >= 0.7), toward(way)).when((n >= 8) & (p < 0.005), toward(z)).when(n >= 10, F.when(p_chi >= 0.05, "uperm").otherwise("perm")).otherwise("undet")


def relative_uncertainty(a: Column) -> Column:
    """SC14: entropy of the values over log n; null for under two."""
    n = F.size(a).cast("double")
    h = F.aggregate(F.transform(F.array_distinct(a), lambda v: F.size(F.filter(a, lambda y: y == v)) / n), F.lit(0.0), lambda t, q: t - q * F.log(q))
    return F.when(n >= 2, h / F.log(n))


def profile(acc: DataFrame, d0: int, d_size: int) -> DataFrame:
    """Q2: the 52 columns (hbits as day words, undefined statistics null, rates' bounds by intervals.rate_bounds where asked for) and x, the hourly series."""
    p = acc.withColumn("x", F.when(F.col("hfirst").isNotNull(), F.transform(F.sequence("hfirst", "hlast"), lambda h: F.coalesce(F.try_element_at("hour_pk", h), F.lit(0)).cast("double"))).otherwise(F.array().cast("array<double>")))
    p = p.withColumn("nact", F.size("hour_pk")).withColumn("span", F.coalesce(F.col("hlast") - F.col("hfirst") + 1, F.lit(0)).cast("bigint"))
    offs = F.transform(F.filter("samples", lambda s: s["dst"].between(d0, d0 + d_size - 1)), lambda s: s["dst"] - d0)
    p = p.withColumn("offs", offs).withColumn("nsam", F.size("offs"))
    n = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / n
    p = p.withColumn("mean", mean)
    spread = F.aggregate("x", F.lit(0.0), lambda s, v: s + F.pow(v - F.col("mean"), F.lit(2.0))) / n
    p = with_runs_p(with_trend_z(p, "offs", "trend"), "x", "p_ww")
    bins, chi = chi_square(F.col("offs"), d_size)
    steps = F.col("stride_pos") + F.col("stride_neg") + F.col("stride_big")
    p = p.withColumn("z_mk", F.when(F.col("nsam") >= 8, F.col("trend")).otherwise(0.0)).withColumn("chi2", F.when(F.col("nsam") >= 10, chi)).withColumn("bins", F.when(F.col("nsam") >= 10, bins)).withColumn("steps", steps)
    p = p.withColumn("p_mk", F.when(F.col("nsam") >= 8, two_sided(F.col("z_mk"))).otherwise(1.0)).withColumn("p_chi", chi_square_tail(F.col("chi2"), F.col("bins")))
    p = p.withColumn("frac_seq", F.try_divide(F.col("stride_pos") + F.col("stride_neg"), F.col("steps"))).withColumn("dir_seq", F.coalesce(F.try_divide(F.col("stride_pos") - F.col("stride_neg"), F.col("stride_pos") + F.col("stride_neg")), F.lit(0.0)))
    p = p.withColumn("ru", F.when(F.col("nsam") >= 4, relative_uncertainty(F.transform("offs", lambda o: F.shiftright(o, 8))))).withColumn("rho", F.try_divide("ud24", "ud"))
    field = lambda k, test=None: F.transform(F.filter("samples", test) if test else F.col("samples"), lambda s: s[k])
    tcp, udp = (lambda s: s["proto"] == 6), (lambda s: s["proto"] == 17)
    p = p.withColumn("ttl", most_frequent(F.transform(field("ttl"), scalar.initial_ttl), 0)).withColumn("proto", scalar.protocol(F.col("pm")))
    p = p.withColumn("ipid", scalar.ipid_class(field("ipid"))).withColumn("win", most_frequent(field("win", tcp), "")).withColumn("opts", most_frequent(field("optsig", tcp), "")).withColumn("df", most_frequent(field("df"), 0))
    p = p.withColumn("phead", most_frequent(field("phead", udp), "")).withColumn("sportp", scalar.port_policy(F.transform(F.filter(field("sport"), lambda x: x != ""), lambda x: x.try_cast("bigint"))))
    least = F.greatest(F.lit(1), F.size("samples")) * 0.5
    said = lambda v: F.size(F.filter("samples", lambda s: s["seqrel"] == v)) > least
    p = p.withColumn("seqrel", F.when(said("D"), "D").when(said("Z"), "Z").otherwise("-"))
    wins, ids = F.array_distinct(field("win", tcp)), F.array_distinct(field("ipid"))
    winc = F.when((F.size(wins) == 1) & F.get(wins, 0).isin(*KNOWN_WINDOWS), F.get(wins, 0)).otherwise("x")
    ipc = F.when((F.size(ids) == 1) & (F.get(ids, 0) == 54321), "54321").when((F.size(ids) == 1) & (F.get(ids, 0) == 0), "0").otherwise("x")
    said_opts, head, bar = F.when(F.col("opts") == "", "-").otherwise(F.col("opts")), F.substring("phead", 1, 4), F.lit("|")
    ttl, df = F.concat(F.lit("t"), F.col("ttl").cast("string")), F.concat(F.lit("df"), F.col("df").cast("string"))
    fp = F.when(F.col("proto") == "udp", F.concat(F.lit("udp|"), ttl, bar, "ipid", bar, "sportp", bar, df, F.lit("|ph"), head)).otherwise(F.concat("proto", bar, ttl, bar, "ipid", F.lit("|w"), "win", F.lit("|o"), said_opts, F.lit("|s"), "seqrel", bar, "sportp", bar, df))
    fpc = F.when(F.col("proto") == "udp", F.concat(F.lit("udp|"), ttl, bar, df, F.lit("|i"), ipc, F.lit("|ph"), head)).otherwise(F.concat("proto", bar, ttl, bar, df, F.lit("|o"), said_opts, F.lit("|s"), "seqrel", F.lit("|i"), ipc, F.lit("|w"), winc))
    few = (F.col("nports") <= 3) & (F.col("ports") <= 3)
    names = F.lower(F.concat("rdns", F.lit(" "), "org"))
    research = F.lower("rdns").contains("scan")
    for word in RESEARCH:
        research = research | names.contains(word)
    p = p.withColumn("dmode", most_frequent(F.col("offs"), F.lit(-1).cast("bigint")))
    share = lambda k: (F.col(k) / F.greatest("nrec", F.lit(1)))
    dispersed = F.when(F.col("ru").isNotNull(), F.col("ru") >= 0.8).otherwise(F.coalesce(F.col("rho") >= 0.5, F.lit(False)))
    return p.select(
        "src", "pm", "nrec", "nports", F.when(few, F.concat(F.lit("p"), F.array_join(F.transform(F.array_sort("top3"), lambda x: x.cast("string")), "+"))).otherwise("multi").alias("portsig"), F.coalesce(F.get("top3", 0), F.lit(0)).alias("top1"), "pk", "ud", "ud24", F.col("nact").cast("bigint").alias("nact"),
        "span", F.coalesce("hfirst", F.lit(-1)).alias("hfirst"), F.coalesce("hlast", F.lit(-1)).alias("hlast"), "words", F.coalesce(F.try_divide("nact", "span"), F.lit(0.0)).alias("duty"), (F.col("pk") / F.greatest("nact", F.lit(1))).alias("pph"),
        F.when((n >= 3) & (F.col("mean") > 0), spread / F.col("mean")).alias("fano"), "p_ww", "nsam", "z_mk", "p_mk", "chi2", "p_chi", "frac_seq", "dir_seq", strategy(F.col("steps"), F.col("frac_seq"), F.col("dir_seq"), F.col("nsam"), F.col("z_mk"), F.col("p_mk"), F.col("p_chi")).alias("strategy"),
        "ru", "rho", F.when(dispersed, "dispersed").otherwise("targeted").alias("disp"), F.least(F.lit(1.0), F.col("ud") / d_size).alias("cov"), "ttl", F.coalesce((F.col("ttl") - middle(field("ttl"))).cast("int"), F.lit(-1)).alias("hops"), "ipid", "win", "opts", "seqrel", "sportp", "df", "phead",
        fp.alias("fp"), fpc.alias("fpc"), share("zm").alias("zmf"), share("ms").alias("msf"), share("mi").alias("mif"), "asn", "cc", "org", "rdns", research.cast("int").alias("research"), "dmode", F.size(F.filter("offs", lambda o: o == F.col("dmode"))).alias("dmode_k"), "x",
    )


def candidates(p: DataFrame) -> DataFrame:
    """FIL6: sources with two destinations, or two samples, and more."""
    return p.filter((F.col("ud") >= 2) | (F.col("nsam") >= 2))
