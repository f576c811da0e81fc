"""Simulated scanning campaigns with a known truth (SRC16): packets, records and truth as relations of integers alone.

Every value is a reproducible draw (functions.scalar.draw) of integer keys, so a
scenario is the same on any cluster, however it is partitioned, and in plain SQL.
Rows are made where they are used, from spark.range: nothing is kept on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar

#: First simulated source; campaign k's are BASE + 4096 k + bot, those of the background BASE + 4096 (100 + port) + i.
BASE = 4_026_531_840
#: Tools: (name, protocol, first TTL, IP id, window (0: any), options, sequence number, source port, DF, payload head, flag, main port, second port). Fixed values.
TOOLS = (
    ("mirai", 6, 64, "any", 0, "", "dst", "any", 0, "", "mirai", 23, 2323),
    ("zmap", 6, 255, "54321", 65535, "M1460", "any", "narrow", 0, "", "zmap", 443, 443),
    ("masscan", 6, 255, "any", 1024, "", "any", "fixed", 0, "", "masscan", 8080, 8080),
    ("linux", 6, 64, "0", 64240, "M1460.S.T.N.W7", "any", "any", 1, "", "", 22, 22),
    ("winsyn", 6, 128, "up", 8192, "M1460.N.W8.N.N.S", "any", "any", 1, "", "", 445, 445),
    ("sipudp", 17, 128, "up", 0, "", "any", "any", 0, "4f5054494f4e5320", "", 5060, 5060),
)
#: Strategies, and countries of the sources. Fixed values.
STRATEGIES = ("uperm", "seq_fwd", "seq_rev", "perm")
COUNTRIES = ("BR", "US", "CN", "IN", "VN", "RU", "ID", "TW", "KR", "MX")
#: Draws of one scenario differ by these salts.
SALT = {k: 1_000_003 * (i + 1) for i, k in enumerate("waves start length keep jitter off hits second minute dst side port sport ipid win seq hops cc asn block tool strategy".split())}


@dataclass(frozen=True)
class Scenario:
    """campaigns of bots each; every second one is orchestrated. ``background`` unrelated sources on each main port.

    rate: mean packets of an active hour. stagger: hours by which a bot of an
    orchestrated campaign may be late. residue: the last so many campaigns send
    all packets to one address each. The window has ``hours`` hours.
    """

    campaigns: int = 8
    bots: int = 100
    rate: float = 5.27
    hours: int = 168
    stagger: int = 0
    background: int = 0
    residue: int = 0
    quiet: int = 0
    d_bits: int = 19
    d0: int = 591396864
    seed: int = 1


def waiting(mean: float, most: int = 40) -> list[int]:
    """Bounds of a Poisson variable on the scale of a draw below 2**31 - 1: its value is the number of bounds at or below the draw."""
    p, total, out = math.exp(-mean), 0.0, []
    for k in range(most):
        total += p
        out.append(min(scalar.M31, round(total * scalar.M31)))
        p *= mean / (k + 1)
    return out


def _draw(salt: str, seed: int, n: Column | int, a: Column, b: Column | int = 0) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return scalar.bound_draw(a * 7919 + b.cast("bigint") * 104729 + (SALT[salt] + seed * 7_368_787), n)


def _draw_sql(salt: str, seed: int, n: str | int, a: str, b: str | int = 0) -> str:
    return scalar.draw_sql(f"({a}) * 7919 + ({b}) * 104729 + {SALT[salt] + seed * 7_368_787}", str(n))


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def _tool(i: int, at: Column) -> Column:
    return _pick(tuple(t[i] for t in TOOLS), at)


def bots(spark: SparkSession, s: Scenario) -> DataFrame:
    """The truth: (src, camp, tool, strategy, orchestrated, residue, cc, asn) for each simulated source; camp is -1 in the background, whose tool and strategy are drawn for each source."""
    ids = spark.range(s.campaigns * s.bots).select(F.floor(F.col("id") / s.bots).alias("camp"), (F.col("id") % s.bots).alias("bot"))
    own = ids.select((F.col("camp") * 4096 + F.col("bot") + BASE).alias("src"), "camp", (F.col("camp") % len(TOOLS)).alias("tool"), (F.floor(F.col("camp") / 2) % 4).alias("strat"))
    n = (len(TOOLS) - s.quiet) * s.background
    far = spark.range(max(n, 0)).select((F.floor(F.col("id") / max(1, s.background)) * 4096 + F.col("id") % max(1, s.background) + BASE + 4096 * 100).alias("src"), F.lit(-1).cast("bigint").alias("camp"))
    far = far.select("src", "camp", _draw("tool", s.seed, len(TOOLS), F.col("src")).alias("tool"), _draw("strategy", s.seed, 4, F.col("src")).alias("strat"))
    every = own.unionByName(far)
    last = F.col("camp") >= s.campaigns - s.residue
    return every.select(
        "src", "camp", "tool", _pick(STRATEGIES, F.col("strat")).alias("strategy"), ((F.col("camp") >= 0) & (F.col("camp") % 2 == 0) & ~last).alias("orchestrated"), last.alias("residue"),
        _pick(COUNTRIES, _draw("cc", s.seed, 10, F.col("src"))).alias("cc"), (_draw("asn", s.seed, 25, F.col("src")) + 1000 + 100 * F.greatest("camp", F.lit(0).cast("bigint"))).cast("int").alias("asn"),
    )


def bots_sql(s: Scenario) -> str:
    case = lambda at, xs: f"[{', '.join(repr(x) for x in xs)}][({at}) + 1]"
    return f"""sim_ids AS (SELECT {BASE}::BIGINT + (i // {s.bots}) * 4096 + i % {s.bots} AS src, i // {s.bots} AS camp FROM (SELECT unnest(range(0, {s.campaigns * s.bots})) AS i)
 UNION ALL SELECT {BASE}::BIGINT + 4096 * 100 + (i // {max(1, s.background)}) * 4096 + i % {max(1, s.background)}, -1 FROM (SELECT unnest(range(0, {(len(TOOLS) - s.quiet) * s.background})) AS i)),
sim_pick AS (SELECT src, camp, CASE WHEN camp >= 0 THEN camp % {len(TOOLS)} ELSE {_draw_sql('tool', s.seed, len(TOOLS), 'src')} END AS tool, CASE WHEN camp >= 0 THEN (camp // 2) % 4 ELSE {_draw_sql('strategy', s.seed, 4, 'src')} END AS strat FROM sim_ids),
bots AS (SELECT src, camp, tool, {case('strat', STRATEGIES)} AS strategy, camp >= 0 AND camp % 2 = 0 AND camp < {s.campaigns - s.residue} AS orchestrated, camp >= {s.campaigns - s.residue} AS residue,
 {case(_draw_sql('cc', s.seed, 10, 'src'), COUNTRIES)} AS cc, {_draw_sql('asn', s.seed, 25, 'src')} + 1000 + 100 * greatest(camp, 0) AS asn FROM sim_pick)"""


def hours(truth: DataFrame, s: Scenario) -> DataFrame:
    """(src, h): the active hours. One to three waves of three to nine hours; orchestrated bots share their campaign's waves, keep nine hours in ten, and are early, on time or late by one."""
    key = F.when(F.col("orchestrated"), F.col("camp")).otherwise(F.col("src"))
    w = truth.select("src", "orchestrated", key.alias("key")).withColumn("w", F.explode(F.sequence(F.lit(0).cast("bigint"), _draw("waves", s.seed, 3, F.col("key")))))
    w = w.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), _draw("length", s.seed, 7, F.col("key"), F.col("w")) + 2)))
    h = (_draw("start", s.seed, s.hours, F.col("key"), F.col("w")) + F.col("i")) % s.hours
    e = w.select("src", "orchestrated", h.alias("h")).distinct()
    late = _draw("off", s.seed, s.stagger + 1, F.col("src")) if s.stagger else F.lit(0).cast("bigint")
    moved = (F.col("h") + late + _draw("jitter", s.seed, 3, F.col("src"), F.col("h")) - 1 + s.hours) % s.hours
    kept = ~F.col("orchestrated") | (_draw("keep", s.seed, 10, F.col("src"), F.col("h")) > 0)
    return e.filter(kept).select("src", F.when(F.col("orchestrated"), moved).otherwise(F.col("h")).alias("h")).distinct()


def hours_sql(s: Scenario) -> str:
    d = lambda *a: _draw_sql(a[0], s.seed, *a[1:])
    late = d("off", s.stagger + 1, "src") if s.stagger else "0"
    return f"""sim_wave AS (SELECT src, orchestrated, key, unnest(range(0, {d('waves', 3, 'key')} + 1)) AS w FROM (SELECT src, orchestrated, CASE WHEN orchestrated THEN camp ELSE src END AS key FROM bots)),
sim_hour AS (SELECT DISTINCT src, orchestrated, ({d('start', s.hours, 'key', 'w')} + i) % {s.hours} AS h FROM (SELECT *, unnest(range(0, {d('length', 7, 'key', 'w')} + 3)) AS i FROM sim_wave)),
sim_hours AS (SELECT DISTINCT src, CASE WHEN orchestrated THEN (h + {late} + {d('jitter', 3, 'src', 'h')} - 1 + {s.hours}) % {s.hours} ELSE h END AS h FROM sim_hour WHERE NOT orchestrated OR {d('keep', 10, 'src', 'h')} > 0)"""


def packets(spark: SparkSession, s: Scenario, start: int = 0) -> DataFrame:
    """(src, camp, h, i, t, dport, proto, dst, sport, ttl, ipid, df, win, optsig, seqrel, plen, phead): every packet; i numbers those of a source by time. ``start``: epoch seconds of hour 0."""
    truth = bots(spark, s)
    size = 1 << s.d_bits
    bounds = F.array(*[F.lit(x) for x in waiting(s.rate)])
    many = scalar.let(_draw("hits", s.seed, scalar.M31, F.col("src"), F.col("h")), lambda v: F.size(F.filter(bounds, lambda b: v >= b)).cast("bigint"))
    hit = hours(truth, s).withColumn("n", many).filter("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    hit = hit.select("src", "h", "j", (F.col("h") * 3600 + _draw("second", s.seed, 3600, F.col("src"), F.col("h") * 64 + F.col("j")) + start).alias("t"))
    w = W.partitionBy("src")
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(4 * size) / (F.col("m") * 5)))
    hit = hit.withColumn("i", F.row_number().over(w.orderBy("t", "h", "j")).cast("bigint") - 1).withColumn("m", F.count("*").over(w))
    x = hit.join(truth, "src")
    d = lambda *a: _draw(a[0], s.seed, a[1], F.col("src"), *(a[2:] or (F.col("i"),)))
    ahead = F.when(F.col("strategy") == "seq_rev", F.col("m") - 1 - F.col("i")).otherwise(F.col("i"))
    jitter = _draw("dst", s.seed, F.greatest(F.lit(1).cast("bigint"), F.floor(step / 4)), F.col("src"), ahead)
    line = d("side", size // 8, 0) + ahead * step + jitter
    block = F.when(d("side", 2) == 0, _draw("block", s.seed, 8, F.col("camp") + 1)).otherwise((_draw("block", s.seed, 8, F.col("camp") + 1) + 3) % 8)
    off = F.when(F.col("residue"), _draw("block", s.seed, size, F.col("camp") + 500)).when(F.col("strategy").startswith("seq"), line).when(F.col("strategy") == "perm", block * (size // 8) + d("dst", size // 8)).otherwise(d("dst", size))
    x = x.withColumn("off", off % size)
    t = lambda i: _tool(i, F.col("tool"))
    port = F.when(F.col("camp") < 0, _pick(tuple(k[11] for k in TOOLS), F.floor((F.col("src") - BASE - 4096 * 100) / 4096))).when(d("port", 10) == 0, t(12)).otherwise(t(11))
    sport = F.when(t(7) == "fixed", d("sport", 28000, 0) + 32768).when(t(7) == "narrow", d("sport", 28000, 0) + 32768 + d("sport", 8)).otherwise(d("sport", 64512) + 1024)
    ipid = F.when(t(3) == "54321", 54321).when(t(3) == "0", 0).when(t(3) == "up", (d("ipid", 65536, 0) + F.col("i") * 40 + d("ipid", 39) + 1) % 65536).otherwise(d("ipid", 65536))
    tcp = t(1) == 6
    return x.select(
        "src", "camp", "h", "i", "t", port.cast("int").alias("dport"), t(1).alias("proto"), (F.col("off") + s.d0).alias("dst"), sport.cast("string").alias("sport"), (t(2) - 4 - d("hops", 22, 0)).cast("int").alias("ttl"), ipid.cast("int").alias("ipid"), t(8).alias("df"),
        F.when(tcp, F.when(t(4) == 0, d("win", 65535) + 1).otherwise(t(4)).cast("string")).otherwise("").alias("win"), t(5).alias("optsig"), F.when(tcp & (t(6) == "dst"), "D").otherwise("").alias("seqrel"),
        F.when(tcp, "").otherwise("16").alias("plen"), t(9).alias("phead"), t(10).alias("flag"), "cc", "asn",
    )


def packets_sql(s: Scenario, start: int = 0) -> str:
    """WITH members bots, sim_hours and sim_packets."""
    size = 1 << s.d_bits
    case = lambda at, i: f"[{', '.join(repr(t[i]) for t in TOOLS)}][({at}) + 1]"
    d = lambda salt, n, b="i": _draw_sql(salt, s.seed, n, "src", b)
    v = _draw_sql("hits", s.seed, scalar.M31, "src", "h")
    many = f"list_sum([CASE WHEN v >= b THEN 1 ELSE 0 END FOR b IN {waiting(s.rate)}])"
    block = _draw_sql("block", s.seed, 8, "camp + 1")
    return f"""{bots_sql(s)}, {hours_sql(s)},
sim_hit AS (SELECT src, h, unnest(range(0, n)) AS j FROM (SELECT src, h, {many}::BIGINT AS n FROM (SELECT src, h, {v} AS v FROM sim_hours))),
sim_time AS (SELECT src, h, h * 3600 + {_draw_sql('second', s.seed, 3600, 'src', 'h * 64 + j')} + {start} AS t, j FROM sim_hit),
sim_num AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, h, j) - 1 AS i, count(*) OVER (PARTITION BY src) AS m FROM sim_time),
sim_at AS (SELECT sim_num.*, bots.* EXCLUDE (src), greatest(1, {4 * size} // (m * 5)) AS step, CASE WHEN strategy = 'seq_rev' THEN m - 1 - i ELSE i END AS ahead FROM sim_num JOIN bots USING (src)),
sim_off AS (SELECT *, CASE WHEN residue THEN {_draw_sql('block', s.seed, size, 'camp + 500')} WHEN strategy LIKE 'seq%' THEN {d('side', size // 8, '0')} + ahead * step + {_draw_sql('dst', s.seed, 'greatest(1, step // 4)', 'src', 'ahead')}
 WHEN strategy = 'perm' THEN CASE WHEN {d('side', 2)} = 0 THEN {block} ELSE ({block} + 3) % 8 END * {size // 8} + {d('dst', size // 8)} ELSE {d('dst', size)} END % {size} AS off FROM sim_at),
sim_packets AS (SELECT src, camp, h, i, t, CASE WHEN camp < 0 THEN {case(f'(src - {BASE + 4096 * 100}) // 4096', 11)} WHEN {d('port', 10)} = 0 THEN {case('tool', 12)} ELSE {case('tool', 11)} END AS dport, {case('tool', 1)} AS proto, off + {s.d0} AS dst,
 CAST(CASE {case('tool', 7)} WHEN 'fixed' THEN {d('sport', 28000, '0')} + 32768 WHEN 'narrow' THEN {d('sport', 28000, '0')} + 32768 + {d('sport', 8)} ELSE {d('sport', 64512)} + 1024 END AS VARCHAR) AS sport, {case('tool', 2)} - 4 - {d('hops', 22, '0')} AS ttl,
 CASE {case('tool', 3)} WHEN '54321' THEN 54321 WHEN '0' THEN 0 WHEN 'up' THEN ({d('ipid', 65536, '0')} + i * 40 + {d('ipid', 39)} + 1) % 65536 ELSE {d('ipid', 65536)} END AS ipid, {case('tool', 8)} AS df,
 CASE WHEN {case('tool', 1)} = 6 THEN CAST(CASE WHEN {case('tool', 4)} = 0 THEN {d('win', 65535)} + 1 ELSE {case('tool', 4)} END AS VARCHAR) ELSE '' END AS win, {case('tool', 5)} AS optsig, CASE WHEN {case('tool', 1)} = 6 AND {case('tool', 6)} = 'dst' THEN 'D' ELSE '' END AS seqrel,
 CASE WHEN {case('tool', 1)} = 6 THEN '' ELSE '16' END AS plen, {case('tool', 9)} AS phead, {case('tool', 10)} AS flag, cc, asn FROM sim_off)"""
