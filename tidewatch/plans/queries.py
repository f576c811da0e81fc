"""The registry: each query is a function of (spark, sf_dir); beside it stands its oracle."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import SMALL as CFG
from ..config import SMALL_STAGED
from ..functions import bitmap, intervals, scalar
from ..operators import campaigns, cluster, lineage, profiles, reports, scores, sentences, synchrony
from ..operators.stage import stage
from ..sources import flows as src
from ..sources import packets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Oracle side of the shared steps: flows, source-hours, profiles, blocks.
FLOWS = """flows AS (SELECT e.event_id AS id, e.user_id AS src, CAST(floor(epoch(e.ts)) AS BIGINT) AS t, CAST(floor(epoch(e.ts) / 3600) AS BIGINT) - 473352 AS h,
 CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 8080 WHEN 'signup' THEN 22 WHEN 'error' THEN 23 END AS port,
 CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 4 ELSE 1 END AS pmask, CAST(ceil(value / 10) AS BIGINT) AS pk, CAST(round(value * 100) AS BIGINT) AS bytes,
 CAST(json_extract(props, '$.k') AS BIGINT) * 5243 AS dst, n_name AS cc, c_nationkey AS asn, c_mktsegment AS org
 FROM events e JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey WHERE floor(epoch(e.ts) / 3600) - 473352 BETWEEN 0 AND 167)"""
WORD = ", ".join(f"CAST(coalesce(bit_or(CASE WHEN h // 24 = {d} THEN (1::BIGINT << (h % 24)::INTEGER) END), 0) AS BIGINT)" for d in range(7))
PROFILES = f"""{FLOWS}, ports AS (SELECT src, port, count(*) AS n, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, port) AS r FROM flows GROUP BY src, port),
acc AS (SELECT src, bit_or(pmask) AS pm, count(*) AS nrec, CAST(sum(pk) AS BIGINT) AS pk, CAST(sum(bytes) AS BIGINT) AS bytes, min(nullif(t, 0)) AS t0, max(t) AS t1, [{WORD}] AS words, min(h) AS hfirst, max(h) AS hlast, count(DISTINCT h) AS nact, min(cc) AS cc, min(asn) AS asn, min(org) AS org FROM flows GROUP BY src),
prof AS (SELECT acc.*, p.port AS top1, (SELECT count(*) FROM ports q WHERE q.src = acc.src) AS nports, hlast - hfirst + 1 AS span, nact / (hlast - hfirst + 1) AS duty, acc.pk / nact AS pph, asn % 2 AS fpc FROM acc JOIN ports p ON p.src = acc.src AND p.r = 1)"""
BLOCKS = f"""{PROFILES}, keyed AS (SELECT src, 'p' || top1 || '‖' || fpc AS key FROM prof), members AS (SELECT src, key, camp FROM keyed JOIN (SELECT key, row_number() OVER (ORDER BY key) AS camp FROM keyed GROUP BY key HAVING count(*) >= {CFG.min_size}) USING (key))"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Where a caller runs many queries over tables that don't change, a dict here lets them share blocked(). None: every query makes its own.
KEPT: dict | None = None


def profiled(spark: SparkSession, d: str) -> DataFrame:
    return profiles.profile(profiles.accumulate(profiles.reduce_hours(src.event_flows(spark, d))))


def blocked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Profiles and members, written once because a query uses them several times."""
    key = (spark.sparkContext.applicationId, d, src.WEEK.get())
    if KEPT is not None and key in KEPT:
        return KEPT[key]
    p = stage(profiled(spark, d), "profiles")
    both = p, stage(campaigns.blocks(p, CFG.min_size), "members")
    if KEPT is not None:
        KEPT[key] = both
    return both


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


@query("reduce_hourly", f"""WITH {FLOWS} SELECT h, src, CAST(bit_or(pmask) AS BIGINT) AS pmask, count(*) AS nrec, count(DISTINCT port) AS nports, CAST(sum(pk) AS BIGINT) AS pk, CAST(sum(bytes) AS BIGINT) AS bytes,
 min(nullif(t, 0)) AS t0, max(t) AS t1, arg_min(cc, id) AS cc, CAST(arg_min(asn, id) AS BIGINT) AS asn, arg_min(org, id) AS org FROM flows GROUP BY h, src""")
def reduce_hourly(spark, d):
    return rounded(profiles.reduce_hours(src.event_flows(spark, d)).drop("topports"))


@query("top_ports", f"""WITH {FLOWS} SELECT src, CAST(port AS BIGINT) AS port, n, r AS rank FROM (SELECT src, port, count(*) AS n, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, port) AS r FROM flows GROUP BY src, port) WHERE r <= 3""")
def top_ports(spark, d):
    return rounded(campaigns.top(src.event_flows(spark, d), ["src"], "port", 3))


@query("profile_basic", f"""WITH {PROFILES} SELECT src, CAST(pm AS BIGINT) AS pm, nrec, nports, CAST(top1 AS BIGINT) AS top1, pk, bytes, nact, span, hfirst, hlast, round(duty, 6) AS duty, round(pph, 6) AS pph, cc, CAST(asn AS BIGINT) AS asn, org, CAST(fpc AS BIGINT) AS fpc FROM prof""")
def profile_basic(spark, d):
    return rounded(profiled(spark, d).drop("words", "x", "fano"))


@query("activity_bitmap", f"""WITH {PROFILES} SELECT src, words[1] AS w0, words[2] AS w1, words[3] AS w2, words[4] AS w3, words[5] AS w4, words[6] AS w5, words[7] AS w6, nact FROM prof""")
def activity_bitmap(spark, d):
    p = profiled(spark, d)
    return rounded(p.select("src", *[F.get("words", k).alias(f"w{k}") for k in range(7)], "nact"))


SERIES = f"""{PROFILES}, grid AS (SELECT src, unnest(range(hfirst, hlast + 1)) AS h FROM prof), ser AS (SELECT g.src, g.h, coalesce(sum(f.pk), 0)::DOUBLE AS v FROM grid g LEFT JOIN flows f ON f.src = g.src AND f.h = g.h GROUP BY ALL)"""


@query("profile_fano", f"""WITH {SERIES} SELECT src, CASE WHEN count(*) >= 3 AND avg(v) > 0 THEN round(var_pop(v) / avg(v), 6) END AS fano FROM ser GROUP BY src""")
def profile_fano(spark, d):
    return rounded(profiled(spark, d).select("src", "fano"))


@query("runs_test", f"""WITH {SERIES}, med AS (SELECT src, median(v) AS med FROM ser GROUP BY src HAVING count(*) >= 6), s AS (SELECT src, h, v > med AS up FROM ser JOIN med USING (src) WHERE v <> med),
 l AS (SELECT *, lag(up) OVER (PARTITION BY src ORDER BY h) AS prev FROM s), g AS (SELECT src, CAST(count(*) FILTER (WHERE up) AS BIGINT) AS n1, CAST(count(*) FILTER (WHERE NOT up) AS BIGINT) AS n2, 1 + count(*) FILTER (WHERE prev IS NOT NULL AND up <> prev) AS runs FROM l GROUP BY src),
 v AS (SELECT *, (n1 + n2)::DOUBLE AS n, 2.0::DOUBLE * n1 * n2 AS q FROM g) SELECT src, n1, n2, runs, CASE WHEN n1 >= 2 AND n2 >= 2 AND q * (q - n) > 0 THEN round((runs - (q / n + 1)) / sqrt(q * (q - n) / (n * n * (n - 1))), 6) END AS z FROM v""")
def runs_test(spark, d):
    return rounded(profiles.runs(profiled(spark, d)))


@query("mann_kendall", f"""WITH {FLOWS}, o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY t, id) AS i FROM flows), n AS (SELECT src, count(*) AS n FROM o GROUP BY src HAVING count(*) >= 4),
 s AS (SELECT b.src, CAST(sum(sign(b.dst - a.dst)) AS BIGINT) AS s FROM o a JOIN o b ON a.src = b.src AND a.i < b.i GROUP BY b.src), t AS (SELECT src, sum(k * (k - 1) * (2 * k + 5)) AS ties FROM (SELECT src, dst, count(*) AS k FROM o GROUP BY src, dst) GROUP BY src),
 v AS (SELECT src, s, (n * (n - 1) * (2 * n + 5) - ties)::DOUBLE / 18 AS var FROM n JOIN s USING (src) JOIN t USING (src)) SELECT src, s, CASE WHEN var > 0 THEN round(CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(var) END, 6) END AS z FROM v""")
def mann_kendall(spark, d):
    f = src.event_flows(spark, d).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("t", "id", "dst"))).alias("s"))
    return rounded(profiles.mann_kendall(f.select("src", F.transform("s", lambda s: s["dst"]).alias("x"))))


@query("dispersion_entropy", f"""WITH {FLOWS}, p AS (SELECT src, dst >> 8 AS d24, count(*) AS k FROM flows GROUP BY ALL), g AS (SELECT src, CAST(sum(k) AS BIGINT) AS n, ln(sum(k)) - sum(k * ln(k)) / sum(k) AS e FROM p GROUP BY src HAVING sum(k) >= 4) SELECT src, n, round(e, 6) AS entropy, round(e / ln(n), 6) AS ru FROM g""")
def dispersion_entropy(spark, d):
    return rounded(profiles.dispersion(src.event_flows(spark, d)))


@query("chi_square", f"""WITH {FLOWS}, n AS (SELECT src, count(*) AS n, CAST(least(16, greatest(2, count(*) // 5)) AS BIGINT) AS bins FROM flows GROUP BY src HAVING count(*) >= 10), b AS (SELECT src, n, bins, dst * bins // 524288 AS b, count(*) AS k FROM flows JOIN n USING (src) GROUP BY ALL)
 SELECT src, n, bins, round(sum(k * k) * bins / n - n, 6) AS chi2 FROM b GROUP BY src, n, bins""")
def chi_square(spark, d):
    return rounded(profiles.chi_square(src.event_flows(spark, d), CFG.d_size))


@query("time_deltas", f"""WITH {FLOWS}, l AS (SELECT src, t - lag(t) OVER (PARTITION BY src ORDER BY t, id) AS dt, dst - lag(dst) OVER (PARTITION BY src ORDER BY t, id) AS dd FROM flows)
 SELECT src, count(dt) AS steps, CAST(min(dt) AS BIGINT) AS least, CAST(max(dt) AS BIGINT) AS most, count(*) FILTER (WHERE dd BETWEEN 1 AND 65536) AS up, count(*) FILTER (WHERE dd BETWEEN -65536 AND -1) AS down FROM l GROUP BY src""")
def time_deltas(spark, d):
    f = src.event_flows(spark, d).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("t", "id", "dst"))).alias("s"))
    f = f.select("src", scalar.deltas(F.transform("s", lambda s: s["t"])).alias("dt"), scalar.deltas(F.transform("s", lambda s: s["dst"])).alias("dd"))
    return rounded(f.select("src", F.size("dt").alias("steps"), F.array_min("dt").alias("least"), F.array_max("dt").alias("most"), F.size(F.filter("dd", lambda x: x.between(1, 65536))).alias("up"), F.size(F.filter("dd", lambda x: x.between(-65536, -1))).alias("down")))


@query("block_campaigns", f"WITH {BLOCKS} SELECT src, key, CAST(camp AS BIGINT) AS camp FROM members")
def block_campaigns(spark, d):
    return rounded(blocked(spark, d)[1])


@query("residue_convergence", f"""WITH {BLOCKS}, m AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, sum(pk) DESC, dst) AS r FROM flows GROUP BY src, dst), c AS (SELECT camp, dst, count(*) AS n FROM members JOIN m USING (src) WHERE r = 1 GROUP BY camp, dst),
 g AS (SELECT camp, CAST(sum(n) AS BIGINT) AS valid, max(n) AS most, first(dst ORDER BY n DESC, dst) AS top_dst FROM c GROUP BY camp) SELECT CAST(camp AS BIGINT) AS camp, valid, top_dst, CASE WHEN valid >= {CFG.residue_members} THEN round(most / valid, 6) ELSE 0 END AS conv, valid >= {CFG.residue_members} AND most / valid >= {CFG.residue} AS residue FROM g""")
def residue_convergence(spark, d):
    return rounded(campaigns.residue(src.event_flows(spark, d), blocked(spark, d)[1], CFG.residue_members, CFG.residue))


@query("landscape", f"""WITH {BLOCKS}, m AS (SELECT * FROM members JOIN prof USING (src)), tp AS (SELECT camp, pm, row_number() OVER (PARTITION BY camp ORDER BY count(*) DESC, pm) AS r FROM m GROUP BY camp, pm), og AS (SELECT camp, org, row_number() OVER (PARTITION BY camp ORDER BY count(*) DESC, org) AS r FROM m GROUP BY camp, org)
 SELECT CAST(m.camp AS BIGINT) AS camp, key, count(*) AS bots, CAST(any_value(tp.pm) AS BIGINT) AS proto, round(median(pph), 6) AS pph_med, CAST(sum(pk) AS BIGINT) AS pk_sum, median(span)::DOUBLE AS span_med, min(hfirst) AS hfirst_min, max(hlast) AS hlast_max, count(DISTINCT cc) AS n_cc, count(DISTINCT asn) AS n_asn, round(quantile_cont(duty, 0.9), 6) AS duty_p90, any_value(og.org) AS top_org
 FROM m JOIN tp ON tp.camp = m.camp AND tp.r = 1 JOIN og ON og.camp = m.camp AND og.r = 1 GROUP BY m.camp, key""")
def landscape(spark, d):
    return rounded(campaigns.landscape(*blocked(spark, d)))


@query("signature_top_values", f"WITH {BLOCKS} SELECT CAST(camp AS BIGINT) AS camp, cc, n, r AS rank FROM (SELECT camp, cc, count(*) AS n, row_number() OVER (PARTITION BY camp ORDER BY count(*) DESC, cc) AS r FROM members JOIN prof USING (src) GROUP BY camp, cc) WHERE r <= 3")
def signature_top_values(spark, d):
    p, m = blocked(spark, d)
    return rounded(campaigns.top(m.join(p, "src"), ["camp"], "cc", 3))


@query("landscape_grouping_sets", f"WITH {PROFILES} SELECT CAST(pm AS BIGINT) AS pm, CAST(top1 AS BIGINT) AS top1, count(*) AS sources, CAST(sum(pk) AS BIGINT) AS pk FROM prof GROUP BY GROUPING SETS ((pm), (top1), ())")
def landscape_grouping_sets(spark, d):
    p = profiled(spark, d)
    return rounded(p.groupingSets([["pm"], ["top1"], []], "pm", "top1").agg(F.count("*").alias("sources"), F.sum("pk").alias("pk")))


@query("hourly_active", f"WITH {BLOCKS}, s AS (SELECT camp, count(*) AS m FROM members GROUP BY camp) SELECT CAST(camp AS BIGINT) AS camp, h, count(DISTINCT src) AS active, round(count(DISTINCT src) / any_value(m), 6) AS share FROM members JOIN flows USING (src) JOIN s USING (camp) GROUP BY camp, h")
def hourly_active(spark, d):
    return rounded(campaigns.hourly_active(*blocked(spark, d)))


@query("kth_onset", f"WITH {BLOCKS} SELECT CAST(camp AS BIGINT) AS camp, max(hfirst) AS first_detected FROM (SELECT camp, hfirst, row_number() OVER (PARTITION BY camp ORDER BY hfirst, src) AS r FROM members JOIN prof USING (src)) WHERE r <= 10 GROUP BY camp")
def kth_onset(spark, d):
    return rounded(campaigns.kth_onset(*blocked(spark, d), 10))


@query("onset_bursts", f"""WITH {BLOCKS}, o AS (SELECT camp, hfirst AS h, count(*) AS n FROM members JOIN prof USING (src) WHERE hfirst >= 2 GROUP BY ALL), c AS (SELECT camp, unnest(range(greatest(h - 2, 2), least(h, 165) + 1)) AS h, n FROM o) SELECT CAST(camp AS BIGINT) AS camp, h, CAST(sum(n) AS BIGINT) AS k FROM c GROUP BY camp, h""")
def onset_bursts(spark, d):
    return rounded(campaigns.onset_bursts(*blocked(spark, d), 168, 3, 2))


ON = [f"(words[{k + 1}] <> 0)::INTEGER" for k in range(7)]


@query("day_presence_drift", f"""WITH {PROFILES} SELECT count(*) AS sources, round(avg(({' + '.join(ON)} = 1)::INTEGER), 6) AS one_day, round(avg(({' + '.join(ON)} = 7)::INTEGER), 6) AS all_days,
 {', '.join(f'round(sum({ON[k]} * {ON[k + 1]}) / greatest(sum({ON[k]}), 1), 6) AS stay{k}' for k in range(6))}, {', '.join(f'CAST(sum({ON[k]}) AS BIGINT) AS day{k}' for k in range(7))} FROM prof""")
def day_presence_drift(spark, d):
    return rounded(campaigns.drift(profiled(spark, d), 7))


@query("port_drift_cv", f"WITH {PROFILES}, e AS (SELECT top1, unnest(range(1, 8)) AS k, words FROM prof), g AS (SELECT top1, k, sum((words[k] <> 0)::INTEGER) AS n FROM e GROUP BY ALL) SELECT CAST(top1 AS BIGINT) AS top1, CAST(sum(n) AS BIGINT) AS total, round(stddev_samp(n) / avg(n), 6) AS cv, round(max(n) / avg(n), 6) AS peak FROM g GROUP BY top1 HAVING sum(n) >= 20")
def port_drift_cv(spark, d):
    return rounded(campaigns.port_drift(profiled(spark, d), 7, 20))


# ---------------------------------------------------------------- synchrony
JAC = lambda a, b: f"coalesce(list_sum([bit_count({a}[i] & {b}[i]) FOR i IN range(1, 8)])::DOUBLE / nullif(list_sum([bit_count({a}[i] | {b}[i]) FOR i IN range(1, 8)]), 0), 0)"
TURN = lambda w, s: f"list_concat({w}[8 - ({s}):7], {w}[1:7 - ({s})])"
PAIR = lambda seed: scalar.draw_sql(f"camp * 7919 + d * 104729 + {seed}", "n")
PAIRS = f"""{BLOCKS}, o AS (SELECT camp, src, row_number() OVER (PARTITION BY camp ORDER BY src) - 1 AS o FROM members), sz AS (SELECT camp, count(*) AS n FROM members GROUP BY camp),
dr AS (SELECT camp, {PAIR(CFG.seed)} AS i, {PAIR(CFG.seed + 50_000_017)} AS j FROM (SELECT camp, n, unnest(range(1, {CFG.pairs} + 1)) AS d FROM sz WHERE n * (n - 1) / 2 > {CFG.pairs})),
pairs AS (SELECT x.camp, x.src AS a, y.src AS b FROM o x JOIN o y ON x.camp = y.camp AND x.o < y.o JOIN sz ON sz.camp = x.camp WHERE n * (n - 1) / 2 <= {CFG.pairs} UNION ALL SELECT dr.camp, x.src, y.src FROM dr JOIN o x ON x.camp = dr.camp AND x.o = i JOIN o y ON y.camp = dr.camp AND y.o = j WHERE i <> j),
obs AS (SELECT camp, count(*) AS n_pairs, avg({JAC('p.words', 'q.words')}) AS coact FROM pairs JOIN prof p ON p.src = a JOIN prof q ON q.src = b GROUP BY camp)"""
OFF = lambda s: scalar.draw_sql(f"{s} * 7919 + k * 104729 + {CFG.seed}", "7")
VERDICT = lambda name, t: f"SELECT camp, (count(*) FILTER (WHERE t >= coact - 1e-12) + 1) / (count(*) + 1) AS p_{name}, CASE WHEN stddev_pop(t) < 1e-9 THEN 0 ELSE (max(coact) - avg(t)) / stddev_pop(t) END AS z_{name} FROM {t} JOIN obs USING (camp) GROUP BY camp"
ROT = f"""{PAIRS}, rt AS (SELECT camp, k, avg({JAC('wa', 'wb')}) AS t FROM (SELECT camp, k, {TURN('p.words', OFF('a'))} AS wa, {TURN('q.words', OFF('b'))} AS wb FROM pairs JOIN prof p ON p.src = a JOIN prof q ON q.src = b CROSS JOIN (SELECT unnest(range(1, {CFG.draws} + 1)) AS k)) GROUP BY camp, k), rot AS ({VERDICT('rot', 'rt')})"""
BIN = "CASE WHEN nact <= 1 THEN 0 WHEN nact <= 3 THEN 1 WHEN nact <= 7 THEN 2 WHEN nact <= 15 THEN 3 WHEN nact <= 31 THEN 4 WHEN nact <= 63 THEN 5 ELSE 6 END"
PEERS = f"""tp AS (SELECT camp, port, m FROM (SELECT camp, top1 AS port, row_number() OVER (PARTITION BY camp ORDER BY count(*) DESC, top1) AS r, sum(count(*)) OVER (PARTITION BY camp) AS m FROM members JOIN prof USING (src) GROUP BY camp, top1) WHERE r = 1),
pc AS (SELECT tp.camp, port, m, count(*) AS peers FROM tp JOIN prof ON top1 = port WHERE NOT EXISTS (SELECT 1 FROM members WHERE members.camp = tp.camp AND members.src = prof.src) GROUP BY ALL)"""
#: Peers of a stratum: its first tier with enough of them, then tries of a drawn place among the tier's sources by (bin, src mod 64, src).
PB = f"pb AS (SELECT src, top1, cc, words, {BIN} AS bin FROM prof)"


def tiers_sql(least: int, country: bool = False) -> str:
    own = "cc, " if country else ""
    near = [f"CASE WHEN dd = {d} THEN {k} END" for d, k in ((0, 1), (-1, 2), (1, 3))] + ["CASE WHEN abs(dd) <= 1 THEN 4 END", "5"]
    if country:
        near = [f"CASE WHEN same AND dd = {d} THEN {k} END" for d, k in ((0, -3), (-1, -2), (1, -1))] + ["CASE WHEN same THEN 0 END"] + near
    return f"""{PEERS}, {PB}, mine AS (SELECT DISTINCT members.camp, {own}bin, port FROM members JOIN pb USING (src) JOIN tp USING (camp)),
cand AS (SELECT mine.camp, {'mine.cc, ' if country else ''}mine.bin, pb.src AS peer, pb.bin AS pbin, mm.src IS NOT NULL AS own, pb.bin - mine.bin AS dd{', pb.cc = mine.cc AS same' if country else ''} FROM mine JOIN pb ON pb.top1 = port LEFT JOIN members mm ON mm.camp = mine.camp AND mm.src = pb.src),
tiers AS (SELECT camp, {own}bin, peer, pbin, own, unnest(list_filter([{', '.join(near)}], lambda x: x IS NOT NULL)) AS tier FROM cand),
pick AS (SELECT camp, {own}bin, min(tier) AS tier, arg_min(n, tier) AS n FROM (SELECT camp, {own}bin, tier, count(*) FILTER (WHERE NOT own) AS n FROM tiers GROUP BY ALL) WHERE n >= {least} OR tier = 5 GROUP BY camp, {own}bin),
pools AS (SELECT camp, {own}bin, peer, own, row_number() OVER (PARTITION BY camp, {own}bin ORDER BY pbin, peer % 64, peer) - 1 AS r, count(*) OVER (PARTITION BY camp, {own}bin) AS total FROM tiers SEMI JOIN pick USING (camp, {own}bin, tier))"""


def pop_sql(least: int, draws: int, seed: int, country: bool = False) -> str:
    own = "cc, " if country else ""
    place = scalar.draw_sql(f"src * 7919 + k * 104729 + try * 50000017 + {seed} + 1", "total")
    return f"""used AS (SELECT camp, src, {own}bin, k, try, {place} AS r FROM (SELECT DISTINCT camp, a AS src FROM pairs UNION SELECT DISTINCT camp, b FROM pairs) JOIN pb USING (src) JOIN (SELECT DISTINCT camp, {own}bin, total FROM pools) USING (camp, {own}bin) CROSS JOIN (SELECT unnest(range(1, {draws} + 1)) AS k) CROSS JOIN (SELECT unnest(range(0, 9)) AS try)),
won AS (SELECT camp, src, k, arg_min(peer, CASE WHEN own THEN 100 - try ELSE try END) AS peer FROM used JOIN pools USING (camp, {own}bin, r) GROUP BY ALL),
got AS (SELECT won.camp, won.src, k, pb.words FROM won JOIN pb ON pb.src = peer),
pt AS (SELECT pairs.camp, x.k, avg({JAC('x.words', 'y.words')}) AS t FROM pairs JOIN got x ON x.camp = pairs.camp AND x.src = a JOIN got y ON y.camp = pairs.camp AND y.src = b AND y.k = x.k GROUP BY ALL), pop AS ({VERDICT('pop', 'pt')})"""


POOLS = tiers_sql(CFG.min_pool)
POP = f"{POOLS}, {pop_sql(CFG.min_pool, CFG.draws, CFG.seed)}"


@query("pair_coactivity", f"WITH {PAIRS} SELECT CAST(camp AS BIGINT) AS camp, n_pairs, round(coact, 6) AS coact FROM obs")
def pair_coactivity(spark, d):
    p, m = blocked(spark, d)
    return rounded(synchrony.coactivity(synchrony.member_pairs(m, CFG.pairs, CFG.seed), p))


@query("rotation_null_p", f"WITH {ROT} SELECT CAST(camp AS BIGINT) AS camp, round(p_rot, 6) AS p_rot, round(z_rot, 4) AS z_rot FROM rot")
def rotation_null_p(spark, d):
    p, m = blocked(spark, d)
    pairs = synchrony.member_pairs(m, CFG.pairs, CFG.seed)
    r = synchrony.rotation_null(pairs, p, synchrony.coactivity(pairs, p), CFG.draws, 7, CFG.seed)
    return rounded(r.withColumn("z_rot", F.round("z_rot", 4)))


@query("peer_pool_counts", f"WITH {BLOCKS}, {PEERS} SELECT CAST(camp AS BIGINT) AS camp, CAST(port AS BIGINT) AS port, CAST(m AS BIGINT) AS m, peers, peers >= m AS testable FROM pc")
def peer_pool_counts(spark, d):
    return rounded(synchrony.peer_counts(*blocked(spark, d), CFG.peer_ratio))


@query("peer_fallback_tiers", f"WITH {BLOCKS}, {POOLS} SELECT CAST(camp AS BIGINT) AS camp, CAST(bin AS BIGINT) AS bin, CAST(tier AS BIGINT) AS tier, n, any_value(total) AS total FROM pick JOIN pools USING (camp, bin) GROUP BY ALL")
def peer_fallback_tiers(spark, d):
    """JN11."""
    t = synchrony.peer_tiers(*blocked(spark, d), CFG.min_pool)
    return rounded(t.select("camp", "bin", "tier", "n", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")))


@query("population_null_p", f"WITH {PAIRS}, {POP} SELECT CAST(camp AS BIGINT) AS camp, round(p_pop, 6) AS p_pop, round(z_pop, 4) AS z_pop FROM pop")
def population_null_p(spark, d):
    """ST7, ST8, ST9."""
    p, m = blocked(spark, d)
    pairs = stage(synchrony.member_pairs(m, CFG.pairs, CFG.seed), "pairs")
    r = synchrony.population_null(pairs, p, m, stage(synchrony.peer_tiers(p, m, CFG.min_pool), "tiers"), synchrony.coactivity(pairs, p), CFG.draws, CFG.seed)
    return rounded(r.withColumn("z_pop", F.round("z_pop", 4)))


@query("campaign_decisions", f"""WITH {ROT}, {POP}, t AS (SELECT pc.camp, peers >= m AS testable, coact, p_rot, CASE WHEN peers >= m THEN coalesce(p_pop, 1) ELSE 1 END AS p_pop FROM pc JOIN obs USING (camp) JOIN rot USING (camp) LEFT JOIN pop USING (camp)),
 k AS (SELECT *, greatest(p_rot, p_pop) AS p, row_number() OVER (ORDER BY greatest(p_rot, p_pop)) AS k, count(*) OVER () AS n FROM t) SELECT CAST(camp AS BIGINT) AS camp, testable, round(coact, 6) AS coact, round(p_rot, 6) AS p_rot, round(p_pop, 6) AS p_pop, round(p, 6) AS p, coalesce(p <= (SELECT max(p) FROM k WHERE p <= {CFG.q} * k / n), false) AS orchestrated FROM k""")
def campaign_decisions(spark, d):
    return rounded(synchrony.decide(*blocked(spark, d), CFG).select("camp", "testable", "coact", "p_rot", "p_pop", "p", "orchestrated"))


TESTS = "tests AS (SELECT c_custkey AS id, c_nationkey AS g, ((c_custkey * 7919 + 13) % 1009) / 1009.0::DOUBLE * ((c_custkey * 31) % 17 + 1) / 17 AS p FROM customer)"


def _tests(spark, d):
    i = F.col("c_custkey")
    return src.load(spark, d, "customer").select(i.alias("id"), F.col("c_nationkey").alias("g"), (F.pmod(i * 7919 + 13, F.lit(1009)) / F.lit(1009.0) * (F.pmod(i * 31, F.lit(17)) + 1) / 17).alias("p"))


@query("bh_decisions", f"WITH {TESTS}, k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS k, count(*) OVER (PARTITION BY g) AS n FROM tests), m AS (SELECT g, max(p) AS most FROM k WHERE p <= 0.2 * k / n GROUP BY g) SELECT id, CAST(k.g AS BIGINT) AS g, round(p, 6) AS p, coalesce(p <= most, false) AS passed FROM k LEFT JOIN m USING (g)")
def bh_decisions(spark, d):
    return rounded(synchrony.step_up(_tests(spark, d), "p", 0.2, ["g"]))


@query("by_decisions", f"WITH {TESTS}, k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p) AS k, count(*) OVER (PARTITION BY g) AS n FROM tests), m AS (SELECT g, max(p) AS most FROM k WHERE p <= 0.4 * k / (n * list_sum([1.0::DOUBLE / i FOR i IN range(1, n + 1)])) GROUP BY g) SELECT id, CAST(k.g AS BIGINT) AS g, round(p, 6) AS p, coalesce(p <= most, false) AS passed FROM k LEFT JOIN m USING (g)")
def by_decisions(spark, d):
    return rounded(synchrony.step_up(_tests(spark, d), "p", 0.4, ["g"], harmonic=True))


# ---------------------------------------------------------------- lineage
DAYS = f"{FLOWS}, dm AS (SELECT DISTINCT h // 24 AS day, CAST(port AS BIGINT) * 10 + asn % 3 AS camp, src FROM flows), ds AS (SELECT day, camp, count(*) AS m FROM dm GROUP BY ALL)"


def _day_members(spark, d):
    return src.event_flows(spark, d).select(F.floor(F.col("h") / 24).alias("day"), (F.col("port").cast("bigint") * 10 + F.col("asn") % 3).alias("camp"), "src").distinct()


LINK = f"""{DAYS}, cc AS (SELECT a.day, a.camp, b.camp AS next_camp, count(*) AS common FROM dm a JOIN dm b ON b.day = a.day + 1 AND a.src = b.src GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY day, camp ORDER BY common DESC, next_camp) AS r FROM cc),
l AS (SELECT c.day, c.camp, next_camp, common, r, common / (x.m + y.m - common) AS jaccard FROM c JOIN ds x ON x.day = c.day AND x.camp = c.camp JOIN ds y ON y.day = c.day + 1 AND y.camp = next_camp)"""


@query("overlap_lineage", f"WITH {LINK} SELECT day, camp, next_camp, common, round(jaccard, 6) AS jaccard FROM l WHERE r <= 3 AND jaccard >= 0.1")
def overlap_lineage(spark, d):
    return rounded(lineage.overlaps(_day_members(spark, d), 3, 0.1))


@query("continuity", f"WITH {LINK} SELECT ds.day, count(*) AS campaigns, count(l.camp) AS continued, round(count(l.camp) / count(*), 6) AS share FROM ds LEFT JOIN l ON l.day = ds.day AND l.camp = ds.camp AND r = 1 AND jaccard >= 0.15 GROUP BY ds.day")
def continuity(spark, d):
    m = _day_members(spark, d)
    kept = lineage.overlaps(m, 1, 0.15).select("day", "camp", F.lit(1).alias("on"))
    return rounded(m.select("day", "camp").distinct().join(kept, ["day", "camp"], "left").groupBy("day").agg(F.count("*").alias("campaigns"), F.count("on").alias("continued"), (F.count("on") / F.count("*")).alias("share")))


@query("lineage_tracks")
def lineage_tracks(spark, d):
    m = _day_members(spark, d)
    return lineage.tracks(m, lineage.overlaps(m, 3, 0.1))


# ---------------------------------------------------------------- reports
CAMPS = f"""{BLOCKS}, det AS (SELECT camp, max(hfirst) AS det FROM (SELECT camp, hfirst, row_number() OVER (PARTITION BY camp ORDER BY hfirst, src) AS r FROM members JOIN prof USING (src)) WHERE r <= 10 GROUP BY camp), camps AS (SELECT camp, key, count(*) AS bots, any_value(det) AS first_detected FROM members JOIN det USING (camp) GROUP BY ALL)"""


def _camps(spark, d):
    p, m = blocked(spark, d)
    return m.groupBy("camp", "key").agg(F.count("*").alias("bots")).join(campaigns.kth_onset(p, m, 10), "camp")


@query("as_of_list", f"WITH {CAMPS} SELECT CAST(camp AS BIGINT) AS camp, key, bots, first_detected, first_detected > 24 AS is_new, row_number() OVER (ORDER BY bots DESC, camp) AS place FROM camps WHERE first_detected <= 30 AND (contains(lower(key), 'p8') OR camp = 8)")
def as_of_list(spark, d):
    x = reports.as_of(_camps(spark, d), 30)
    x = x.filter(reports.matches("p8", F.col("key"), F.col("camp")) | (F.col("camp") == 8))
    return rounded(x.withColumn("place", F.row_number().over(W.orderBy(F.desc("bots"), "camp"))))


@query("facet_counts", f"WITH {CAMPS} SELECT count(*) AS campaigns, count(*) FILTER (WHERE bots >= 15) AS large, count(*) FILTER (WHERE key LIKE 'p80%') AS web, CAST(sum(bots) AS BIGINT) AS bots, max(first_detected) AS latest FROM camps")
def facet_counts(spark, d):
    return rounded(_camps(spark, d).agg(F.count("*").alias("campaigns"), F.count_if(F.col("bots") >= 15).alias("large"), F.count_if(F.col("key").startswith("p80")).alias("web"), F.sum("bots").alias("bots"), F.max("first_detected").alias("latest")))


@query("size_ccdf", f"WITH {CAMPS}, g AS (SELECT bots AS size, count(*) AS k FROM camps GROUP BY bots) SELECT size, round(sum(k) OVER (ORDER BY size DESC) / sum(k) OVER (), 6) AS ccdf FROM g")
def size_ccdf(spark, d):
    return rounded(reports.tail(_camps(spark, d), "bots"))


COUNTRY = f"{FLOWS}, cn AS (SELECT cc, count(DISTINCT src) AS n FROM flows GROUP BY cc)"


@query("countries_with_others", f"WITH {COUNTRY}, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, cc) AS r FROM cn) SELECT CASE WHEN r <= 8 THEN cc ELSE 'others' END AS key, CAST(sum(n) AS BIGINT) AS n, count(*) AS members, round(sum(n) / (SELECT sum(n) FROM cn), 6) AS share FROM r GROUP BY 1")
def countries_with_others(spark, d):
    return rounded(reports.with_others(src.event_flows(spark, d).groupBy("cc").agg(F.count_distinct("src").alias("n")), "cc", "n", 8))


@query("largest_remainder", f"WITH {COUNTRY}, x AS (SELECT cc AS key, n * 100::DOUBLE / (SELECT sum(n) FROM cn) AS x FROM cn), y AS (SELECT key, CAST(floor(x) AS BIGINT) AS low, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, key) AS r, 100 - sum(floor(x)) OVER () AS rest FROM x) SELECT key, low + (r <= rest)::BIGINT AS part FROM y")
def largest_remainder(spark, d):
    return rounded(reports.largest_remainder(src.event_flows(spark, d).groupBy("cc").agg(F.count_distinct("src").alias("n")), "cc", "n", 100))


@query("timeline", f"WITH {FLOWS}, g AS (SELECT h, count(DISTINCT src) AS bots, count(*) AS records, CAST(sum(pk) AS BIGINT) AS packets, count(DISTINCT (src, dst >> 14)) / 32 AS per_slice FROM flows GROUP BY h) SELECT h, bots, records, packets, round(per_slice, 6) AS per_slice, bots < 0.9 * lag(bots, 24) OVER (ORDER BY h) AS falling FROM g")
def timeline(spark, d):
    g = src.event_flows(spark, d).groupBy("h").agg(F.count_distinct("src").alias("bots"), F.count("*").alias("records"), F.sum("pk").alias("packets"), (F.count_distinct("src", F.shiftright("dst", 14)) / 32).alias("per_slice"))
    return rounded(g.withColumn("falling", F.col("bots") < 0.9 * F.lag("bots", 24).over(W.orderBy("h"))))


@query("sliding_windows", f"WITH {FLOWS} SELECT CAST(s AS BIGINT) AS first_day, count(*) AS records, count(DISTINCT src) AS sources FROM flows JOIN (SELECT unnest(range(0, 5)) AS s) ON h // 24 BETWEEN s AND s + 2 GROUP BY s")
def sliding_windows(spark, d):
    f = src.event_flows(spark, d).withColumn("day", F.floor(F.col("h") / 24))
    f = f.withColumn("first_day", F.explode(F.sequence(F.greatest(F.col("day") - 2, F.lit(0)), F.least("day", F.lit(4)))))
    return rounded(f.groupBy("first_day").agg(F.count("*").alias("records"), F.count_distinct("src").alias("sources")))


R = scalar.draw_sql("id * 7919 + 7", str(scalar.M31))


@query("reservoir_sample", f"WITH {FLOWS}, r AS (SELECT src, id, dst, row_number() OVER (PARTITION BY src ORDER BY {R}, id) AS r FROM flows) SELECT src, id, dst FROM r WHERE r <= 8")
def reservoir_sample(spark, d):
    f = src.event_flows(spark, d).withColumn("o", scalar.draw(F.col("id") * 7919 + 7, scalar.M31))
    g = f.groupBy("src").agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "id", "dst"))), 1, 8).alias("s"))
    return g.select("src", F.explode("s").alias("s")).select("src", "s.id", "s.dst")


@query("hour_weighted_sample", f"WITH {FLOWS}, g AS (SELECT src, h, sum(pk) + 1 AS w FROM flows GROUP BY ALL), k AS (SELECT src, h, row_number() OVER (PARTITION BY src ORDER BY round(ln(w) - ln(-ln(({scalar.draw_sql('src * 7919 + h * 104729', '999983')} + 0.5) / 999983)), 9) DESC, h) AS r FROM g) SELECT src, h FROM k WHERE r <= 5")
def hour_weighted_sample(spark, d):
    g = src.event_flows(spark, d).groupBy("src", "h").agg((F.sum("pk") + 1).alias("w"))
    u = (scalar.draw(F.col("src") * 7919 + F.col("h") * 104729, 999983) + 0.5) / 999983
    k = g.withColumn("r", F.row_number().over(W.partitionBy("src").orderBy(F.round(F.log("w") - F.log(-F.log(u)), 9).desc(), "h")))
    return k.filter("r <= 5").select("src", "h")


@query("membership_joins", f"WITH {BLOCKS} SELECT c_custkey AS src, coalesce(camp, -1) AS camp, src IS NOT NULL AS member FROM customer LEFT JOIN members ON src = c_custkey")
def membership_joins(spark, d):
    m = blocked(spark, d)[1]
    return rounded(src.load(spark, d, "customer").select(F.col("c_custkey").alias("src")).join(m, "src", "left").select("src", F.coalesce("camp", F.lit(-1)).alias("camp"), F.col("camp").isNotNull().alias("member")))


@query("semi_anti_sets", f"""WITH {FLOWS}, a AS (SELECT DISTINCT src FROM flows WHERE port = 80), b AS (SELECT DISTINCT src FROM flows WHERE port = 23) SELECT 'both' AS kind, count(*) AS n FROM (SELECT src FROM a INTERSECT SELECT src FROM b) UNION ALL SELECT 'only80', count(*) FROM (SELECT src FROM a EXCEPT SELECT src FROM b)
 UNION ALL SELECT 'either', count(*) FROM (SELECT src FROM a UNION SELECT src FROM b) UNION ALL SELECT 'neither', count(*) FROM customer WHERE c_custkey NOT IN (SELECT src FROM a UNION SELECT src FROM b)""")
def semi_anti_sets(spark, d):
    f = src.event_flows(spark, d)
    a, b = (f.filter(F.col("port") == p).select("src").distinct() for p in (80, 23))
    who = src.load(spark, d, "customer").select(F.col("c_custkey").alias("src"))
    one = lambda k, t: t.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return one("both", a.join(b, "src", "left_semi")).union(one("only80", a.join(b, "src", "left_anti"))).union(one("either", a.union(b).distinct())).union(one("neither", who.join(a.union(b), "src", "left_anti")))


@query("shard_filter", f"WITH {FLOWS} SELECT count(*) AS records, count(DISTINCT src) AS sources, CAST(sum(pk) AS BIGINT) AS packets FROM flows WHERE h >= 24 AND h < 48 AND src % 4 = 1")
def shard_filter(spark, d):
    f = src.event_flows(spark, d).filter((F.col("h") >= 24) & (F.col("h") < 48) & (F.col("src") % 4 == 1))
    return f.agg(F.count("*").alias("records"), F.count_distinct("src").alias("sources"), F.sum("pk").alias("packets"))


@query("infer_block", f"WITH {FLOWS} SELECT dst >> 14 AS prefix, count(*) AS n FROM flows GROUP BY 1 ORDER BY n DESC, prefix LIMIT 1")
def infer_block(spark, d):
    return src.event_flows(spark, d).groupBy(F.shiftright("dst", 14).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(1)


@query("supplier_days", "SELECT l_suppkey AS src, count(DISTINCT CAST(l_shipdate AS DATE)) AS days, count(*) AS nrec, CAST(sum(l_quantity) AS BIGINT) AS pk, round(sum(l_extendedprice), 2) AS bytes, count(DISTINCT l_partkey) AS dests, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first_day, count(DISTINCT l_returnflag || l_linestatus) AS ports FROM lineitem GROUP BY l_suppkey")
def supplier_days(spark, d):
    f = src.load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"))
    day = F.to_date("l_shipdate")
    return f.agg(F.count_distinct(day).alias("days"), F.count("*").alias("nrec"), F.sum("l_quantity").cast("bigint").alias("pk"), F.round(F.sum("l_extendedprice"), 2).alias("bytes"), F.count_distinct("l_partkey").alias("dests"), F.min(day).cast("string").alias("first_day"), F.count_distinct(F.concat("l_returnflag", "l_linestatus")).alias("ports"))


@query("clean_names", "SELECT p_partkey, substring(translate(coalesce(p_name, ''), chr(9) || chr(10) || ';', '  ,'), 1, 12) AS name, CAST(p_partkey % 256 AS VARCHAR) || '.' || CAST((p_partkey * 7) % 256 AS VARCHAR) || '.0.1' AS ip, (p_partkey % 256) * 16777216 + ((p_partkey * 7) % 256) * 65536 + 1 AS n FROM part")
def clean_names(spark, d):
    p = src.load(spark, d, "part")
    n = (F.col("p_partkey") % 256) * 16777216 + ((F.col("p_partkey") * 7) % 256) * 65536 + 1
    ip = scalar.ip_text(n)
    return p.select("p_partkey", scalar.clean(F.col("p_name"), 12).alias("name"), ip.alias("ip"), scalar.ip_int(ip).alias("n"))


@query("clustering_scores", """WITH r AS (SELECT label AS t, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 2 ELSE 0 END AS p FROM embeddings), c AS (SELECT t, p, count(*) AS n FROM r GROUP BY ALL), j AS (SELECT *, sum(n) OVER (PARTITION BY t) AS nt, sum(n) OVER (PARTITION BY p) AS np FROM c),
 s AS (SELECT sum(n)::DOUBLE AS n, sum(n * (n - 1) / 2)::DOUBLE AS sij, sum(n * ln(n / np)) AS htp, sum(n * ln(n / nt)) AS hpt, sum(n * n / np) AS bp, sum(n * n / nt) AS br FROM j), a AS (SELECT sum(nt * (nt - 1) / 2)::DOUBLE AS si, sum(nt * ln(nt)) AS lt FROM (SELECT DISTINCT t, nt FROM j)), b AS (SELECT sum(np * (np - 1) / 2)::DOUBLE AS sj, sum(np * ln(np)) AS lp FROM (SELECT DISTINCT p, np FROM j)),
 x AS (SELECT *, ln(n) - lt / n AS ht, ln(n) - lp / n AS hp, si * sj / (n * (n - 1) / 2) AS ex FROM s, a, b), y AS (SELECT *, 1 + htp / n / ht AS hom, 1 + hpt / n / hp AS com FROM x) SELECT round((sij - ex) / ((si + sj) / 2 - ex), 6) AS ari, round(hom, 6) AS homogeneity, round(com, 6) AS completeness, round(2 * hom * com / (hom + com), 6) AS v_measure, round((ht + htp / n) / ((ht + hp) / 2), 6) AS nmi, round(bp / n, 6) AS b3_precision, round(br / n, 6) AS b3_recall FROM y""")
def clustering_scores(spark, d):
    e = src.load(spark, d, "embeddings").select("label", (F.when(F.get("embedding", 0) > 0, 1).otherwise(0) + F.when(F.get("embedding", 1) > 0, 2).otherwise(0)).alias("p"))
    return rounded(scores.clustering_scores(e, "label", "p"))


@query("label_auc", "WITH g AS (SELECT n_chars, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 0) AS neg FROM labels JOIN documents USING (doc_id) GROUP BY n_chars), b AS (SELECT *, sum(neg) OVER (ORDER BY n_chars) - neg AS below FROM g) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM b")
def label_auc(spark, d):
    x = src.load(spark, d, "labels").join(src.load(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(scores.auc(x, "n_chars", "quality"))


@query("strategy_mix", f"""WITH {FLOWS}, l AS (SELECT src, dst - lag(dst) OVER (PARTITION BY src ORDER BY t, id) AS dd FROM flows), g AS (SELECT src, count(*) FILTER (WHERE dd BETWEEN 1 AND 100000) AS sp, count(*) FILTER (WHERE dd BETWEEN -100000 AND -1) AS sn, count(*) FILTER (WHERE dd IS NOT NULL) AS st FROM l GROUP BY src)
 SELECT CASE WHEN st >= 3 AND (sp + sn) / st >= 0.4 THEN CASE WHEN sp > sn THEN 'seq_fwd' ELSE 'seq_rev' END WHEN st >= 10 THEN 'perm' ELSE 'undet' END AS strategy, count(*) AS sources FROM g GROUP BY 1""")
def strategy_mix(spark, d):
    f = src.event_flows(spark, d).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("t", "id", "dst"))).alias("s"))
    f = f.select("src", scalar.deltas(F.transform("s", lambda s: s["dst"])).alias("dd"))
    n = lambda lo, hi: F.size(F.filter("dd", lambda x: x.between(lo, hi)))
    f = f.select(n(1, 100000).alias("sp"), n(-100000, -1).alias("sn"), F.size("dd").alias("st"))
    s = F.when((F.col("st") >= 3) & ((F.col("sp") + F.col("sn")) / F.col("st") >= 0.4), F.when(F.col("sp") > F.col("sn"), "seq_fwd").otherwise("seq_rev")).when(F.col("st") >= 10, "perm").otherwise("undet")
    return f.groupBy(s.alias("strategy")).agg(F.count("*").alias("sources"))


@query("conversation_gaps", "WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, length(text) AS n FROM conversations) SELECT conv_id, count(*) AS turns, 1 + count(*) FILTER (WHERE prev IS NOT NULL AND prev <> role) AS runs, CAST(sum(n) AS BIGINT) AS chars FROM l GROUP BY conv_id")
def conversation_gaps(spark, d):
    c = src.load(spark, d, "conversations").withColumn("prev", F.lag("role").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), (F.count_if(F.col("prev") != F.col("role")) + 1).alias("runs"), F.sum(F.char_length("text")).cast("bigint").alias("chars"))


@query("hdbscan_modes")
def hdbscan_modes(spark, d):
    p, m = blocked(spark, d)
    x = p.withColumn("fano", F.coalesce("fano", F.lit(0.0))).join(m.select("src", "key"), "src").withColumn("lpk", F.log10(F.greatest(F.col("pk"), F.lit(1))))
    return cluster.modes(x, ["duty", "pph", "fano", "lpk", "nports"], "key", CFG)


# ---------------------------------------------------------------- country tiers, staged tests
#: The test tables have few sources of one country on a port, so its tiers need fewer.
CC_LEAST = 2
CC_POOLS = tiers_sql(CC_LEAST, country=True)


@query("country_peer_tiers", f"WITH {BLOCKS}, {CC_POOLS} SELECT CAST(camp AS BIGINT) AS camp, cc, CAST(bin AS BIGINT) AS bin, CAST(tier AS BIGINT) AS tier, n, any_value(total) AS total FROM pick JOIN pools USING (camp, cc, bin) GROUP BY ALL")
def country_peer_tiers(spark, d):
    """JN12."""
    t = synchrony.peer_tiers(*blocked(spark, d), CC_LEAST, country=True)
    return rounded(t.select("camp", "cc", "bin", "tier", "n", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total")))


@query("country_fallback", f"""WITH {BLOCKS}, {CC_POOLS}, g AS (SELECT camp, count(*) AS members, count(*) FILTER (WHERE coalesce(tier, 5) > 0) AS fallback FROM members JOIN pb USING (src) JOIN pc USING (camp) LEFT JOIN pick USING (camp, cc, bin) WHERE peers >= pc.m GROUP BY camp)
 SELECT CAST(camp AS BIGINT) AS camp, members, fallback, fallback * 2 > members AS majority FROM g""")
def country_fallback(spark, d):
    """ST21."""
    p, m = blocked(spark, d)
    tested = synchrony.peer_counts(p, m, CFG.peer_ratio).filter("testable")
    return rounded(synchrony.country_fallback(p, m, synchrony.peer_tiers(p, m, CC_LEAST, country=True), tested))


STEPS, SCREENS = [20, 40, 80], [0.9, 0.5]


def staged_sql() -> str:
    parts = [PAIRS]
    for k, b in enumerate(STEPS):
        turn = lambda s: scalar.draw_sql(f"{s} * 7919 + k * 104729 + {CFG.seed + 1000 * k}", "7")  # noqa: B023, E731
        left = f"WHERE camp IN (SELECT camp FROM s{k - 1} WHERE p_rot <= {SCREENS[k - 1]})" if k else ""
        parts.append(f"""t{k} AS (SELECT camp, k, avg({JAC('wa', 'wb')}) AS t FROM (SELECT camp, k, {TURN('p.words', turn('a'))} AS wa, {TURN('q.words', turn('b'))} AS wb FROM pairs JOIN prof p ON p.src = a JOIN prof q ON q.src = b CROSS JOIN (SELECT unnest(range(1, {b} + 1)) AS k) {left}) GROUP BY camp, k), v{k} AS ({VERDICT('rot', f't{k}')}),
 s{k} AS (SELECT * FROM v{k}{f" UNION ALL SELECT * FROM s{k - 1} WHERE camp NOT IN (SELECT camp FROM v{k})" if k else ""})""")
    return f"WITH {', '.join(parts)} SELECT CAST(camp AS BIGINT) AS camp, round(p_rot, 6) AS p_rot FROM s{len(STEPS) - 1}"


@query("staged_rotation_p", staged_sql())
def staged_rotation_p(spark, d):
    p, m = blocked(spark, d)
    pairs = stage(synchrony.member_pairs(m, CFG.pairs, CFG.seed), "pairs")
    obs = stage(synchrony.coactivity(pairs, p), "coactivity")
    test = lambda x, o, b, seed: synchrony.rotation_null(x, p, o, b, 7, seed)
    return rounded(synchrony.refine(test, pairs, obs, "rot", STEPS, SCREENS, CFG.seed).select("camp", "p_rot"))


@query("campaign_decisions_staged")
def campaign_decisions_staged(spark, d):
    p, m = blocked(spark, d)
    residue = campaigns.residue(src.event_flows(spark, d), m, CFG.residue_members, CFG.residue).filter("residue")
    return rounded(synchrony.decide_staged(p, m, residue, SMALL_STAGED).drop("z_rot", "z_pop", "z", "orchestrated_rot"))


# ---------------------------------------------------------------- intervals, sentences, packets
@query("rate_intervals")
def rate_intervals(spark, d):
    p = profiled(spark, d).select("src", "pk", "span").withColumn("rate", intervals.rate_bounds(F.col("pk"), F.col("span")))
    return rounded(p.select("src", "pk", "span", "rate.lo", "rate.hi"))


@query("service_sentences", f"""WITH {FLOWS}, hp AS (SELECT h, src, port, count(*) AS n FROM flows GROUP BY ALL), hs AS (SELECT h, src, min(nullif(t, 0)) AS t0, max(t) AS t1, sum(pk) AS pk, count(*) AS tot FROM flows GROUP BY ALL),
 keep AS (SELECT src FROM hs GROUP BY src HAVING sum(pk) >= 10), svc AS (SELECT port, row_number() OVER (ORDER BY count(*) DESC, port) - 1 AS service FROM hp SEMI JOIN keep USING (src) GROUP BY port ORDER BY service LIMIT 3),
 w AS (SELECT coalesce(service, 3) AS service, h, src, t0, t1, least(5, greatest(1, round_even(pk * n::DOUBLE / tot, 0)))::BIGINT AS k FROM hp SEMI JOIN keep USING (src) JOIN hs USING (h, src) LEFT JOIN svc USING (port)),
 e AS (SELECT *, t0 + (t1 - t0) * (i + 0.5::DOUBLE) / k AS tm FROM (SELECT *, unnest(range(0, k)) AS i FROM w)), o AS (SELECT service, h, src, tm, row_number() OVER (PARTITION BY service, h ORDER BY tm, src) - 1 AS pos FROM e)
 SELECT CAST(service AS BIGINT) AS service, h, CAST(pos // 4 AS BIGINT) AS part, string_agg(src, ' ' ORDER BY pos) AS words FROM o GROUP BY service, h, pos // 4""")
def service_sentences(spark, d):
    f = src.event_flows(spark, d)
    hours = f.groupBy("h", "src").agg(F.min(F.nullif("t", F.lit(0))).alias("t0"), F.max("t").alias("t1"), F.sum("pk").alias("pk"))
    out = sentences.sentences(hours, f.groupBy("h", "src", "port").agg(F.count("*").alias("n")), n_services=3, longest=4)
    return rounded(out.withColumn("words", F.array_join(F.transform("words", lambda w: w.cast("string")), " ")))


@query("packet_fields", f"""WITH {FLOWS} SELECT id, CAST(CASE WHEN id % 2 = 0 THEN 6 ELSE 17 END AS BIGINT) AS proto, dst, port AS sport, 64::BIGINT AS ttl, id % 65536 AS ipid, id % 2 AS df, CASE WHEN id % 2 = 0 THEN 1024 END::BIGINT AS win,
 CASE WHEN id % 2 = 0 THEN 'M1460.S.N.W7.N.N' END AS optsig, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 4 = 0 OR dst = 0 THEN 'D' ELSE 'Z' END END AS seqrel, CASE WHEN id % 2 = 1 THEN 4 END::BIGINT AS plen, CASE WHEN id % 2 = 1 THEN 'deadbeef' END AS phead FROM flows""")
def packet_fields(spark, d):
    """Frames made of events (TCP and UDP in turn, a third with a VLAN tag) and taken apart again."""
    f = src.event_flows(spark, d)
    word = lambda c, n: F.lpad(F.hex(c.cast("bigint")), n, "0")
    even = F.col("id") % 2 == 0
    ip = F.concat(F.lit("45000000"), word(F.col("id") % 65536, 4), F.when(even, "0000").otherwise("4000"), F.lit("40"), F.when(even, "06").otherwise("11"), F.lit("0000f0000001"), word(F.col("dst"), 8))
    tcp = F.concat(word(F.col("port"), 4), F.lit("0050"), F.when(F.col("id") % 4 == 0, word(F.col("dst"), 8)).otherwise("00000000"), F.lit("00000000" "8002" "0400" "0000" "0000" "020405b4" "0402" "01" "030307" "0101"))
    udp = F.concat(word(F.col("port"), 4), F.lit("0035000c0000deadbeef"))
    frame = F.concat(F.lit("00" * 12), F.when(F.col("id") % 3 == 0, "81000001").otherwise(""), F.lit("0800"), ip, F.when(even, tcp).otherwise(udp))
    rows = f.select("id", F.base64(F.unhex(frame)).alias("frame"))
    return rounded(packets.parse_frames(rows, "frame").drop("frame"))


# ---------------------------------------------------------------- the whole events table
#: Queries over flows that need no week: they run over all hours as <name>_all.
ANY_HOURS = """reduce_hourly top_ports mann_kendall dispersion_entropy chi_square time_deltas overlap_lineage continuity lineage_tracks countries_with_others largest_remainder
timeline reservoir_sample hour_weighted_sample semi_anti_sets infer_block strategy_mix service_sentences packet_fields""".split()
#: Queries whose bitmaps, nulls or hours are those of a week: they run over every week as <name>_weeks, with a column week.
BY_WEEK = """profile_basic activity_bitmap profile_fano runs_test block_campaigns residue_convergence landscape signature_top_values landscape_grouping_sets hourly_active kth_onset onset_bursts
day_presence_drift port_drift_cv pair_coactivity rotation_null_p peer_pool_counts peer_fallback_tiers population_null_p campaign_decisions as_of_list facet_counts size_ccdf sliding_windows
membership_joins shard_filter country_peer_tiers country_fallback staged_rotation_p campaign_decisions_staged rate_intervals""".split()
FIRST_WEEK = " WHERE floor(epoch(e.ts) / 3600) - 473352 BETWEEN 0 AND 167"


def _all(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, d):
        with src.week(None):
            return QUERIES[name](spark, d)

    return run


#: Weeks that are worked on at a time.
WEEKS_AT_ONCE = 5


def _weeks(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query over every week. Weeks run side by side, each in a thread: many of a week's jobs are too small for all cores."""

    def run(spark, d):
        def one(k: int) -> DataFrame:
            with src.week(k):
                rows = QUERIES[name](spark, d)
            return rows.select(F.lit(k).cast("bigint").alias("week"), *rows.columns)

        with ThreadPoolExecutor(WEEKS_AT_ONCE) as pool:
            # Wrapped anew for each week, as a wrapper's local properties are those of one thread.
            parts = [pool.submit(inheritable_thread_target(spark)(one), k) for k in src.event_weeks(spark, d) or [0]]
        return reduce(DataFrame.unionByName, [x.result() for x in parts])

    return run


for _name in ANY_HOURS:
    query(f"{_name}_all", ORACLES[_name].replace(FIRST_WEEK, "") if _name in ORACLES else None)(_all(_name))
for _name in BY_WEEK:
    query(f"{_name}_weeks")(_weeks(_name))
