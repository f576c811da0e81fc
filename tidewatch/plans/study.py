"""The study: simulated campaigns of known truth among background sources and the events table's, from records to decisions.

Each query has its rules a second time as SQL, from the same integers: the simulator
is arithmetic (sources/simulate.py), so DuckDB makes the very same packets.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scalar
from ..operators import fingerprints, inference, reduction, synchrony
from ..operators.stage import stage
from ..sources import records, simulate
from .queries import FLOWS, JAC, TURN, VERDICT, WORD, pop_sql, query, rounded, tiers_sql

#: Six campaigns of 12 bots, the last one residue, 30 unrelated sources on each of four ports, none on the other two, so one campaign is undetermined; blocks of 5 and pools of 10, as the events table adds 150 sources at scale 0.01.
SCENE = simulate.Scenario(campaigns=6, bots=12, background=30, residue=1, quiet=2)
CFG = Config(min_size=5, min_pool=10, pairs=60, draws=399)
START = 473352 * 3600
DOT = "'‖'"


# ---------------------------------------------------------------- SQL of the shared steps
def tail_sql(z: str) -> str:
    """P(Z > |z|), the expression of scalar.normal_tail."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.5 * {x}))"
    p = "0.0"
    for k in reversed(scalar.ERFC):
        p = f"({p} * {t} + ({k}))"
    return f"({t} * exp(-{x} * {x} + {p}) / 2)"


def chi_tail_sql(x: str, bins: str) -> str:
    out = f"CASE WHEN {x} <= 0 THEN 1.0"
    for k in range(2, 17):
        df = k - 1
        if df % 2:
            terms = [f"2 * {tail_sql(f'sqrt({x})')}"] + [f"exp(-{x} / 2) * pow({x} / 2, {i - 0.5}) / {math.gamma(i + 0.5)!r}" for i in range(1, df // 2 + 1)]
        else:
            terms = [f"exp(-{x} / 2) * pow({x} / 2, {i}.0) / {math.factorial(i)}" for i in range(df // 2)]
        out += f" WHEN {bins} = {k} THEN {' + '.join(terms)}"
    return out + " END"


ORDER = scalar.draw_sql("n * 7919 + (src % 1000003) * 104729 + 17", str(scalar.M31))
BASE = f"""{FLOWS}, {records.simulated_sql(SCENE, START)}, {records.events_sql()}, rec AS (SELECT * FROM sim_rec UNION ALL BY NAME SELECT * FROM ev_rec), smp AS (SELECT * FROM sim_smp UNION ALL BY NAME SELECT * FROM ev_smp)"""
REDUCED = f"""{BASE},
rd0 AS (SELECT h, src, bit_or(pmask) AS pmask, count(*) AS nrec, count(DISTINCT port) AS nports, sum(pk)::BIGINT AS pk, sum(bytes)::BIGINT AS bytes, sum(ud)::BIGINT AS ud, sum(ud24)::BIGINT AS ud24, max(ud) AS udmax, coalesce(min(nullif(t0, 0)), 0) AS t0, max(t1) AS t1,
 sum(CASE WHEN t0 > 0 AND t1 >= t0 THEN t1 - t0 ELSE 0 END)::BIGINT AS dur, count(*) FILTER (WHERE zm) AS zm, count(*) FILTER (WHERE ms) AS ms, count(*) FILTER (WHERE mi) AS mi, arg_min(asn, seq) AS asn, arg_min(cc, seq) AS cc, arg_min(org, seq) AS org, arg_min(rdns, seq) AS rdns FROM rec GROUP BY h, src),
sd AS (SELECT src, h, dst - lag(dst) OVER (PARTITION BY src, h, n // 64 ORDER BY n) AS d FROM smp),
st AS (SELECT src, h, count(*) FILTER (WHERE d BETWEEN 1 AND 1024) AS stride_pos, count(*) FILTER (WHERE d BETWEEN -1024 AND -1) AS stride_neg, count(*) FILTER (WHERE d = 0 OR abs(d) > 1024) AS stride_big FROM sd GROUP BY src, h),
p5 AS (SELECT h, src, port, n FROM (SELECT h, src, port, count(*) AS n, row_number() OVER (PARTITION BY h, src ORDER BY count(*) DESC, port) AS r FROM rec GROUP BY h, src, port) WHERE r <= 5),
s32 AS (SELECT *, row_number() OVER (PARTITION BY h, src ORDER BY t, n) - 1 AS pos, count(*) OVER (PARTITION BY h, src) AS cnt FROM (SELECT * FROM smp QUALIFY row_number() OVER (PARTITION BY h, src ORDER BY {ORDER}, n) <= 32)),
s8 AS (SELECT * EXCLUDE (pos, cnt) FROM s32 WHERE cnt <= 8 OR list_contains([CAST(floor(i * cnt / 8) AS BIGINT) FOR i IN range(0, 8)], pos)),
rd AS (SELECT rd0.*, st.stride_pos, st.stride_neg, st.stride_big FROM rd0 JOIN st USING (src, h))"""
ACC = f"""{REDUCED},
prt AS (SELECT src, port, sum(n) AS n, row_number() OVER (PARTITION BY src ORDER BY sum(n) DESC, port) AS r, count(*) OVER (PARTITION BY src) AS ports FROM p5 GROUP BY src, port),
pl AS (SELECT src, any_value(ports) AS ports, list(port ORDER BY r) FILTER (WHERE r <= 3) AS top3 FROM prt GROUP BY src),
ac0 AS (SELECT src, bit_or(pmask) AS pm, sum(nrec)::BIGINT AS nrec, max(nports) AS nports, {', '.join(f'sum({k})::BIGINT AS {k}' for k in 'pk bytes ud ud24 zm ms mi stride_pos stride_neg stride_big'.split())}, max(udmax) AS udmax, coalesce(min(nullif(t0, 0)), 0) AS t0, max(t1) AS t1,
 [{WORD}] AS words, min(h) AS hfirst, max(h) AS hlast, count(DISTINCT h) AS nact, arg_min(asn, h) AS asn, arg_min(cc, h) AS cc, arg_min(org, h) AS org, coalesce(arg_min(rdns, h) FILTER (WHERE rdns <> ''), '') AS rdns FROM rd GROUP BY src),
sam AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t, n) AS pos FROM (SELECT * FROM s8 QUALIFY row_number() OVER (PARTITION BY src ORDER BY {ORDER}, n) <= 160)),
ac AS (SELECT ac0.*, ports, top3 FROM ac0 JOIN pl USING (src))"""


def mode_sql(name: str, value: str, where: str = "true") -> str:
    return f"m_{name} AS (SELECT src, v AS {name}, k AS {name}_n FROM (SELECT src, {value} AS v, count(*) AS k, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, {value}) AS r FROM sam WHERE {where} GROUP BY src, {value}) WHERE r = 1)"


SPAN = f"between {CFG.d0} AND {CFG.d0 + CFG.d_size - 1}"
PROF = f"""{ACC},
o AS (SELECT src, dst - {CFG.d0} AS o, row_number() OVER (PARTITION BY src ORDER BY pos) AS i FROM sam WHERE dst {SPAN}), ns AS (SELECT src, count(*) AS nsam FROM o GROUP BY src),
mk AS (SELECT a.src, sum(sign(b.o - a.o))::DOUBLE AS s FROM o a JOIN o b ON a.src = b.src AND a.i < b.i GROUP BY a.src), tie AS (SELECT src, sum(k * (k - 1) * (2 * k + 5)) AS tie FROM (SELECT src, o, count(*) AS k FROM o GROUP BY src, o) GROUP BY src),
mkz AS (SELECT src, CASE WHEN nsam >= 8 AND s <> 0 AND v > 0 THEN (s - sign(s)) / sqrt(v) ELSE 0.0 END AS z_mk FROM (SELECT src, nsam, s, (nsam * (nsam - 1) * (2 * nsam + 5) - tie)::DOUBLE / 18 AS v FROM ns JOIN tie USING (src) LEFT JOIN mk USING (src))),
ch AS (SELECT src, bins, sum(k * k)::DOUBLE * bins / nsam - nsam AS chi2 FROM (SELECT src, nsam, least(16, greatest(2, nsam // 5)) AS bins, o * least(16, greatest(2, nsam // 5)) // {CFG.d_size} AS b, count(*) AS k FROM o JOIN ns USING (src) WHERE nsam >= 10 GROUP BY ALL) GROUP BY src, bins, nsam),
ent AS (SELECT src, -sum(q * ln(q)) / ln(any_value(nsam)) AS ru FROM (SELECT src, nsam, count(*) / nsam AS q FROM o JOIN ns USING (src) WHERE nsam >= 4 GROUP BY src, nsam, o >> 8) GROUP BY src),
grid AS (SELECT src, unnest(range(hfirst, hlast + 1)) AS h FROM ac), ser AS (SELECT grid.src, grid.h, coalesce(rd.pk, 0)::DOUBLE AS v FROM grid LEFT JOIN rd USING (src, h)),
fan AS (SELECT src, CASE WHEN count(*) >= 3 AND avg(v) > 0 THEN var_pop(v) / avg(v) END AS fano, median(v) AS med, count(*) AS len FROM ser GROUP BY src),
up AS (SELECT src, h, v > med AS up FROM ser JOIN fan USING (src) WHERE v <> med), upl AS (SELECT *, lag(up) OVER (PARTITION BY src ORDER BY h) AS was FROM up),
rn AS (SELECT src, count(*) FILTER (WHERE up)::DOUBLE AS n1, count(*) FILTER (WHERE NOT up)::DOUBLE AS n2, 1 + count(*) FILTER (WHERE was IS NOT NULL AND up <> was) AS r FROM upl GROUP BY src),
ww0 AS (SELECT src, n1, n2, r, n1 + n2 AS n, 2 * n1 * n2 AS q FROM rn), ww AS (SELECT src, CASE WHEN len >= 6 AND n1 >= 2 AND n2 >= 2 AND q * (q - n) > 0 THEN 2 * {tail_sql('((r - (q / n + 1)) / sqrt(q * (q - n) / (n * n * (n - 1))))')} ELSE 1.0 END AS p_ww FROM fan LEFT JOIN ww0 USING (src)),
{mode_sql('ttl', 'CASE WHEN ttl <= 32 THEN 32 WHEN ttl <= 64 THEN 64 WHEN ttl <= 128 THEN 128 ELSE 255 END')}, {mode_sql('df', 'df')}, {mode_sql('win', 'win', 'proto = 6')}, {mode_sql('opts', 'optsig', 'proto = 6')}, {mode_sql('phead', 'phead', 'proto = 17')}, {mode_sql('dmode', f'dst - {CFG.d0}', f'dst {SPAN}')},
lg AS (SELECT *, (ipid - lag(ipid) OVER w + 65536) % 65536 AS di, TRY_CAST(sport AS BIGINT) - lag(TRY_CAST(sport AS BIGINT)) OVER (PARTITION BY src, sport <> '' ORDER BY pos) AS dp FROM (SELECT * FROM sam) WINDOW w AS (PARTITION BY src ORDER BY pos)),
cls AS (SELECT src, count(*) AS nn, median(ttl) AS ttl_med, CASE WHEN count(*) FILTER (WHERE ipid <> 54321) = 0 THEN 'ip54321' WHEN count(*) FILTER (WHERE ipid <> 0) = 0 THEN 'ip0' WHEN count(*) < 2 THEN 'ip1' WHEN count(DISTINCT ipid) = 1 THEN 'ipconst' WHEN count(*) FILTER (WHERE di BETWEEN 1 AND 2048) >= 0.8 * (count(*) - 1) THEN 'ipinc' ELSE 'iprand' END AS ipid,
 CASE WHEN count(*) FILTER (WHERE ipid <> 54321) = 0 THEN '54321' WHEN count(*) FILTER (WHERE ipid <> 0) = 0 THEN '0' ELSE 'x' END AS ipc,
 CASE WHEN count(*) FILTER (WHERE sport <> '') < 2 THEN 'sp1' WHEN count(DISTINCT sport) FILTER (WHERE sport <> '') = 1 THEN 'spfix' WHEN max(TRY_CAST(sport AS BIGINT)) - min(TRY_CAST(sport AS BIGINT)) < 64 THEN 'spnarrow' WHEN count(*) FILTER (WHERE dp BETWEEN 1 AND 64) >= 0.8 * (count(*) FILTER (WHERE sport <> '') - 1) THEN 'spinc' ELSE 'sprand' END AS sportp,
 CASE WHEN count(*) FILTER (WHERE seqrel = 'D') > 0.5 * count(*) THEN 'D' WHEN count(*) FILTER (WHERE seqrel = 'Z') > 0.5 * count(*) THEN 'Z' ELSE '-' END AS seqrel,
 CASE WHEN count(DISTINCT win) FILTER (WHERE proto = 6) = 1 AND min(win) FILTER (WHERE proto = 6) IN {fingerprints.KNOWN_WINDOWS} THEN min(win) FILTER (WHERE proto = 6) ELSE 'x' END AS winc FROM lg GROUP BY src),
pf0 AS (SELECT ac.*, coalesce(nsam, 0) AS nsam, coalesce(z_mk, 0.0) AS z_mk, CASE WHEN nsam >= 8 THEN 2 * {tail_sql('z_mk')} ELSE 1.0 END AS p_mk, chi2, {chi_tail_sql('chi2', 'bins')} AS p_chi, ru, fano, p_ww, hlast - hfirst + 1 AS span, stride_pos + stride_neg + stride_big AS steps,
 CASE WHEN stride_pos + stride_neg + stride_big > 0 THEN (stride_pos + stride_neg) / (stride_pos + stride_neg + stride_big) END AS frac_seq, CASE WHEN stride_pos + stride_neg > 0 THEN (stride_pos - stride_neg) / (stride_pos + stride_neg) ELSE 0.0 END AS dir_seq, CASE WHEN ud > 0 THEN ud24 / ud END AS rho,
 ttl, ttl - ttl_med AS hops, ipid, ipc, sportp, seqrel, winc, df, coalesce(win, '') AS win, coalesce(opts, '') AS opts, coalesce(phead, '') AS phead, coalesce(dmode, -1) AS dmode, coalesce(dmode_n, 0) AS dmode_k, CASE pm WHEN 1 THEN 'tcp' WHEN 2 THEN 'udp' WHEN 4 THEN 'icmp' ELSE 'mix' || pm END AS proto,
 lower(rdns || ' ' || org) AS low FROM ac LEFT JOIN ns USING (src) LEFT JOIN mkz USING (src) LEFT JOIN ch USING (src) LEFT JOIN ent USING (src) LEFT JOIN fan USING (src) LEFT JOIN ww USING (src) LEFT JOIN cls USING (src) LEFT JOIN m_ttl USING (src) LEFT JOIN m_df USING (src) LEFT JOIN m_win USING (src) LEFT JOIN m_opts USING (src) LEFT JOIN m_phead USING (src) LEFT JOIN m_dmode USING (src)),
prof AS (SELECT *, top3[1] AS top1, CASE WHEN nports <= 3 AND ports <= 3 THEN 'p' || array_to_string(list_sort(top3), '+') ELSE 'multi' END AS portsig, nact / span AS duty, pk / greatest(nact, 1) AS pph, least(1.0, ud / {CFG.d_size}) AS cov,
 CASE WHEN steps >= 3 AND frac_seq >= 0.7 THEN CASE WHEN dir_seq > 0 THEN 'seq_fwd' ELSE 'seq_rev' END WHEN nsam >= 8 AND p_mk < 0.005 THEN CASE WHEN z_mk > 0 THEN 'seq_fwd' ELSE 'seq_rev' END WHEN nsam >= 10 THEN CASE WHEN p_chi >= 0.05 THEN 'uperm' ELSE 'perm' END ELSE 'undet' END AS strategy,
 CASE WHEN ru IS NOT NULL THEN CASE WHEN ru >= 0.8 THEN 'dispersed' ELSE 'targeted' END WHEN rho >= 0.5 THEN 'dispersed' ELSE 'targeted' END AS disp,
 CASE WHEN proto = 'udp' THEN 'udp|t' || ttl || '|' || ipid || '|' || sportp || '|df' || df || '|ph' || substring(phead, 1, 4) ELSE proto || '|t' || ttl || '|' || ipid || '|w' || win || '|o' || CASE WHEN opts = '' THEN '-' ELSE opts END || '|s' || seqrel || '|' || sportp || '|df' || df END AS fp,
 CASE WHEN proto = 'udp' THEN 'udp|t' || ttl || '|df' || df || '|i' || ipc || '|ph' || substring(phead, 1, 4) ELSE proto || '|t' || ttl || '|df' || df || '|o' || CASE WHEN opts = '' THEN '-' ELSE opts END || '|s' || seqrel || '|i' || ipc || '|w' || winc END AS fpc,
 (contains(lower(rdns), 'scan') OR {' OR '.join(f"contains(low, '{w}')" for w in fingerprints.RESEARCH)})::BIGINT AS research FROM pf0 WHERE ud >= 2 OR nsam >= 2)"""


# ---------------------------------------------------------------- Spark side of the shared steps
#: Where a caller runs many queries over tables that don't change, a dict here lets them share written steps. None: every query makes its own.
KEPT: dict | None = None


def shared(make):  # noqa: ANN001, ANN201
    """A step whose frames are shared while KEPT is a dict."""

    def run(spark, d, scene=SCENE):  # noqa: ANN001, ANN202
        if KEPT is None:
            return make(spark, d, scene)
        key = (make.__name__, spark.sparkContext.applicationId, d, scene)
        if key not in KEPT:
            KEPT[key] = make(spark, d, scene)
        return KEPT[key]

    return run


def all_records(spark: SparkSession, d: str, scene: simulate.Scenario = SCENE) -> DataFrame:
    return records.simulated(spark, scene, START).select(*records.COLUMNS).unionByName(records.from_events(spark, d).withColumn("cc", scalar.clean(F.col("cc"), 48)))


@shared
def reduced(spark: SparkSession, d: str, scene: simulate.Scenario = SCENE) -> DataFrame:
    return stage(reduction.reduce_records(stage(all_records(spark, d, scene), "records")), "source-hours")


def accumulated(spark: SparkSession, d: str, scene: simulate.Scenario = SCENE) -> DataFrame:
    return reduction.accumulate(reduced(spark, d, scene))


@shared
def profiled(spark: SparkSession, d: str, scene: simulate.Scenario = SCENE) -> DataFrame:
    """Candidates' profiles, written once, as every query after them uses them several times."""
    return stage(fingerprints.candidates(fingerprints.profile(stage(accumulated(spark, d, scene), "sources"), CFG.d0, CFG.d_size)), "profiles")


# ---------------------------------------------------------------- queries: simulator, reduction, profiles
@query("sim_truth", f"WITH {simulate.bots_sql(SCENE)} SELECT src, camp, strategy, orchestrated, residue, cc, asn FROM bots")
def sim_truth(spark, d):
    """SRC16: who the simulated sources are."""
    return rounded(simulate.bots(spark, SCENE).drop("tool"))


@query("sim_packets", f"WITH {simulate.packets_sql(SCENE, START)} SELECT src, h, i, t, dport::BIGINT AS dport, proto::BIGINT AS proto, dst, sport, ttl::BIGINT AS ttl, ipid::BIGINT AS ipid, df::BIGINT AS df, win, optsig, seqrel, plen, phead, flag FROM sim_packets")
def sim_packets(spark, d):
    """SRC16: every simulated packet."""
    return rounded(simulate.packets(spark, SCENE, START).drop("camp", "cc", "asn"))


@query("sim_records", f"WITH {BASE}, n AS (SELECT src, h, n // 64 AS seq, count(*) AS sampled, sum(dst)::BIGINT AS dsts FROM smp GROUP BY ALL) SELECT rec.* EXCLUDE (port, pmask), port::BIGINT AS port, pmask::BIGINT AS pmask, sampled, dsts FROM rec JOIN n USING (src, h, seq)")
def sim_records(spark, d):
    """D1, SRC16, PRJ1: the records of the study."""
    r = all_records(spark, d)
    return rounded(r.select("*", F.size("samples").cast("bigint").alias("sampled"), F.aggregate("samples", F.lit(0).cast("bigint"), lambda t, s: t + s["dst"]).alias("dsts")).drop("samples"))


SAMPLES_TEXT = "coalesce(string_agg({x}, ';' ORDER BY t, n), '')"


@query("reduce_full", f"""WITH {REDUCED}, tp AS (SELECT h, src, string_agg(port || ':' || n, ',' ORDER BY n DESC, port) AS topports FROM p5 GROUP BY h, src), sa AS (SELECT h, src, string_agg(concat_ws(',', t, dport, proto, dst, sport, ttl, ipid, df, win, optsig, seqrel, plen, phead), ';' ORDER BY t, n) AS samples FROM s8 GROUP BY h, src)
 SELECT rd.* EXCLUDE (pmask), pmask::BIGINT AS pmask, topports, samples FROM rd JOIN tp USING (h, src) JOIN sa USING (h, src)""")
def reduce_full(spark, d):
    """Q1: AG1 to AG4, SO9; all 25 fields of a source-hour, samples and top ports as text."""
    r = reduced(spark, d)
    ports = F.array_join(F.transform(F.array_sort(F.transform(F.map_entries("topports"), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("p")))), lambda e: F.concat(e["p"].cast("string"), F.lit(":"), (-e["k"]).cast("string"))), ",")
    return rounded(r.withColumn("topports", ports).withColumn("samples", sample_text(F.col("samples"))))


def sample_text(samples):
    """The samples of a row as text, fields by commas and samples by semicolons."""
    return F.array_join(F.transform(samples, lambda s: F.concat_ws(",", *[s[k].cast("string") for k in records.SAMPLE_FIELDS[1:]])), ";")


@query("accumulate_full", f"""WITH {ACC}, ss AS (SELECT src, count(*) AS n_samples, sum(n)::BIGINT AS sample_sum FROM sam GROUP BY src) SELECT src, pm::BIGINT AS pm, nrec, nports, ports, array_to_string(top3, ',') AS top3, pk, bytes, ud, ud24, udmax, t0, t1, array_to_string(words, ',') AS words, hfirst, hlast, nact, zm, ms, mi, stride_pos, stride_neg, stride_big, asn, cc, org, rdns, n_samples, sample_sum FROM ac JOIN ss USING (src)""")
def accumulate_full(spark, d):
    """AG5, AG6: sources' sums, firsts, bitmaps and reservoir of 160."""
    a = accumulated(spark, d)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rounded(a.select("src", "pm", "nrec", "nports", "ports", text("top3"), "pk", "bytes", "ud", "ud24", "udmax", "t0", "t1", text("words"), "hfirst", "hlast", F.size("hour_pk").cast("bigint").alias("nact"), "zm", "ms", "mi", "stride_pos", "stride_neg", "stride_big", "asn", "cc", "org", "rdns",
                            F.size("samples").cast("bigint").alias("n_samples"), F.aggregate("samples", F.lit(0).cast("bigint"), lambda t, s: t + s["n"]).alias("sample_sum")))


@query("profile_tests", f"""WITH {PROF} SELECT src, nsam, round(fano, 6) AS fano, round(p_ww, 6) AS p_ww, round(z_mk, 6) AS z_mk, round(p_mk, 6) AS p_mk, round(chi2, 6) AS chi2, round(p_chi, 6) AS p_chi, round(frac_seq, 6) AS frac_seq, round(dir_seq, 6) AS dir_seq, strategy, round(ru, 6) AS ru, round(rho, 6) AS rho, disp, round(cov, 6) AS cov, round(duty, 6) AS duty, round(pph, 6) AS pph FROM prof""")
def profile_tests(spark, d):
    """Q2: ST1 to ST3 with p-values, SC14 to SC16, AG13, FIL6, FIL7."""
    return rounded(profiled(spark, d).select("src", "nsam", "fano", "p_ww", "z_mk", "p_mk", "chi2", "p_chi", "frac_seq", "dir_seq", "strategy", "ru", "rho", "disp", "cov", "duty", "pph"))


@query("profile_fingerprints", f"""WITH {PROF} SELECT src, portsig, top1::BIGINT AS top1, ttl::BIGINT AS ttl, CAST(trunc(hops) AS BIGINT) AS hops, ipid, win, opts, seqrel, sportp, df::BIGINT AS df, phead, fp, fpc, round(zm / nrec, 6) AS zmf, round(ms / nrec, 6) AS msf, round(mi / nrec, 6) AS mif, research, dmode, dmode_k FROM prof""")
def profile_fingerprints(spark, d):
    """Q2: PRJ2, PRJ3, SC7 to SC13, WN1, WN2, AG7."""
    return rounded(profiled(spark, d).select("src", "portsig", "top1", "ttl", "hops", "ipid", "win", "opts", "seqrel", "sportp", "df", "phead", "fp", "fpc", "zmf", "msf", "mif", "research", "dmode", "dmode_k"))


# ---------------------------------------------------------------- campaigns, residue, decisions
def pairs_sql(cfg: Config) -> str:
    """pairs and obs of the WITH members ``members`` and ``prof``."""
    place = lambda seed: scalar.draw_sql(f"camp * 7919 + d * 104729 + {seed}", "n")
    return f"""ord AS (SELECT camp, src, row_number() OVER (PARTITION BY camp ORDER BY src) - 1 AS o FROM members), sz AS (SELECT camp, count(*) AS n FROM members GROUP BY camp),
dr AS (SELECT camp, {place(cfg.seed)} AS i, {place(cfg.seed + 50_000_017)} AS j FROM (SELECT camp, n, unnest(range(1, {cfg.pairs} + 1)) AS d FROM sz WHERE n * (n - 1) / 2 > {cfg.pairs})),
pairs AS (SELECT x.camp, x.src AS a, y.src AS b FROM ord x JOIN ord y ON x.camp = y.camp AND x.o < y.o JOIN sz ON sz.camp = x.camp WHERE n * (n - 1) / 2 <= {cfg.pairs} UNION ALL SELECT dr.camp, x.src, y.src FROM dr JOIN ord x ON x.camp = dr.camp AND x.o = i JOIN ord y ON y.camp = dr.camp AND y.o = j WHERE i <> j),
obs AS (SELECT camp, count(*) AS n_pairs, avg({JAC('p.words', 'q.words')}) AS coact FROM pairs JOIN prof p ON p.src = a JOIN prof q ON q.src = b GROUP BY camp)"""


def rot_sql(cfg: Config, seed: int, draws: int) -> str:
    turn = lambda s: scalar.draw_sql(f"{s} * 7919 + k * 104729 + {seed}", "7")
    return f"""rt AS (SELECT camp, k, avg({JAC('wa', 'wb')}) AS t FROM (SELECT camp, k, {TURN('p.words', turn('a'))} AS wa, {TURN('q.words', turn('b'))} AS wb FROM pairs JOIN prof p ON p.src = a JOIN prof q ON q.src = b CROSS JOIN (SELECT unnest(range(1, {draws} + 1)) AS k)) GROUP BY camp, k), rot AS ({VERDICT('rot', 'rt')})"""


ONE_STAGE = replace(CFG, draws2=0, draws3=0)
PROF0 = PROF.replace("prof AS (SELECT *, top3[1]", "prof0 AS (SELECT *, top3[1]")
CAMPS = f"""{PROF0}, keyed AS (SELECT src, portsig || {DOT} || fpc AS key FROM prof0), members0 AS (SELECT src, key, camp FROM keyed JOIN (SELECT key, row_number() OVER (ORDER BY key) AS camp FROM keyed GROUP BY key HAVING count(*) >= {CFG.min_size}) USING (key)),
cvn AS (SELECT camp, dmode, count(*) AS n FROM members0 JOIN prof0 USING (src) WHERE dmode >= 0 GROUP BY camp, dmode), cvg AS (SELECT camp, sum(n)::BIGINT AS valid, max(n) AS most, first(dmode ORDER BY n DESC, dmode) AS top_dst FROM cvn GROUP BY camp),
conv AS (SELECT c.camp, coalesce(valid, 0) AS valid, coalesce(top_dst, -1) AS top_dst, CASE WHEN valid >= {CFG.residue_members} THEN most / valid ELSE 0.0 END AS conv, coalesce(valid >= {CFG.residue_members} AND most / valid >= {CFG.residue}, false) AS residue FROM (SELECT DISTINCT camp FROM members0) c LEFT JOIN cvg USING (camp))"""
TESTED = f"""{CAMPS}, members AS (SELECT * FROM members0 WHERE camp NOT IN (SELECT camp FROM conv WHERE residue)), prof AS (SELECT * FROM prof0 WHERE src NOT IN (SELECT src FROM members0 WHERE camp IN (SELECT camp FROM conv WHERE residue)))"""
TESTS = f"""{pairs_sql(CFG)}, {rot_sql(CFG, CFG.seed, CFG.draws)}, {tiers_sql(CFG.min_pool, country=True)}, {pop_sql(CFG.min_pool, CFG.draws, CFG.seed, country=True)},
dt AS (SELECT tp.camp, coalesce(peers, 0) >= tp.m AS testable, coalesce(coact, 0.0) AS coact, coalesce(p_rot, 1.0) AS p_rot, coalesce(z_rot, 0.0) AS z_rot, CASE WHEN coalesce(peers, 0) >= tp.m THEN coalesce(p_pop, 1.0) ELSE 1.0 END AS p_pop, CASE WHEN coalesce(peers, 0) >= tp.m THEN coalesce(z_pop, 0.0) ELSE 0.0 END AS z_pop
 FROM tp LEFT JOIN pc USING (camp) LEFT JOIN obs USING (camp) LEFT JOIN rot USING (camp) LEFT JOIN pop USING (camp)),
dk AS (SELECT *, greatest(p_rot, p_pop) AS p, least(z_rot, z_pop) AS z, row_number() OVER (ORDER BY greatest(p_rot, p_pop)) AS k1, row_number() OVER (ORDER BY p_rot) AS k2, count(*) OVER () AS n FROM dt),
tests AS (SELECT camp, false AS residue, testable, coact, p_rot, z_rot, p_pop, z_pop, p, z, coalesce(p <= (SELECT max(p) FROM dk WHERE p <= {CFG.q} * k1 / n), false) AS orchestrated, coalesce(p_rot <= (SELECT max(p_rot) FROM dk WHERE p_rot <= {CFG.q} * k2 / n), false) AS orchestrated_rot FROM dk)"""
DECIDED = f"""{TESTED}, {TESTS}, decided AS (SELECT * FROM tests UNION ALL SELECT camp, true, false, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, false, false FROM conv WHERE residue)"""


@shared
def campaigned(spark: SparkSession, d: str, scene: simulate.Scenario = SCENE) -> tuple[DataFrame, DataFrame]:
    """Profiles and members, campaigns being blocks."""
    p = profiled(spark, d, scene)
    return p, stage(inference.campaigns(p, CFG, use_modes=False), "campaigns")


def decided(p: DataFrame, members: DataFrame, cfg: Config = ONE_STAGE) -> DataFrame:
    """Decisions of campaigns, residue left out; shared like the steps above for the frames of campaigned()."""
    key = ("decided", id(p), id(members), cfg)
    if KEPT is not None and key in KEPT:
        return KEPT[key][0]
    bad = stage(inference.convergence(p, members, cfg), "convergence").filter("residue")
    out = stage(synchrony.decide_staged(p, members.select("src", "camp"), bad, cfg), "decisions")
    if KEPT is not None:
        KEPT[key] = (out, p, members)
    return out


FEATURE_SQL = f"""log10(greatest(pph, 0.001)) AS l_pph, log10(greatest(ud, 1)) AS l_ud, duty AS duty_f, coalesce(rho, 0.5) AS rho_c, coalesce(ru, 0.5) AS ru_c, coalesce(frac_seq, 0.0) AS frac_seq_c, dir_seq AS dir_seq_f, log10(greatest(nports, 1)) AS l_nports,
 {', '.join(f"CASE WHEN strategy = 'undet' THEN 0.25 WHEN strategy = '{s}' THEN 1.0 ELSE 0.0 END AS st_{s}" for s in ('seq_fwd', 'seq_rev', 'uperm', 'perm'))}, CASE WHEN ipid = 'ipinc' THEN 1.0 WHEN ipid IN ('ip1', 'na') THEN 0.5 ELSE 0.0 END AS ipinc_n, CASE WHEN sportp IN ('spfix', 'spnarrow') THEN 1.0 WHEN sportp = 'sp1' THEN 0.5 ELSE 0.0 END AS spstable_n"""


@query("study_features", f"WITH {PROF}, f AS (SELECT src, {FEATURE_SQL} FROM prof) SELECT src, {', '.join(f'round(CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END, 5) AS {c}' for c in inference.used_features())} FROM f")
def study_features(spark, d):
    """SC34, SC35: the 14 features, standardised."""
    names = inference.used_features()
    return rounded(inference.standardised(inference.features(profiled(spark, d)), names).select("src", *names), 5)


@query("study_campaigns", f"WITH {CAMPS} SELECT src, key, camp::BIGINT AS camp FROM members0")
def study_campaigns(spark, d):
    """CL1, FIL9: blocks by port signature and core fingerprint."""
    return rounded(campaigned(spark, d)[1].select("src", "key", "camp"))


def _ablation(drop: tuple[str, ...], use_fp: bool, key: str):
    name = "study_blocks_" + ("no_" + "_".join(drop) if drop else "ports")

    @query(name, f"WITH {PROF0}, keyed AS (SELECT src, {key} AS key FROM prof0) SELECT src, key, camp::BIGINT AS camp FROM keyed JOIN (SELECT key, row_number() OVER (ORDER BY key) AS camp FROM keyed GROUP BY key HAVING count(*) >= {CFG.min_size}) USING (key)")
    def run(spark, d):
        """CL4: the blocks of an ablation."""
        return rounded(inference.campaigns(profiled(spark, d), CFG, drop=drop, use_fp=use_fp, use_modes=False).select("src", "key", "camp"))


_ablation(("targets",), True, "fpc")
_ablation(("fingerprint",), True, "portsig")
_ablation(("targets", "fingerprint"), True, "CAST(pm AS VARCHAR)")


@query("study_port_onset", f"WITH {PROF0}, keyed AS (SELECT src, portsig || '|' || hfirst AS key FROM prof0) SELECT src, key, camp::BIGINT AS camp FROM keyed JOIN (SELECT key, row_number() OVER (ORDER BY key) AS camp FROM keyed GROUP BY key HAVING count(*) >= 3) USING (key)")
def study_port_onset(spark, d):
    """CL5."""
    return rounded(inference.port_onset(profiled(spark, d), 3))


@query("study_residue", f"WITH {CAMPS} SELECT camp::BIGINT AS camp, valid, top_dst, round(conv, 6) AS conv, residue FROM conv")
def study_residue(spark, d):
    """AG25, FIL10: whose members converge on one address."""
    return rounded(inference.convergence(*campaigned(spark, d), CFG))


@query("study_decisions", f"WITH {DECIDED} SELECT camp::BIGINT AS camp, residue, testable, round(coact, 6) AS coact, round(p_rot, 6) AS p_rot, round(z_rot, 4) AS z_rot, round(p_pop, 6) AS p_pop, round(z_pop, 4) AS z_pop, round(p, 6) AS p, round(z, 4) AS z, CASE WHEN testable THEN orchestrated END AS orchestrated, orchestrated_rot FROM decided")
def study_decisions(spark, d):
    """Q3: ST5 to ST9, ST11 to ST14, JN6, JN12, MX3: both nulls with residue left out, peers of a member's country first; undetermined where a port has too few peers."""
    r = decided(*campaigned(spark, d))
    r = r.withColumn("orchestrated", F.when(F.col("testable"), F.col("orchestrated")))
    return rounded(r.withColumns({c: F.round(c, 4) for c in ("z_rot", "z_pop", "z")}))


@query("study_decisions_modes")
def study_decisions_modes(spark, d):
    """Q3 in full: density modes of blocks, residue, draws refined in three stages. No SQL for the modes; tests hold it against the scenario's truth."""
    p = profiled(spark, d)
    m = stage(inference.campaigns(p, CFG), "campaigns")
    return rounded(decided(p, m, replace(CFG, pairs=600, draws=200)))


@query("study_scores", f"""WITH {DECIDED}, t AS (SELECT bots.src, bots.camp AS truth, bots.strategy, prof0.strategy AS told, orchestrated AS is_orch, members0.camp FROM bots JOIN prof0 USING (src) LEFT JOIN members0 USING (src) WHERE bots.camp >= 0), x AS (SELECT *, coalesce(camp, -1 - src) AS pred FROM t),
cell AS (SELECT truth, pred, count(*) AS n, sum(count(*)) OVER (PARTITION BY truth) AS nt, sum(count(*)) OVER (PARTITION BY pred) AS np FROM x GROUP BY truth, pred), a AS (SELECT DISTINCT truth, nt FROM cell), b AS (SELECT DISTINCT pred, np FROM cell),
s AS (SELECT sum(n)::DOUBLE AS n, sum(n * (n - 1) / 2)::DOUBLE AS sij, sum(n * ln(n)) AS lij FROM cell), sa AS (SELECT sum(nt * (nt - 1) / 2)::DOUBLE AS si, sum(nt * ln(nt)) AS li FROM a), sb AS (SELECT sum(np * (np - 1) / 2)::DOUBLE AS sj, sum(np * ln(np)) AS lj FROM b),
fl AS (SELECT camp, count(*) AS np FROM members0 GROUP BY camp), tn AS (SELECT truth, count(*) AS nt FROM t GROUP BY truth), pr AS (SELECT truth, camp, count(*) AS k FROM t GROUP BY truth, camp),
b3 AS (SELECT sum(CASE WHEN camp IS NULL THEN k ELSE k * k / np END) AS sp, sum(CASE WHEN camp IS NULL THEN k / nt ELSE k * k / nt END) AS sr FROM pr JOIN tn USING (truth) LEFT JOIN fl USING (camp)),
rec1 AS (SELECT tn.truth, max(camp) AS camp FROM tn LEFT JOIN (SELECT truth, camp FROM pr JOIN fl USING (camp) JOIN tn USING (truth) WHERE k >= 0.5 * nt AND k >= 0.5 * np) h USING (truth) GROUP BY tn.truth),
rr AS (SELECT rec1.*, is_orch, coalesce(orchestrated, false) AS o, coalesce(orchestrated_rot, false) AS orot FROM rec1 JOIN (SELECT truth, bool_or(is_orch) AS is_orch FROM t GROUP BY truth) USING (truth) LEFT JOIN decided USING (camp)),
rt2 AS (SELECT avg((camp IS NOT NULL)::INT) AS campaign_recall, {', '.join(f"count(*) FILTER (WHERE camp IS NOT NULL AND is_orch = {y} AND {c}) / nullif(count(*) FILTER (WHERE camp IS NOT NULL AND is_orch = {y}), 0) AS {n}" for n, c, y in (('tpr', 'o', 'true'), ('fpr', 'o', 'false'), ('tpr_rot', 'orot', 'true'), ('fpr_rot', 'orot', 'false')))} FROM rr),
ac2 AS (SELECT avg((strategy = told)::INT) AS strategy_acc, avg((strategy = told)::INT) FILTER (WHERE told <> 'undet') AS strategy_acc_det, count(*) AS n_syn FROM t)
SELECT round((sij - si * sj / (n * (n - 1) / 2)) / ((si + sj) / 2 - si * sj / (n * (n - 1) / 2)), 6) AS ari, round((lij / n - li / n - lj / n + ln(n)) / ((ln(n) - li / n + ln(n) - lj / n) / 2), 6) AS nmi, round(sp / n, 6) AS b3_p, round(sr / n, 6) AS b3_r, round(2 * (sp / n) * (sr / n) / (sp / n + sr / n), 6) AS b3_f1,
 round(campaign_recall, 6) AS campaign_recall, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(tpr_rot, 6) AS tpr_rot, round(fpr_rot, 6) AS fpr_rot, round(strategy_acc, 6) AS strategy_acc, round(strategy_acc_det, 6) AS strategy_acc_det, n_syn FROM s, sa, sb, b3, rt2, ac2""")
def study_scores(spark, d):
    """Q16, ST26: how well campaigns and decisions meet the scenario's truth."""
    p, m = campaigned(spark, d)
    truth = simulate.bots(spark, SCENE).filter("camp >= 0").select("src", F.col("camp").alias("truth"), "strategy", "orchestrated")
    return rounded(inference.evaluate(p, truth, m, decided(p, m)))


FLAG = "CASE WHEN ms / nrec > 0.5 THEN 'masscan' WHEN zm / nrec > 0.5 THEN 'zmap' WHEN mi / nrec > 0.5 THEN 'mirai' ELSE 'none' END"


def top_sql(name: str, value: str, k: int) -> str:
    return f"{name} AS (SELECT camp, v, n, r FROM (SELECT camp, {value} AS v, count(*) AS n, row_number() OVER (PARTITION BY camp ORDER BY count(*) DESC, {value}) AS r FROM mp GROUP BY camp, {value}) WHERE r <= {k})"


@query("study_signature", f"""WITH {CAMPS}, mp AS (SELECT * FROM members0 JOIN prof0 USING (src)), {', '.join(top_sql('t_' + c, v, k) for c, v, k in (('portsig', 'portsig', 1), ('pm', 'pm', 1), ('phead', 'phead', 1), ('fp', 'fp', 1), ('strategy', 'strategy', 3), ('disp', 'disp', 1), ('ipid', 'ipid', 1), ('ttl', 'ttl', 1), ('sportp', 'sportp', 1), ('cc', 'cc', 3), ('org', 'org', 3)))},
 g AS (SELECT camp, count(*) AS bots, round(median(pph), 6) AS pph_med, sum(ud)::BIGINT AS ud_sum, round(least(1.0, sum(ud) / {CFG.d_size}), 6) AS cov_union_ub, round(median(duty), 6) AS duty_med, median(hfirst)::DOUBLE AS hfirst_med, median(hlast)::DOUBLE AS hlast_med, count(DISTINCT asn) AS n_asn, count(DISTINCT cc) AS n_cc,
 {', '.join(f'round(avg(({c} / nrec > 0.5)::INT), 6) AS {a}' for a, c in (('zmap', 'zm'), ('masscan', 'ms'), ('mirai', 'mi')))}, round(avg(research), 6) AS research FROM mp GROUP BY camp)
 SELECT g.* REPLACE (g.camp::BIGINT AS camp), (SELECT v FROM t_portsig t WHERE t.camp = g.camp) AS portsig, (SELECT v::BIGINT FROM t_pm t WHERE t.camp = g.camp) AS proto, (SELECT v FROM t_phead t WHERE t.camp = g.camp) AS phead, {', '.join(f"(SELECT string_agg(v || '=' || round(n / g.bots, 3)::DOUBLE, ' ' ORDER BY r) FROM t_{c} t WHERE t.camp = g.camp) AS top_{c}" for c in ('fp', 'strategy', 'disp', 'ipid', 'ttl', 'sportp', 'cc', 'org'))} FROM g""")
def study_signature(spark, d):
    """AG16: 24 fields; (value, share) lists as text."""
    s = inference.signature(*campaigned(spark, d), CFG.d_size)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit("="), F.round(x["share"], 3).cast("string"))), " ")
    return rounded(s.withColumns({c: text(c) for c in s.columns if c.startswith("top_")}))


@query("study_landscape", f"""WITH {DECIDED}, mp AS (SELECT *, {FLAG} AS flag FROM members0 JOIN prof0 USING (src)), {', '.join(top_sql('t_' + c, c, k) for c, k in (('portsig', 1), ('pm', 1), ('fpc', 1), ('strategy', 1), ('flag', 1), ('cc', 3), ('org', 2)))},
 g AS (SELECT camp, count(*) AS bots, round(median(pph), 6) AS pph_med, sum(ud)::BIGINT AS ud_sum, median(span)::DOUBLE AS span_med, min(hfirst) AS hfirst_min, max(hlast) AS hlast_max, count(DISTINCT cc) AS n_cc, count(DISTINCT asn) AS n_asn, round(avg(research), 6) AS research FROM mp GROUP BY camp)
 SELECT g.* REPLACE (g.camp::BIGINT AS camp), {', '.join(f"(SELECT v FROM t_{c} t WHERE t.camp = g.camp) AS {a}" for c, a in (('portsig', 'portsig'), ('fpc', 'fpc'), ('strategy', 'strategy'), ('flag', 'flag')))}, (SELECT v::BIGINT FROM t_pm t WHERE t.camp = g.camp) AS proto, (SELECT round(n / g.bots, 6) FROM t_flag t WHERE t.camp = g.camp) AS flag_share,
 {', '.join(f"(SELECT string_agg(v || ':' || n, ' ' ORDER BY r) FROM t_{c} t WHERE t.camp = g.camp) AS top_{c}" for c in ('cc', 'org'))}, residue, testable, orchestrated, orchestrated_rot, round(conv, 6) AS conv, {', '.join(f'round({c}, {n}) AS {c}' for c, n in (('coact', 6), ('p', 6), ('p_rot', 6), ('p_pop', 6), ('z', 4), ('z_rot', 4), ('z_pop', 4)))} FROM g JOIN decided USING (camp) JOIN (SELECT camp, conv FROM conv) USING (camp)""")
def study_landscape(spark, d):
    """Q4, AG17: 30 fields of each campaign."""
    p, m = campaigned(spark, d)
    s = inference.landscape(p, m, decided(p, m)).join(inference.convergence(p, m, CFG).select("camp", "conv"), "camp")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("v")))), lambda e: F.concat(e["v"], F.lit(":"), (-e["k"]).cast("string"))), " ")
    return rounded(s.withColumns({c: text(c) for c in ("top_cc", "top_org")} | {c: F.round(c, 4) for c in ("z", "z_rot", "z_pop")}))


@query("study_weak_labels", f"""WITH {CAMPS}, x AS (SELECT {FLAG} AS flag, coalesce(camp, -1 - src) AS pred, camp FROM prof0 LEFT JOIN members0 USING (src) WHERE {FLAG} <> 'none'), c AS (SELECT flag, pred, count(*) AS n, sum(count(*)) OVER (PARTITION BY flag) AS nt, sum(count(*)) OVER (PARTITION BY pred) AS np FROM x GROUP BY flag, pred),
 s AS (SELECT sum(n)::DOUBLE AS n, sum(n * ln(n / np)) AS htp, sum(n * ln(n / nt)) AS hpt FROM c), a AS (SELECT sum(nt * ln(nt)) AS lt FROM (SELECT DISTINCT flag, nt FROM c)), b AS (SELECT sum(np * ln(np)) AS lp FROM (SELECT DISTINCT pred, np FROM c)),
 y AS (SELECT 1 + htp / n / (ln(n) - lt / n) AS h, 1 + hpt / n / (ln(n) - lp / n) AS k FROM s, a, b) SELECT round(h, 6) AS homogeneity, round(k, 6) AS completeness, round(2 * h * k / (h + k), 6) AS v_measure, (SELECT count(*) FROM x) AS flagged, round((SELECT avg((camp IS NOT NULL)::INT) FROM x), 6) AS flagged_covered FROM y""")
def study_weak_labels(spark, d):
    """ST27, PRJ2."""
    return rounded(inference.weak_label_scores(*campaigned(spark, d)))


@query("study_strategy_mix", f"WITH {PROF} SELECT strategy, {FLAG} AS flag, count(*) AS sources FROM prof GROUP BY ALL")
def study_strategy_mix(spark, d):
    """Q5: SC16's strategies and PRJ2's tool flags, counted."""
    return rounded(profiled(spark, d).groupBy("strategy", inference.tool_flag().alias("flag")).agg(F.count("*").alias("sources")))


@query("study_bursts", f"""WITH RECURSIVE {PROF0}, keyed AS (SELECT src, portsig || {DOT} || fpc AS key FROM prof0), onh AS (SELECT key, hfirst AS h, count(*) AS n FROM keyed JOIN prof0 USING (src) WHERE hfirst >= 2 GROUP BY ALL), blk AS (SELECT key FROM onh GROUP BY key HAVING sum(n) >= 5),
 cnt AS (SELECT key, h.h, coalesce(n, 0) AS n FROM blk CROSS JOIN (SELECT unnest(range(2, 168)) AS h) h LEFT JOIN onh USING (key, h)), lam AS (SELECT key, greatest(median(n), 0.25) * 3 AS lam FROM cnt GROUP BY key),
 win AS (SELECT key, h, sum(n) OVER (PARTITION BY key ORDER BY h ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)::BIGINT AS k FROM cnt), cand AS (SELECT key, h, k, lam FROM win JOIN lam USING (key) WHERE k >= 5 AND h <= 165),
 pv AS (SELECT key, h, k, (k - lam) / sqrt(lam) AS z, least(1.0, list_sum([exp(j * ln(lam) - lam - lgamma(j + 1)) FOR j IN range(k, k + 200)])) AS p FROM cand), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p, h) AS r FROM pv),
 pick(key, r, hs) AS (SELECT key, 0::BIGINT, []::BIGINT[] FROM blk UNION ALL SELECT pick.key, ranked.r, CASE WHEN len(list_filter(hs, lambda x: abs(x - ranked.h) < 3)) = 0 THEN list_append(hs, ranked.h) ELSE hs END FROM pick JOIN ranked ON ranked.key = pick.key AND ranked.r = pick.r + 1),
 fin AS (SELECT key, unnest(arg_max(hs, r)) AS h FROM pick GROUP BY key) SELECT key, h, k, round(z, 4) AS z, round(ln(p), 4) AS ln_p FROM fin JOIN pv USING (key, h)""")
def study_bursts(spark, d):
    """ST15, WN5, WN6."""
    p = profiled(spark, d)
    b = inference.onset_bursts(p, p.select("src", inference.block_key().alias("key")), 168, 5)
    # A tail too small for a double is 0. Its logarithm is SQL's -inf, where Spark's is null.
    ln_p = F.when(F.col("p") == 0, F.lit(float("-inf"))).otherwise(F.log("p"))
    return rounded(b.select("key", "h", "k", F.round("z", 4).alias("z"), F.round(ln_p, 4).alias("ln_p")))


@query("study_burst_roles")
def study_burst_roles(spark, d):
    """CL6: which bursts flag a campaign and which are extracted from one."""
    p, m = campaigned(spark, d)
    keyed = p.select("src", inference.block_key().alias("key"))
    return rounded(inference.burst_roles(stage(inference.onset_bursts(p, keyed, 168, 5), "bursts"), p, keyed, m, CFG))


PAYLOAD = """CASE WHEN port = 53 THEN 'dns' WHEN phead = '' THEN 'empty' WHEN regexp_matches(phead, '^643[12]3a') THEN 'bittorrent-dht' WHEN regexp_matches(phead, '^[0-4]10[012]') THEN 'utp' WHEN regexp_matches(phead, '^e[45]') THEN 'kad' WHEN substring(phead, 9, 8) = '2112a442' THEN 'stun'
 WHEN regexp_matches(phead, '^(4f505449|52454749|494e5649|5349502f)') THEN 'sip' WHEN phead LIKE '4d2d5345%' THEN 'ssdp' WHEN regexp_matches(phead, '^([2-6][0-9a-f]|7[0-9a-e]){4,}$') THEN 'ascii-other' ELSE 'binary-other' END"""
CHARACTER = f"""{DECIDED}, mp0 AS (SELECT * FROM members0 JOIN prof0 USING (src)), mport AS (SELECT camp, port, bots FROM (SELECT camp, top1 AS port, sum(count(*)) OVER (PARTITION BY camp) AS bots, row_number() OVER (PARTITION BY camp ORDER BY count(*) DESC, top1) AS r FROM mp0 GROUP BY camp, top1) WHERE r = 1 AND bots >= 8),
 mp AS (SELECT mp0.*, port, {PAYLOAD} AS payload FROM mp0 JOIN mport USING (camp)), {top_sql('t_payload', 'payload', 1)}, {top_sql('t_pm', 'pm', 1)}, hm AS (SELECT camp, min(hfirst) AS h1, max(hfirst) AS h_m FROM (SELECT camp, hfirst, row_number() OVER (PARTITION BY camp ORDER BY hfirst, src) AS r FROM mp) WHERE r <= 8 GROUP BY camp),
 ch2 AS (SELECT camp, any_value(port)::BIGINT AS port, count(*) AS bots, median(ud)::DOUBLE AS ud_med, median(ud24)::DOUBLE AS ud24_med, avg((ud <= 1)::INT) AS frac_ud1, count(DISTINCT src >> 8) AS n_src24, count(DISTINCT asn) AS n_asn, count(DISTINCT cc) AS n_cc, avg(research) AS research, median(span)::DOUBLE AS span_med, max(hlast) - min(hfirst) + 1 AS dur FROM mp GROUP BY camp),
 chr AS (SELECT ch2.*, t_pm.v::BIGINT AS proto, t_payload.v AS payload, t_payload.n / bots AS payload_share, h1, h_m, residue, testable, orchestrated FROM ch2 JOIN t_pm USING (camp) JOIN t_payload USING (camp) JOIN hm USING (camp) JOIN decided USING (camp))"""


@query("study_characters", f"WITH {CHARACTER} SELECT * REPLACE (camp::BIGINT AS camp, round(frac_ud1, 6) AS frac_ud1, round(research, 6) AS research, round(payload_share, 6) AS payload_share) FROM chr")
def study_characters(spark, d):
    """AG18, MX23, SC21, SC29."""
    p, m = campaigned(spark, d)
    return rounded(inference.characterise(p, m, decided(p, m).select("camp", "residue", "testable", "orchestrated"), scalar.payload_class, 8))


def _subset(name: str, test: str) -> str:
    w = "CASE WHEN h1 >= 24 THEN h_m - h1 END"
    return f"""SELECT '{name}' AS subset, count(*) AS n, sum(bots)::BIGINT AS bots, round(avg((proto = 1)::INT), 6) AS tcp, round(avg((proto = 2)::INT), 6) AS udp, round(sum(CASE WHEN proto = 1 THEN bots ELSE 0 END) / sum(bots), 6) AS tcp_bots, round(sum(CASE WHEN proto = 2 THEN bots ELSE 0 END) / sum(bots), 6) AS udp_bots, round(median(ud_med), 6) AS ud_med_median,
 round(avg((ud_med >= 3)::INT), 6) AS spread_ge3, round(avg((ud_med <= 1)::INT), 6) AS single_addr, round(avg((n_src24 = 1)::INT), 6) AS one_src24, round(avg((n_asn = 1)::INT), 6) AS one_asn, round(avg((n_cc = 1)::INT), 6) AS one_cc, round(avg((research >= 0.5)::INT), 6) AS research_half, round(median(span_med), 6) AS span_med_median,
 count({w}) AS waits, round(median({w}), 6) AS wait_median, round(quantile_cont({w}, 0.75), 6) AS wait_p75, round(quantile_cont({w}, 0.9), 6) AS wait_p90 FROM chr WHERE {test}"""


@query("study_character_summary", f"WITH {CHARACTER} {' UNION ALL '.join(_subset(n, t) for n, t in (('orchestrated', 'orchestrated'), ('not_orchestrated_testable', 'testable AND NOT orchestrated'), ('all', 'true'), ('residue', 'residue'), ('scanning', 'NOT residue')))}")
def study_character_summary(spark, d):
    """Q10, FIL10: shares and waits of orchestrated, other testable, residue and scanning campaigns."""
    p, m = campaigned(spark, d)
    rows = stage(inference.characterise(p, m, decided(p, m).select("camp", "residue", "testable", "orchestrated"), scalar.payload_class, 8), "characters")
    subsets = {"orchestrated": F.col("orchestrated"), "not_orchestrated_testable": F.col("testable") & ~F.col("orchestrated"), "all": F.lit(True), "residue": F.col("residue"), "scanning": ~F.col("residue")}
    return rounded(inference.summary(rows, subsets))
