"""Controls and robustness of the study's decisions (ST17-ST24, ST28), with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import bitmap, scalar
from ..operators import controls, inference, synchrony
from ..operators.stage import stage
from .queries import JAC, TURN, query, rounded
from .study import CAMPS, CFG, DECIDED, ONE_STAGE, TESTED, TESTS, campaigned, decided, profiled, tail_sql

FLOOR = 1 / (CFG.draws + 1)


def _tested(spark, d):
    """Profiles without residue, members of campaigns that are none, decisions."""
    p, m = campaigned(spark, d)
    dec = decided(p, m)
    bad = stage(m.join(dec.filter("residue").select("camp"), "camp", "left_semi").select("src", "camp"), "residue")
    return stage(p.join(bad, "src", "left_anti"), "clean"), stage(m.join(bad.select("camp").distinct(), "camp", "left_anti"), "tested"), dec


RATES = "count(*) AS tests, count(*) FILTER (WHERE orchestrated) AS flagged, count(*) FILTER (WHERE orchestrated_rot) AS flagged_rot, round(avg(orchestrated::INT), 6) AS rate, " + ", ".join(f"round(avg(({c} < {a})::INT), 6) AS {c}_lt_{str(a)[2:]}" for c in ("p", "p_rot") for a in (0.05, 0.01)) + ", " + ", ".join(f"count(*) FILTER (WHERE {c} <= {FLOOR!r} + 1e-12) AS {c}_floor" for c in ("p", "p_rot"))


@query("study_raw_rates", f"WITH {DECIDED} SELECT {RATES} FROM decided WHERE NOT residue")
def study_raw_rates(spark, d):
    """ST24."""
    return rounded(controls.raw_rates(decided(*campaigned(spark, d)).filter("not residue"), FLOOR))


def control_sql(country: bool) -> str:
    """The pseudo-campaigns of the WITH members ``decided``, ``members`` and ``prof``, and their own tests."""
    by, cc = ("port, cc", "AND o.cc = c.cc") if country else ("port", "")
    most = lambda c: f"(SELECT v FROM (SELECT camp, {c} AS v, row_number() OVER (PARTITION BY camp ORDER BY count(*) DESC, {c}) AS r FROM nm GROUP BY camp, {c}) x WHERE x.camp = g.camp AND r = 1)"
    return f"""nm AS (SELECT members.camp, src, top1 AS port, cc FROM members JOIN prof USING (src) WHERE camp IN (SELECT camp FROM decided WHERE testable AND NOT residue)),
nc AS (SELECT camp, m, {most('port')} AS port{', ' + most('cc') + ' AS cc' if country else ''} FROM (SELECT camp, count(*) AS m FROM nm GROUP BY camp) g), no AS (SELECT c.camp, count(o.src) AS own FROM nc c LEFT JOIN nm o ON o.camp = c.camp AND o.port = c.port {cc} GROUP BY c.camp),
nn AS (SELECT src, top1 AS port, cc, row_number() OVER (PARTITION BY top1{', cc' if country else ''} ORDER BY src % 64, src) - 1 AS r, count(*) OVER (PARTITION BY top1{', cc' if country else ''}) AS pop FROM prof), np AS (SELECT DISTINCT {by}, pop FROM nn),
nw AS (SELECT camp, m, {by}, pop, unnest(range(0, m + own)) AS i FROM nc JOIN no USING (camp) JOIN np USING ({by}) WHERE pop - own >= m),
ng AS (SELECT camp, m, {by}, i, ({scalar.draw_sql('camp * 7919 + 11', 'pop')} + i * (2147483647 % pop)) % pop AS r FROM nw), nf AS (SELECT ng.camp, m, i, nn.src FROM ng JOIN nn USING ({by}, r) WHERE NOT EXISTS (SELECT 1 FROM members x WHERE x.camp = ng.camp AND x.src = nn.src)),
pseudo AS (SELECT camp, src FROM (SELECT camp, src, m, row_number() OVER (PARTITION BY camp ORDER BY i) AS k FROM nf) WHERE k <= m),
pcn AS (SELECT camp, dmode, count(*) AS n FROM pseudo JOIN prof USING (src) WHERE dmode >= 0 GROUP BY camp, dmode), pres AS (SELECT camp FROM pcn GROUP BY camp HAVING sum(n) >= {CFG.residue_members} AND max(n) / sum(n) >= {CFG.residue}),
kept AS (SELECT * FROM pseudo WHERE camp NOT IN (SELECT camp FROM pres))"""


def _control(name: str, country: bool):
    @query(name, f"WITH {DECIDED}, {control_sql(country)} SELECT {RATES}, (SELECT count(*) FROM pres) AS residue_skipped FROM (WITH members AS (SELECT camp, src FROM kept), {TESTS} SELECT * FROM tests)")
    def run(spark, d):
        """ST17 (same port) and ST18 (same port and country): pseudo-campaigns of unrelated sources through the same test."""
        p, m = campaigned(spark, d)
        tests, skipped = controls.negative_control(p, m, decided(p, m), ONE_STAGE, country=country)
        return rounded(controls.raw_rates(tests, FLOOR).crossJoin(skipped.agg(F.count("*").alias("residue_skipped"))))


_control("study_negative_control", False)
_control("study_country_control", True)


def _ratio(key: str, value: str, ratio: float) -> str:
    return f"""SELECT '{key}' AS key, {ratio}::DOUBLE AS ratio, count(*) AS campaigns, count(*) FILTER (WHERE peers >= m * {ratio}) AS testable, round(avg((peers >= m * {ratio})::INT), 6) AS share FROM (SELECT c.camp, c.m, c.port, (SELECT count(*) FROM prof q WHERE q.{value} = c.port AND NOT EXISTS (SELECT 1 FROM members x WHERE x.camp = c.camp AND x.src = q.src)) AS peers
 FROM (SELECT camp, {value} AS port, sum(count(*)) OVER (PARTITION BY camp) AS m, row_number() OVER (PARTITION BY camp ORDER BY count(*) DESC, {value}) AS r FROM members JOIN prof USING (src) GROUP BY camp, {value}) c WHERE r = 1)"""


@query("study_ratio_diagnostic", f"WITH {TESTED} {' UNION ALL '.join(_ratio(k, k, r) for k in ('top1', 'portsig') for r in (1, 2, 5))}")
def study_ratio_diagnostic(spark, d):
    """ST19, ST12."""
    p, m = campaigned(spark, d)
    bad = stage(m.join(inference.convergence(p, m, CFG).filter("residue").select("camp"), "camp", "left_semi").select("src", "camp"), "residue")
    p, m = stage(p.join(bad, "src", "left_anti"), "clean"), stage(m.join(bad.select("camp").distinct(), "camp", "left_anti"), "tested")
    return rounded(controls.ratio_diagnostic(p, m, [1, 2, 5], {"top1": F.col("top1"), "portsig": F.col("portsig")}))


WORD7 = ", ".join(f"coalesce(bit_or(CASE WHEN h // 24 = {k} THEN 1::BIGINT << (h % 24)::INTEGER END), 0)" for k in range(7))


@query("study_resampled", f"""WITH {CAMPS}, act AS (SELECT prof0.src, top1, rd.h FROM prof0 JOIN rd USING (src)), w AS (SELECT top1, h, count(*) AS w FROM act GROUP BY ALL), g AS (SELECT t.top1, u.h, ln(coalesce(w, 0) + 0.001) AS logw FROM (SELECT DISTINCT top1 FROM prof0) t CROSS JOIN (SELECT unnest(range(0, 168)) AS h) u LEFT JOIN w USING (top1, h)),
 r AS (SELECT src, nact, h, row_number() OVER (PARTITION BY src ORDER BY round(logw - ln(-ln(({scalar.draw_sql('src * 7919 + h * 104729 + 17', '999983')} + 0.5) / 999983)), 9) DESC, h) AS k FROM prof0 JOIN g USING (top1))
 SELECT src, array_to_string([{WORD7}], ',') AS words FROM r WHERE k <= nact GROUP BY src""")
def study_resampled(spark, d):
    """ST20, SO8: every source's hours redrawn from its port's rhythm."""
    r = controls.resampled(profiled(spark, d), 168)
    return r.select("src", F.array_join(F.transform("words", lambda x: x.cast("string")), ",").alias("words"))


@query("study_resampled_decisions")
def study_resampled_decisions(spark, d):
    """ST20: one row: the whole test on redrawn hours, where nothing is orchestrated. Its draws are those of study_resampled; tests hold that none passes."""
    p, m = campaigned(spark, d)
    new = controls.resampled(p, 168)
    p = stage(p.drop("words").join(new, "src"), "redrawn")
    return rounded(controls.raw_rates(decided(p, m).filter("testable"), FLOOR))


@query("study_fallback_undetermined", f"""WITH {DECIDED}, fb AS (SELECT camp, count(*) AS n, count(*) FILTER (WHERE coalesce(tier, 5) > 0) AS f FROM members JOIN pb USING (src) JOIN (SELECT camp FROM decided WHERE testable AND NOT residue) USING (camp) LEFT JOIN pick USING (camp, cc, bin) GROUP BY camp),
 x AS (SELECT decided.camp, orchestrated AS was, coalesce(f * 2 > n, false) AS major, CASE WHEN f * 2 > n THEN 1.0 ELSE p END AS p FROM decided LEFT JOIN fb USING (camp) WHERE NOT residue), k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM x)
 SELECT count(*) FILTER (WHERE major) AS majority_fallback, count(*) FILTER (WHERE major AND was) AS majority_fallback_orchestrated, count(*) FILTER (WHERE was) AS orchestrated, count(*) FILTER (WHERE p <= (SELECT max(p) FROM k WHERE p <= {CFG.q} * k / n)) AS orchestrated_after FROM k""")
def study_fallback_undetermined(spark, d):
    """ST21."""
    p, m, dec = _tested(spark, d)
    return rounded(controls.fallback_undetermined(p, m, dec, CFG))


@query("study_normal_p", f"""WITH {DECIDED}, x AS (SELECT orchestrated, greatest(CASE WHEN z_rot = 0 THEN 1.0 WHEN z_rot > 0 THEN {tail_sql('z_rot')} ELSE 1 - {tail_sql('z_rot')} END, CASE WHEN NOT testable OR z_pop = 0 THEN 1.0 WHEN z_pop > 0 THEN {tail_sql('z_pop')} ELSE 1 - {tail_sql('z_pop')} END) AS p FROM decided WHERE NOT residue),
 k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM x), y AS (SELECT orchestrated AS a, coalesce(p <= (SELECT max(p) FROM k WHERE p <= {CFG.q} * k / n), false) AS b FROM k)
 SELECT count(*) AS campaigns, count(*) FILTER (WHERE a) AS empirical, count(*) FILTER (WHERE b) AS normal, round(avg((a = b)::INT), 6) AS agreement, round(count(*) FILTER (WHERE a AND b) / greatest(count(*) FILTER (WHERE a OR b), 1), 6) AS jaccard FROM y""")
def study_normal_p(spark, d):
    """ST22: normal p-values of the z-scores against counted draws."""
    return rounded(controls.normal_against_empirical(decided(*campaigned(spark, d)), CFG.q))




@query("study_residue_peers", f"""WITH {DECIDED}, alt AS (SELECT * FROM (WITH prof AS (SELECT * FROM prof0), {TESTS} SELECT * FROM tests)), j AS (SELECT a.testable AS ta, a.orchestrated AS oa, b.testable AS tb, b.orchestrated AS ob FROM (SELECT * FROM decided WHERE NOT residue) a JOIN alt b USING (camp))
 SELECT count(*) AS campaigns, count(*) FILTER (WHERE ta) AS testable_a, count(*) FILTER (WHERE tb) AS testable_b, count(*) FILTER (WHERE oa) AS orchestrated_a, count(*) FILTER (WHERE ob) AS orchestrated_b, count(*) FILTER (WHERE oa AND ob) AS both, count(*) FILTER (WHERE oa AND NOT ob) AS a_only, count(*) FILTER (WHERE NOT oa AND ob) AS b_only FROM j""")
def study_residue_peers(spark, d):
    """ST23: decisions with residue sources admitted as peers, against those without."""
    p, m = campaigned(spark, d)
    bad = stage(inference.convergence(p, m, CFG), "convergence").filter("residue")
    run = lambda admit: stage(synchrony.decide_staged(p, m.select("src", "camp"), bad, ONE_STAGE, residue_peers=admit).filter("not residue"), "decisions")
    return rounded(controls.compared(run(False), run(True)))


@query("study_stages")
def study_stages(spark, d):
    """ST23, ST10: one stage of 200 draws against three (200, 1000, 10,000): what lifting the floor of p adds. Tests hold that the third stage loses none."""
    p, m = campaigned(spark, d)
    few = replace(CFG, draws=200)
    return rounded(controls.compared(decided(p, m, replace(few, draws2=0, draws3=0)), decided(p, m, few)))


@query("study_control_refined")
def study_control_refined(spark, d):
    """ST23: the same-port control's small p-values sharpened by 1,000 fresh draws, and BH again."""
    p, m = campaigned(spark, d)
    dec = decided(p, m)
    tests, _ = controls.negative_control(p, m, dec, ONE_STAGE)
    again, _ = controls.negative_control(p, m, dec, replace(ONE_STAGE, draws=1000, seed=CFG.seed + 500_000))
    return rounded(controls.refined(tests, again, 0.05, CFG.q))


PANEL = scalar.draw_sql("src * 7919 + 3", str(scalar.M31))
TURNED = scalar.draw_sql("src * 7919 + 4", "7")
CASE = 6


@query("study_case_panels", f"""WITH {CAMPS}, own AS (SELECT src FROM members0 WHERE camp = {CASE}), mine AS (SELECT src, words, portsig, fpc FROM prof0 SEMI JOIN own USING (src) ORDER BY {PANEL}, src LIMIT 20), kind AS (SELECT (SELECT portsig FROM mine GROUP BY portsig ORDER BY count(*) DESC, portsig LIMIT 1) AS sig, (SELECT fpc FROM mine GROUP BY fpc ORDER BY count(*) DESC, fpc LIMIT 1) AS tool),
 far AS (SELECT * FROM prof0 ANTI JOIN own USING (src)), panels AS (SELECT 'observed' AS panel, src, words FROM mine UNION ALL SELECT 'shifted', src, {TURN('words', TURNED)} FROM mine UNION ALL SELECT 'peers', src, words FROM (SELECT * FROM far, kind WHERE portsig = sig ORDER BY {PANEL}, src LIMIT 20) UNION ALL SELECT 'cotooled', src, words FROM (SELECT * FROM far, kind WHERE fpc = tool ORDER BY {PANEL}, src LIMIT 20))
 SELECT a.panel, (SELECT count(*) FROM panels x WHERE x.panel = a.panel) AS n, round(avg({JAC('a.words', 'b.words')}), 6) AS coact FROM panels a JOIN panels b ON a.panel = b.panel AND a.src < b.src GROUP BY a.panel""")
def study_case_panels(spark, d):
    """ST28, SO4: a campaign's co-activity beside day shifts, peers and sources of the same tool."""
    p, m = campaigned(spark, d)
    return rounded(controls.panel_coactivity(stage(controls.case_panels(p, m, CASE, 20, 7), "panels")))


#: Hours of a two-day window turned by single hours: the unit of windows under 48 hours (ST6, SC19).
@query("rotate_hours", f"WITH {CAMPS}, t AS (SELECT src, {scalar.draw_sql('src * 7919 + 5', '168')} AS s FROM prof0) SELECT src, array_to_string([{WORD7}], ',') AS words FROM (SELECT src, (rd.h + s) % 168 AS h FROM t JOIN rd USING (src)) GROUP BY src")
def rotate_hours(spark, d):
    """SC19: bitmaps turned by any number of hours."""
    r = profiled(spark, d).select("src", bitmap.rotate_hours(F.col("words"), scalar.draw(F.col("src") * 7919 + 5, 168)).alias("w"))
    return r.select("src", F.array_join(F.transform("w", lambda x: x.cast("string")), ",").alias("words"))
