"""The replay document and its viewer, decisions in words, the embedding baseline, an external scan, formats: queries and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import decisions, embedding, experiments, external, inference, reduction, replay, sentences, synchrony
from ..operators.stage import folder, stage
from ..sinks import writers
from ..sources import flows, readers, simulate
from .queries import FLOWS, query, rounded
from .study import ACC, CAMPS, CFG, DECIDED, ONE_STAGE, PROF0, REDUCED, START, campaigned, decided, profiled, reduced, top_sql

H = 168


def joined(c, by: str = ","):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), by)


# ---------------------------------------------------------------- replay document
@query("replay_hourly", f"WITH {REDUCED} SELECT h, sum(nrec)::BIGINT AS records, count(*) AS sources FROM rd GROUP BY h")
def replay_hourly(spark, d):
    """MX2, AG26."""
    return rounded(replay.hourly_totals(reduced(spark, d)))


PICK = scalar.draw_sql("n * 7919 + (src % 1000003) * 104729 + 29", str(scalar.M31))
POINTS = f"""px AS (SELECT camp, h, n, t, dst - {CFG.d0} AS o, row_number() OVER (PARTITION BY camp ORDER BY {PICK}, src, n) AS k FROM s8 JOIN members0 USING (src) WHERE dst BETWEEN {CFG.d0} AND {CFG.d0 + CFG.d_size - 1}),
pts AS (SELECT camp, count(*) AS points, round(sum(round(h + (t % 3600) / 3600, 3)), 1) AS hours_sum, round(sum(round(o / {CFG.d_size}, 5)), 3) AS share_sum FROM px WHERE k <= 60 GROUP BY camp)"""


def _points(spark, d, m):
    x = reduced(spark, d).select("src", "h", F.explode("samples").alias("s")).select("src", "h", "s.n", "s.t", "s.dst")
    return replay.points(x, m, CFG.d0, CFG.d_size, H, 60)


@query("replay_points", f"WITH {CAMPS}, {POINTS} SELECT camp::BIGINT AS camp, points, hours_sum, share_sum FROM pts")
def replay_points(spark, d):
    """MX1: sampled destinations of each campaign, 60 at most."""
    x = _points(spark, d, campaigned(spark, d)[1])
    total = lambda i: F.aggregate("points", F.lit(0.0), lambda t, p: t + p[i])
    return rounded(x.select("camp", F.size("points").cast("bigint").alias("points"), F.round(total(0), 1).alias("hours_sum"), F.round(total(1), 3).alias("share_sum")))


TOOL = "CASE WHEN list_contains(f, 'sD') THEN 'Mirai-family' WHEN list_contains(f, 'i54321') THEN 'ZMap' WHEN list_contains(f, 'w1024') AND list_contains(f, 'o-') THEN 'Masscan' WHEN research >= 0.5 THEN 'Research scanner' ELSE 'Unknown' END"
CARDS = f"""{DECIDED}, mp AS (SELECT * FROM members0 JOIN prof0 USING (src)), {', '.join(top_sql('t_' + c, c, 1) for c in ('portsig', 'pm', 'fpc', 'strategy'))}, {top_sql('t_cc', "CASE WHEN cc = '' THEN '??' ELSE cc END", 12)},
 lg2 AS (SELECT camp, count(*) AS bots, median(pph) AS pph_med, sum(ud) AS ud_sum, min(hfirst) AS first_h, max(hlast) AS last_h, count(DISTINCT asn) AS asns, avg(research) AS research FROM mp GROUP BY camp),
 det AS (SELECT camp, max(hfirst) AS first_detected_h FROM (SELECT camp, hfirst, row_number() OVER (PARTITION BY camp ORDER BY hfirst, src) AS r FROM mp) WHERE r <= 10 GROUP BY camp),
 actv AS (SELECT camp, h, count(*) AS n FROM members0 JOIN rd USING (src) GROUP BY camp, h), acts AS (SELECT camp, string_agg(h || ':' || n, ' ' ORDER BY h) AS activity FROM actv GROUP BY camp),
 cards AS (SELECT g.*, first_detected_h, activity, residue, testable, orchestrated AS orch, z, (SELECT v FROM t_portsig t WHERE t.camp = g.camp) AS portsig, (SELECT v FROM t_pm t WHERE t.camp = g.camp) AS pm, string_split((SELECT v FROM t_fpc t WHERE t.camp = g.camp), '|') AS f, (SELECT v FROM t_strategy t WHERE t.camp = g.camp) AS strat,
 (SELECT string_agg(v || ':' || n, ' ' ORDER BY n DESC, v) FROM t_cc t WHERE t.camp = g.camp) AS countries FROM lg2 g JOIN det USING (camp) JOIN acts USING (camp) JOIN decided USING (camp)),
 said AS (SELECT camp, bots, replace(replace(regexp_replace(portsig, '^p+', ''), 'multi', 'many'), '+', '/') AS port, CASE pm WHEN 1 THEN 'TCP' WHEN 2 THEN 'UDP' WHEN 4 THEN 'ICMP' ELSE 'mixed' END AS proto, {TOOL} AS tool, CASE strat WHEN 'uperm' THEN 'uniform' WHEN 'seq_fwd' THEN 'seq_inc' WHEN 'seq_rev' THEN 'seq_dec' WHEN 'perm' THEN 'nonuniform' END AS strategy,
 CASE WHEN testable THEN orch END AS orchestrated, CASE WHEN testable THEN round(z, 2) END AS z, round(pph_med, 2) AS pph_med, round(least(1.0, ud_sum / {CFG.d_size}), 4) AS coverage, first_h, last_h, first_detected_h, asns, countries, activity FROM cards)"""


def _cards(spark, d):
    p, m = campaigned(spark, d)
    dec = decided(p, m)
    return replay.cards(p, m, stage(inference.landscape(p, m, dec), "landscape"), H, CFG.d_size), p, m, dec


def _activity_text(c):
    return F.array_join(F.array_compact(F.transform(c, lambda n, h: F.when(n > 0, F.concat(h.cast("string"), F.lit(":"), n.cast("string"))))), " ")


@query("replay_cards", f"WITH {CARDS} SELECT * REPLACE (camp::BIGINT AS camp) FROM said")
def replay_cards(spark, d):
    """Q14, MX3, MX4, MX5, AG9, AG19: what the replay document says of each campaign."""
    c = _cards(spark, d)[0].drop("fingerprint")
    cc = F.array_join(F.transform(F.array_sort(F.transform(F.map_entries("countries"), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("v")))), lambda e: F.concat(e["v"], F.lit(":"), (-e["k"]).cast("string"))), " ")
    return rounded(c.withColumn("countries", cc).withColumn("activity", _activity_text(F.col("activity"))))


CHOSEN = "ck AS (SELECT camp, row_number() OVER (ORDER BY bots DESC, camp) AS id FROM (SELECT camp, bots FROM (SELECT camp, bots, row_number() OVER (ORDER BY bots DESC, camp) AS r FROM said) WHERE r <= 8 UNION SELECT camp, bots FROM (SELECT camp, bots, row_number() OVER (ORDER BY bots DESC, camp) AS r FROM said WHERE orchestrated) WHERE r <= 4))"


def _document(spark, d):
    cards, p, m, dec = _cards(spark, d)
    cards = stage(cards, "cards")
    picked = replay.chosen(cards, 8, 4)
    meta = {"title": "Replay", "telescope": "simulated", "window_start": "2024-01-01T00:00:00Z", "hours": float(H), "anonymized": True, "synthetic": True, "n_campaigns": float(cards.count())}
    return stage(replay.document(cards, picked, _points(spark, d, m), replay.hourly_totals(reduced(spark, d)), meta), "document")


@query("replay_viewer", f"""WITH {CARDS}, {CHOSEN}, pk AS (SELECT camp, first(h ORDER BY n DESC, h) AS peak_h, max(n) AS peak FROM actv GROUP BY camp), {POINTS}
 SELECT id, bots, port, upper(proto) AS proto, tool, strategy, CASE WHEN orchestrated IS NULL THEN 'undetermined' WHEN orchestrated THEN 'orchestrated' ELSE 'independent' END AS state, first_h, last_h, first_detected_h AS det, peak_h, round(peak, 1)::DOUBLE AS peak, coalesce(points, 0) AS points FROM ck JOIN said USING (camp) JOIN pk USING (camp) LEFT JOIN pts USING (camp)""")
def replay_viewer(spark, d):
    """SRC15, SNK6, SET2, MX11 to MX13: the document written as JSON, read back, and made whole for a viewer."""
    path = folder(spark, "document")
    doc = _document(spark, d)
    doc.write.mode("overwrite").json(path)
    rows = replay.normalised(readers.read_document(spark, path, readers.DOCUMENT))
    return rounded(rows.select("id", "bots", "port", "proto", "tool", "strategy", "state", "first_h", "last_h", "det", "peak_h", "peak", "points"))


@query("replay_latest", f"WITH {CARDS}, x AS (SELECT * FROM said WHERE first_detected_h <= 60), b AS (SELECT camp, first_detected_h, bots FROM x ORDER BY first_detected_h DESC, bots DESC, camp LIMIT 1) SELECT camp::BIGINT AS id, first_detected_h AS det, bots, (SELECT count(*) FROM x WHERE x.first_detected_h = b.first_detected_h) AS same_hour FROM b")
def replay_latest(spark, d):
    """MX10."""
    c = _cards(spark, d)[0].select(F.col("camp").alias("id"), F.col("first_detected_h").alias("det"), "bots")
    return rounded(replay.latest(c, 60))


@query("replay_range", f"WITH {REDUCED}, g AS (SELECT h, sum(nrec) AS v FROM rd GROUP BY h), r AS (SELECT min(v) AS a, max(v) AS b FROM g) SELECT round(a - w * 0.12, 6)::DOUBLE AS lo, round(b + w * 0.06, 6)::DOUBLE AS hi FROM (SELECT a, b, CASE WHEN b > a THEN b - a WHEN b <> 0 THEN abs(b) ELSE 1 END AS w FROM r)")
def replay_range(spark, d):
    """AG28."""
    return rounded(replay.padded_range(replay.hourly_totals(reduced(spark, d)), "records"))


@query("sorted_campaigns", f"WITH {CARDS} SELECT camp::BIGINT AS camp, row_number() OVER (ORDER BY z DESC NULLS LAST, bots DESC, camp) AS by_z, row_number() OVER (ORDER BY first_detected_h, bots DESC, camp) AS by_time FROM said")
def sorted_campaigns(spark, d):
    """SO2, SO3: undetermined campaigns last, then size and number."""
    from pyspark.sql import Window as W

    c = _cards(spark, d)[0]
    return rounded(c.select("camp", F.row_number().over(W.orderBy(F.col("z").desc_nulls_last(), F.desc("bots"), "camp")).alias("by_z"), F.row_number().over(W.orderBy("first_detected_h", F.desc("bots"), "camp")).alias("by_time")))


@query("protocol_table", f"WITH {CARDS} SELECT camp::BIGINT AS camp, proto, bots FROM (SELECT * FROM said WHERE proto = 'TCP' ORDER BY bots DESC, camp LIMIT 4) UNION ALL SELECT camp::BIGINT, proto, bots FROM (SELECT * FROM said WHERE proto = 'UDP' ORDER BY bots DESC, camp LIMIT greatest(0, 7 - (SELECT least(4, count(*)) FROM said WHERE proto = 'TCP')))")
def protocol_table(spark, d):
    """MX15: four TCP campaigns, then UDP ones up to seven."""
    c = stage(_cards(spark, d)[0].select("camp", "proto", "bots"), "cards")
    tcp = c.filter("proto = 'TCP'").orderBy(F.desc("bots"), "camp").limit(4)
    return rounded(tcp.unionByName(c.filter("proto = 'UDP'").orderBy(F.desc("bots"), "camp").limit(7 - tcp.count())))


@query("research_recall", f"WITH {CARDS} SELECT count(*) FILTER (WHERE research >= 0.5) AS research, count(*) FILTER (WHERE research >= 0.5 AND orch) AS research_orchestrated, count(*) FILTER (WHERE orch AND last_h - first_h >= 84) AS steady, round(count(*) FILTER (WHERE testable AND NOT orch) / nullif(count(*) FILTER (WHERE testable), 0), 6) AS missed FROM cards")
def research_recall(spark, d):
    """MX16."""
    p, m = campaigned(spark, d)
    x = inference.landscape(p, m, decided(p, m))
    r = F.col("research") >= 0.5
    return rounded(x.agg(F.count_if(r).alias("research"), F.count_if(r & F.col("orchestrated")).alias("research_orchestrated"), F.count_if(F.col("orchestrated") & (F.col("hlast_max") - F.col("hfirst_min") >= 84)).alias("steady"), F.try_divide(F.count_if(F.col("testable") & ~F.col("orchestrated")), F.count_if("testable")).alias("missed")))


@query("stream_growth", f"WITH {REDUCED}, g AS (SELECT h, count(*) AS sources, row_number() OVER (ORDER BY h) AS a, row_number() OVER (ORDER BY h DESC) AS b FROM rd GROUP BY h) SELECT round(median(sources) FILTER (WHERE a <= 3), 6) AS first, round(median(sources) FILTER (WHERE b <= 3), 6) AS last, round(median(sources) FILTER (WHERE b <= 3) + (median(sources) FILTER (WHERE b <= 3) - median(sources) FILTER (WHERE a <= 3)) / 168 * 552, 6) AS month FROM g")
def stream_growth(spark, d):
    """MX17: the last three updates against the first three, carried on to a month."""
    from pyspark.sql import Window as W

    g = replay.hourly_totals(reduced(spark, d)).withColumn("a", F.row_number().over(W.orderBy("h"))).withColumn("b", F.row_number().over(W.orderBy(F.desc("h"))))
    first, last = F.median(F.when(F.col("a") <= 3, F.col("sources"))), F.median(F.when(F.col("b") <= 3, F.col("sources")))
    return rounded(g.agg(first.alias("first"), last.alias("last"), (last + (last - first) / 168 * 552).alias("month")))


# ---------------------------------------------------------------- decisions in words
OPT_WORDS = "list_transform(string_split({o}, '.'), lambda t: CASE WHEN t LIKE 'M%' THEN 'MSS=' || substring(t, 2) WHEN t LIKE 'W%' THEN 'window-scale=' || substring(t, 2) WHEN t = 'N' THEN 'NOP' WHEN t = 'S' THEN 'SACK-permitted' WHEN t = 'T' THEN 'timestamps' WHEN t = 'E' THEN 'end-of-list' ELSE t END)"
PORT_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in decisions.PORTS.items()) + "}"


@query("fingerprint_words", f"""WITH {PROF0}, x AS (SELECT portsig, fpc, opts, max(research) AS research, count(*) AS sources, string_split(fpc, '|') AS f FROM prof0 GROUP BY portsig, fpc, opts)
 SELECT portsig, fpc, opts, sources, CASE WHEN opts IN ('', '-', 'nan') THEN 'none' ELSE array_to_string({OPT_WORDS.format(o='opts')}, ', ') END AS options, CASE WHEN portsig = 'multi' THEN 'many ports (port sweep)' ELSE array_to_string(list_transform(string_split(regexp_replace(portsig, '^p+', ''), '+'), lambda p: p || coalesce(' (' || {PORT_MAP}[p] || ')', '')), ', ') END AS ports, {TOOL} AS tool,
 CASE WHEN f[1] = 'udp' THEN CASE WHEN substring(fpc, length(fpc) - 5, 6) = 'ph4f50' THEN 'UDP, payload ''OP''' WHEN substring(fpc, length(fpc) - 5, 6) = 'ph6431' THEN 'UDP, payload ''d1''' ELSE 'UDP' END ELSE array_to_string(list_filter([CASE WHEN list_contains(f, 'sD') THEN 'seq=dst' END, CASE WHEN list_contains(f, 'i54321') THEN 'IPID 54321' END,
 CASE WHEN list_filter(f, lambda w: w LIKE 'w%')[1] NOT IN ('wx', 'w') THEN 'win ' || substring(list_filter(f, lambda w: w LIKE 'w%')[1], 2) END, CASE WHEN list_contains(f, 'o-') THEN 'no opts' END, 'TTL ' || substring(f[2], 2)], lambda y: y IS NOT NULL)[1:3], ', ') END AS short FROM x""")
def fingerprint_words(spark, d):
    """SC22, SC23, SC27, PRJ2: option signatures, ports and core fingerprints in words, the tool they speak for."""
    x = profiled(spark, d).groupBy("portsig", "fpc", "opts").agg(F.max("research").alias("research"), F.count("*").alias("sources"))
    return rounded(x.select("portsig", "fpc", "opts", "sources", decisions.options_text(F.col("opts")).alias("options"), decisions.ports_text(F.col("portsig")).alias("ports"), decisions.tool_label(F.col("fpc"), F.col("research")).alias("tool"), decisions.short_fingerprint(F.col("fpc")).alias("short")))


def _answers(spark, d):
    p, m = campaigned(spark, d)
    sig = decisions.described(stage(inference.signature(p, m, CFG.d_size), "signatures"))
    states = stage(sig.select(F.col("camp").alias("id"), "state"), "states")
    return states, stage(readers.asked(states, decisions.rule_service), "answers"), p, m


@query("campaign_descriptions")
def campaign_descriptions(spark, d):
    """SC24: campaigns in words. tests/test_views.py holds a text against the one expected."""
    return _answers(spark, d)[0]


@query("decision_answers")
def decision_answers(spark, d):
    """SRC14, SC25, SC26, SC28, MX7 to MX9, AG29, Q19: the offline rules' answers, summarised beside the test's verdict."""
    states, got, p, m = _answers(spark, d)
    dec = decided(p, m).select(F.col("camp").alias("id"), F.when(F.col("testable"), F.col("orchestrated")).alias("verdict"))
    tool, sev, yes = (decisions.probabilities(F.col("answer"), q) for q in ("tool", "severity", "coordinated"))
    x = got.join(dec, "id").withColumn("tool", tool).withColumn("sev", decisions.severity(sev)).withColumn("yes", F.try_element_at(yes, F.lit("yes")))
    most = decisions.majority(m.select("src", "camp").join(p.select("src", "strategy"), "src")).select(F.col("camp").alias("id"), F.col("strategy").alias("strategy_majority"))
    return rounded(x.join(most, "id").select("id", decisions.best(F.col("tool"))["k"].alias("tool"), decisions.best(F.col("tool"))["p"].alias("tool_p"), F.size(decisions.with_rest(F.col("tool"), 2)).alias("options"), "sev.expectation", "sev.level", "sev.likeliest", F.col("yes").alias("coordinated"), replay.agrees(F.col("yes"), F.col("verdict")).alias("agrees"), "strategy_majority"))


# ---------------------------------------------------------------- embedding baseline
KNN = """nv AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), nx AS (SELECT a.id AS u, b.id AS v, round(list_cosine_similarity(a.v, b.v), 12) AS w FROM nv a JOIN nv b ON a.id <> b.id), nk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS r FROM nx WHERE w > 0) WHERE r <= 3)"""


def _vectors(spark, d):
    return flows.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("embedding_neighbours", f"WITH {KNN} SELECT u, v, round(w, 6) AS w FROM nk")
def embedding_neighbours(spark, d):
    """JN13."""
    return rounded(embedding.neighbours(_vectors(spark, d), 3))


@query("embedding_graph", f"WITH {KNN} SELECT least(u, v) AS u, greatest(u, v) AS v, round(max(w), 6) AS w FROM nk GROUP BY least(u, v), greatest(u, v)")
def embedding_graph(spark, d):
    """EM3."""
    return rounded(embedding.graph(_vectors(spark, d), 3))


@query("embedding_communities")
def embedding_communities(spark, d):
    """EM4: Louvain's communities of the neighbour graph. Tests hold planted groups and that modularity beats that of components."""
    g = stage(embedding.graph(_vectors(spark, d), 3), "graph")
    return rounded(embedding.labels(embedding.communities(g), 5))


@query("service_vectors")
def service_vectors(spark, d):
    """EM2, SRC11, SNK9: skip-gram vectors of the sources in sentences of services; here the number of words and dimensions."""
    r = stage(reduced(spark, d), "hours")
    path = folder(spark, "embedding-rows")
    writers.embedding_lines(r).write.mode("overwrite").text(path)
    back = readers.read_embedding_rows(spark, path)
    s = sentences.sentences(back.select("h", F.col("src").cast("bigint").alias("src"), "t0", "t1", "pk"), back.select("h", F.col("src").cast("bigint").alias("src"), F.explode("ports").alias("port", "n")))
    v = embedding.word_vectors(s.select(F.transform("words", lambda w: w.cast("string")).alias("words")), dim=16, window=5, epochs=1)
    return rounded(v.agg(F.count("*").alias("words"), F.max(F.size("vector")).alias("dim")))


@query("cluster_purity", f"WITH {CAMPS}, x AS (SELECT camp, sum(n) AS n, max(n) AS most FROM (SELECT camp, fpc, count(*) AS n FROM members0 JOIN prof0 USING (src) GROUP BY camp, fpc) GROUP BY camp), pf AS (SELECT src, portsig || '|' || hfirst AS key, fpc FROM prof0), y AS (SELECT key, sum(n) AS n, max(n) AS most FROM (SELECT key, fpc, count(*) AS n FROM pf GROUP BY key, fpc) GROUP BY key HAVING sum(n) >= 3) SELECT 'campaigns' AS clustering, count(*) AS clusters, round(median(most / n), 6) AS purity_median, sum(n)::BIGINT AS covered FROM x UNION ALL SELECT 'port_onset', count(*), round(median(most / n), 6), sum(n)::BIGINT FROM y")
def cluster_purity(spark, d):
    """Q17, AG24: purity and coverage of two clusterings."""
    p, m = campaigned(spark, d)
    one = lambda name, x: embedding.purity(x.join(p.select("src", "fpc"), "src"), "fpc").select(F.lit(name).alias("clustering"), "*")
    return rounded(one("campaigns", m.select("src", "camp")).unionByName(one("port_onset", inference.port_onset(p, 3).select("src", "camp"))))


# ---------------------------------------------------------------- an external scan
#: A second scenario stands for the external scan: one large synchronous group on one port, over slices of 2**17 addresses.
SCAN = simulate.Scenario(campaigns=1, bots=60, rate=8.0, seed=5)
SBITS = 17
EXT = f"{simulate.packets_sql(SCAN, START)}, ext AS (SELECT t, src, cc, dst & 16777215 AS dst24, (dst & 16777215) >> {SBITS} AS slice FROM sim_packets)"


def _scan(spark):
    return simulate.packets(spark, SCAN, START).select("t", "src", "cc", F.col("dst").bitwiseAND(F.lit(0xFFFFFF)).alias("dst24")).withColumn("slice", F.shiftright("dst24", SBITS))


BITS = ", ".join(f"coalesce(bit_or(CASE WHEN h // 24 = {k} THEN 1::BIGINT << (h % 24)::INTEGER END), 0)" for k in range(7))


@query("scan_bots", f"""WITH {EXT}, x AS (SELECT *, (t - {START}) // 3600 AS h, dst24 & {(1 << SBITS) - 1} AS off FROM ext WHERE t >= {START} AND t < {START} + 168 * 3600), g AS (SELECT slice, src, count(*) AS pk, count(DISTINCT h) AS nact, array_to_string([{BITS}], ',') AS words, first(cc ORDER BY t, dst24) AS cc FROM x GROUP BY ALL HAVING count(*) >= 2),
 dm AS (SELECT slice, src, off AS dmode, row_number() OVER (PARTITION BY slice, src ORDER BY count(*) DESC, min(t), off) AS r FROM x GROUP BY slice, src, off), tp2 AS (SELECT slice, src, t AS t_prof, row_number() OVER (PARTITION BY slice, src ORDER BY t, dst24) AS r FROM x)
 SELECT slice::BIGINT AS slice, src, pk, nact, words, cc, dmode, t_prof FROM g JOIN (SELECT * FROM dm WHERE r = 1) USING (slice, src) JOIN (SELECT * FROM tp2 WHERE r = 2) USING (slice, src)""")
def scan_bots(spark, d):
    """FIL14, AG6, AG30, AG31, SRC8: sources of an external scan as profiles, slice by slice."""
    b = external.bots(_scan(spark), START, H, SBITS)
    return rounded(b.withColumn("words", joined("words")))


@query("as_of_profiles", f"""WITH {PROF0}, v AS (SELECT rd.src, h FROM rd SEMI JOIN prof0 USING (src) WHERE h < 107) SELECT src, count(*) AS nact, array_to_string([{', '.join(f'coalesce(bit_or(CASE WHEN h >= 11 AND (h - 11) // 24 = {k} THEN 1::BIGINT << ((h - 11) % 24)::INTEGER END), 0)' for k in range(4))}], ',') AS words FROM v GROUP BY src""")
def as_of_profiles(spark, d):
    """FIL15, JN18, PRJ4, SM7: profiles as they stand after 107 hours, bitmaps cut to the last four whole days."""
    return rounded(external.as_of(profiled(spark, d).select("src", "words", "nact"), 107).select("src", "nact", joined("words").alias("words")))


@query("scan_threshold", f"WITH {DECIDED}, f AS (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM decided WHERE NOT residue) SELECT round(coalesce(max(i + 1) FILTER (WHERE p <= (i + 1) * {CFG.q} / (n + 1)), 1) * {CFG.q} / (any_value(n) + 1), 9) AS tau FROM f")
def scan_threshold(spark, d):
    """WN9: the largest p that the family of decisions would still pass. tests/test_views.py holds it against bisection."""
    return external.bh_threshold(decided(*campaigned(spark, d)).filter("not residue"), "p", CFG.q).select(F.round("tau", 9).alias("tau"))


def _replayed(spark, d):
    """Updates of an external scan among the window's port peers: the group, and a small part of it, as of some hours."""
    p = profiled(spark, d)
    b = stage(external.bots(_scan(spark), START, H, SBITS), "bots")
    s = b.agg(F.min("slice")).first()[0]
    own = b.filter(F.col("slice") == s).select("src", "words", "nact", F.lit(23).alias("top1"), "cc", F.col("dmode").cast("bigint").alias("dmode"))
    out = None
    for h in (47, 95, 143):
        every = external.as_of(p.select("src", "words", "nact", "top1", "cc", "dmode"), h + 1).withColumn("own", F.lit(False)).unionByName(external.as_of(own, h + 1).withColumn("own", F.lit(True)))
        every = stage(every, "as-of")
        full = every.filter("own").select("src", F.lit(1).cast("bigint").alias("camp"))
        small = every.filter("own").orderBy(embedding.seed_order("src"), "src").limit(12).select("src", F.lit(2).cast("bigint").alias("camp"))
        for name, m in (("full", full), ("small", small)):
            m = stage(m, "group")
            got = synchrony.decide_staged(every.filter("own = false").unionByName(every.join(m, "src", "left_semi").filter("own")), m, m.select("camp").filter(F.lit(False)), replace(ONE_STAGE, draws=99), days=(h + 1) // 24)
            row = got.select(F.lit(h).cast("bigint").alias("h"), F.lit(name).alias("tag"), F.lit(m.count()).cast("bigint").alias("n"), "testable", "p", "p_rot", "p_pop")
            out = row if out is None else out.unionByName(row)
    return out


@query("scan_replay")
def scan_replay(spark, d):
    """SM11, Q13, JN16, MX22: hourly updates of an external scan: the whole group and a part of it, tested as of each update."""
    return rounded(_replayed(spark, d))


TIMELINE = f"{FLOWS.replace(' WHERE floor(epoch(e.ts) / 3600) - 473352 BETWEEN 0 AND 167', '')}, y AS (SELECT h, count(DISTINCT src)::DOUBLE AS y FROM flows GROUP BY h)"


@query("scan_phases", f"WITH {TIMELINE}, b AS (SELECT *, lag(y, 24) OVER (ORDER BY h) AS before FROM y), i AS (SELECT median(y) AS idle FROM y WHERE h >= 192 AND h < 264) SELECT min(h) AS onset, min(h) FILTER (WHERE h >= 144 AND h < 168 AND y < 0.9 * before) AS decline, min(h) FILTER (WHERE h >= 168 AND y > 1.5 * idle) AS restart, max(h) FILTER (WHERE h >= 168 AND y > 1.5 * idle) + 1 AS stop, max(idle) AS idle, max(y) AS peak FROM b, i")
def scan_phases(spark, d):
    """WN12, WN11, Q12: phases of the hourly number of sources, over the whole events table."""
    with flows.week(None):
        y = flows.event_flows(spark, d).groupBy("h").agg(F.count_distinct("src").cast("double").alias("y"))
    return rounded(external.phases(y, rise=1.5))


@query("scan_residue_event", f"WITH {CAMPS} SELECT (SELECT count(*) FROM prof0) AS sources, (SELECT count(*) FROM members0 WHERE camp IN (SELECT camp FROM conv WHERE residue)) AS residue, (SELECT max(n) FROM (SELECT count(*) AS n FROM prof0 WHERE dmode >= 0 GROUP BY dmode)) AS top_dest_sources, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM prof0 WHERE nact = 1 GROUP BY hfirst)), 0) AS single_hour_max")
def scan_residue_event(spark, d):
    """Q11."""
    p, m = campaigned(spark, d)
    return rounded(external.residue_event(p, m, inference.convergence(p, m, CFG)))


@query("flag_rates", f"""WITH t AS (SELECT c_nationkey AS g, c_custkey % 11 = 0 AS residue, c_custkey % 3 <> 0 AS testable, ((c_custkey * 7919 + 13) % 1009) / 1009.0::DOUBLE AS p, ((c_custkey * 104729 + 7) % 1013) / 1013.0::DOUBLE AS p_rot FROM customer)
 SELECT g::BIGINT AS g, count(*) AS groups, count(*) FILTER (WHERE residue) AS residue, count(*) FILTER (WHERE NOT residue) AS tested, {', '.join(f'round({x}, 6) AS {n}' for x, n in (('avg(testable::INT) FILTER (WHERE NOT residue)', 'testable'), ('avg((p <= 0.02)::INT) FILTER (WHERE NOT residue)', 'flag'), ('avg((p_rot <= 0.03)::INT) FILTER (WHERE NOT residue)', 'flag_rot'), ('avg((p < 0.05)::INT) FILTER (WHERE NOT residue)', 'raw05'), ('avg((p < 0.01)::INT) FILTER (WHERE NOT residue)', 'raw01'), ('avg((p_rot < 0.05)::INT) FILTER (WHERE NOT residue)', 'raw05_rot'), ('avg((p_rot < 0.01)::INT) FILTER (WHERE NOT residue)', 'raw01_rot'), ('median(p) FILTER (WHERE NOT residue)', 'p_med'), ('median(p_rot) FILTER (WHERE NOT residue)', 'p_rot_med')))} FROM t GROUP BY g""")
def flag_rates(spark, d):
    """AG23, Q13: the table of flag rates, on tests derived from the customers."""
    i = F.col("c_custkey")
    t = flows.load(spark, d, "customer").select(F.col("c_nationkey").alias("g"), (i % 11 == 0).alias("residue"), (i % 3 != 0).alias("testable"), (F.pmod(i * 7919 + 13, F.lit(1009)) / F.lit(1009.0)).alias("p"), (F.pmod(i * 104729 + 7, F.lit(1013)) / F.lit(1013.0)).alias("p_rot"))
    return rounded(external.flag_rates(t, 0.02, 0.03, ["g"]))


# ---------------------------------------------------------------- formats
FIELDS = "pm nrec nports pk bytes ud ud24 t0 t1 zm ms mi stride_pos stride_neg stride_big asn cc org rdns hfirst hlast".split()


@query("text_round_trip", f"WITH {ACC} SELECT unnest({FIELDS + ['words', 'top3', 'n_samples']!r}) AS field, (SELECT count(*) FROM ac) AS rows, (SELECT count(*) FROM ac) AS same")
def text_round_trip(spark, d):
    """Q20, SRC2 to SRC4, SNK1, D3, SC3, FIL2: source-hours written as tab-separated text, listed, read back and accumulated, field by field against the direct way."""
    hours = stage(reduced(spark, d), "hours")
    path = folder(spark, "hours-text")
    lines = writers.source_hour_lines(hours.withColumn("batch", readers.hour_batch(F.col("h"), START)))
    lines.select("value").coalesce(2).write.mode("overwrite").text(path)
    back = readers.read_hours(spark, path, START)
    keep = lambda a: a.select(F.col("src").cast("bigint").alias("src"), *FIELDS, joined("words").alias("words"), joined("top3").alias("top3"), F.size("samples").alias("n_samples"))
    same = lambda a: stage(keep(reduction.accumulate(a)), "accumulated")
    return rounded(external.equivalence(same(hours), same(back), "src", [*FIELDS, "words", "top3", "n_samples"]))


@query("profile_metrics", f"WITH {PROF0} SELECT unnest(['sources', 'records', 'campaign_ports', 'duty']) AS name, unnest([(SELECT count(*) FROM prof0)::VARCHAR, (SELECT sum(nrec) FROM prof0)::BIGINT::VARCHAR, (SELECT count(DISTINCT portsig) FROM prof0)::VARCHAR, (SELECT printf('%.2f', avg(duty)) FROM prof0)]) AS value")
def profile_metrics(spark, d):
    """SNK7, SC31: metrics as names and texts."""
    return writers.metrics(profiled(spark, d).agg(F.count("*").alias("sources"), F.sum("nrec").alias("records"), F.count_distinct("portsig").alias("campaign_ports"), F.avg("duty").alias("duty")))


# ---------------------------------------------------------------- experiment grids, samples
@query("grid_means", "SELECT c_mktsegment AS setting, count(*) AS runs, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd FROM customer GROUP BY c_mktsegment")
def grid_means(spark, d):
    """AG22."""
    g = experiments.grid(flows.load(spark, d, "customer").withColumnRenamed("c_mktsegment", "setting"), ["setting"], ["c_acctbal"])
    return rounded(g.select("setting", "runs", F.round("c_acctbal_mean", 4).alias("mean"), F.round("c_acctbal_sd", 4).alias("sd")))


@query("activity_samples", f"WITH {CAMPS}, a AS (SELECT camp, h, count(*)::DOUBLE AS n FROM members0 JOIN rd USING (src) GROUP BY camp, h), c AS (SELECT camp, h, sum(n) OVER (PARTITION BY camp ORDER BY h) AS cum, sum(n) OVER (PARTITION BY camp) AS total FROM a), u AS (SELECT DISTINCT camp, i, ({scalar.draw_sql('camp * 7919 + i * 104729 + 5', '999983')} + 0.5) / 999983 * total AS u FROM c CROSS JOIN (SELECT unnest(range(0, 8)) AS i)) SELECT camp::BIGINT AS camp, i, min(h) AS h FROM u JOIN c USING (camp) WHERE cum >= u GROUP BY camp, i")
def activity_samples(spark, d):
    """WN14: hours drawn in proportion to each campaign's activity."""
    c = _cards(spark, d)[0].select("camp", F.transform("activity", lambda x: x.cast("double")).alias("a"))
    return rounded(c.select("camp", F.posexplode(replay.sampled_hours(F.col("a"), 8, F.col("camp"))).alias("i", "h")))


@query("port_services", f"WITH {PROF0} SELECT CASE WHEN top1 IN (23, 2323) THEN 'telnet' WHEN top1 = 22 THEN 'ssh' WHEN top1 IN (80, 81, 443, 8080, 8443, 8888) THEN 'web' WHEN top1 IN (139, 445) THEN 'smb' WHEN top1 = 5060 THEN 'sip' ELSE 'other' END AS service, count(*) AS sources FROM prof0 GROUP BY 1")
def port_services(spark, d):
    """SC32."""
    return rounded(profiled(spark, d).groupBy(replay.service(F.col("top1")).alias("service")).agg(F.count("*").alias("sources")))


@query("sample_document")
def sample_document(spark, d):
    """SRC17: a made-up document, as a viewer's rows."""
    path = folder(spark, "sample")
    replay.sample_document(spark).write.mode("overwrite").json(path)
    return rounded(replay.normalised(readers.read_document(spark, path, readers.DOCUMENT)).select("id", "bots", "port", "state", "first_h", "last_h", "peak_h", "peak", "points"))
