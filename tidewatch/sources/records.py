"""Flow records: one row a source, hour and port, with up to a few sampled packets; from the simulator, from the events table, from JSON lines.

Columns: src, h, seq (order within a source), t0, t1, port, pmask, pk, bytes, ud,
ud24, zm, ms, mi, asn, cc, org, rdns, samples: array of struct(n, t, dport, proto,
dst, sport, ttl, ipid, df, win, optsig, seqrel, plen, phead), n being the sample's
own order (64 seq + place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from . import flows, packets, simulate

SAMPLE = "n bigint, t bigint, dport int, proto int, dst bigint, sport string, ttl int, ipid int, df int, win string, optsig string, seqrel string, plen string, phead string"
SAMPLE_FIELDS = [x.split()[0] for x in SAMPLE.split(", ")]
COLUMNS = ["src", "h", "seq", "t0", "t1", "port", "pmask", "pk", "bytes", "ud", "ud24", "zm", "ms", "mi", "asn", "cc", "org", "rdns", "samples"]
#: Packets of a record that are sampled.
SAMPLED = 3


def _sample(**value: Column) -> Column:
    kinds = dict(x.split() for x in SAMPLE.split(", "))
    return F.struct(*[value[k].cast(kinds[k]).alias(k) for k in SAMPLE_FIELDS])


def simulated(spark: SparkSession, s: simulate.Scenario, start: int = 0) -> DataFrame:
    """The records of a scenario: its packets by source, hour and port, the first three of each sampled."""
    p = simulate.packets(spark, s, start)
    one = _sample(n=F.col("i"), **{k: F.col(k) for k in SAMPLE_FIELDS[1:]})
    # A record's packets are those of one source in one hour: the scenario bounds them.
    g = p.groupBy("src", "h", "dport").agg(
        F.min("i").alias("seq"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.max(F.when(F.col("proto") == 6, 1).when(F.col("proto") == 17, 2).otherwise(4)).alias("pmask"), F.count("*").alias("pk"),
        F.count_distinct("dst").alias("ud"), F.count_distinct(F.shiftright("dst", 8)).alias("ud24"), F.max("flag").alias("flag"), F.max("asn").alias("asn"), F.max("cc").alias("cc"), F.slice(F.array_sort(F.collect_list(one)), 1, SAMPLED).alias("samples"),
    )
    numbered = F.transform("samples", lambda x, i: x.withField("n", F.col("seq") * 64 + i))
    return g.select(
        "src", "h", "seq", "t0", "t1", F.col("dport").alias("port"), "pmask", "pk", (F.col("pk") * 60).alias("bytes"), "ud", "ud24", *[(F.col("flag") == k).alias(a) for a, k in (("zm", "zmap"), ("ms", "masscan"), ("mi", "mirai"))],
        F.col("asn").cast("string").alias("asn"), "cc", F.concat(F.lit("SIM-AS"), F.col("asn").cast("string")).alias("org"), F.lit("").alias("rdns"), numbered.alias("samples"),
    )


def simulated_sql(s: simulate.Scenario, start: int = 0) -> str:
    """WITH members up to sim_rec and sim_smp, the records without samples and the samples."""
    fields = ", ".join(k for k in SAMPLE_FIELDS[1:])
    return f"""{simulate.packets_sql(s, start)},
sim_rec AS (SELECT src, h, min(i) AS seq, min(t) AS t0, max(t) AS t1, dport AS port, max(CASE proto WHEN 6 THEN 1 WHEN 17 THEN 2 ELSE 4 END) AS pmask, count(*) AS pk, count(*) * 60 AS bytes, count(DISTINCT dst) AS ud, count(DISTINCT dst >> 8) AS ud24,
 max(flag) = 'zmap' AS zm, max(flag) = 'masscan' AS ms, max(flag) = 'mirai' AS mi, CAST(max(asn) AS VARCHAR) AS asn, max(cc) AS cc, 'SIM-AS' || max(asn) AS org, '' AS rdns FROM sim_packets GROUP BY src, h, dport),
sim_smp AS (SELECT src, h, (min(i) OVER (PARTITION BY src, h, dport)) * 64 + row_number() OVER (PARTITION BY src, h, dport ORDER BY i) - 1 AS n, {fields} FROM sim_packets QUALIFY row_number() OVER (PARTITION BY src, h, dport ORDER BY i) <= {SAMPLED})"""


#: What a source of the events table runs, by src mod 4: (first TTL, window, options, sequence number, DF, payload head). Fixed values.
MACHINES = ((64, "1024", "", "", 0, "4f5054494f4e5320"), (128, "65535", "M1460", "", 0, "000100002112a442"), (255, "", "", "D", 0, "64313a6164323a69"), (64, "29200", "M1460.S.T.N.W7", "", 1, "0102030405060708"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as records, two packets of each sampled; what it has no column for is derived from src and event id."""
    f = flows.event_flows(spark, sf_dir)
    m = F.col("src") % 4
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in MACHINES]), (m + 1).cast("int"))
    seq, tcp = F.col("id"), F.col("pmask") == 1
    near = F.pmod(F.col("dst") + scalar.draw(seq * 7919 + 11, 3000) - 1500, F.lit(1 << 19))

    def one(j: int) -> Column:
        k = seq * 2 + j
        return _sample(
            n=seq * 64 + j, t=F.col("t") + j, dport=F.col("port"), proto=F.when(tcp, 6).when(F.col("pmask") == 2, 17).otherwise(1), dst=(near if j else F.col("dst")) + 591396864,
            sport=F.when(F.col("pmask") == 4, F.lit("")).otherwise(F.when(m == 0, F.lit(40000).cast("bigint")).when(m == 1, 40000 + k % 8).when(m == 2, 1024 + (k * 3) % 60000).otherwise(scalar.draw(k * 7919 + 3, 60000)).cast("string")),
            ttl=pick(0) - 5 - F.col("src") % 13, ipid=F.when(m == 0, F.lit(54321).cast("bigint")).when(m == 1, 0).when(m == 2, (k * 7) % 65536).otherwise(scalar.draw(k * 7919 + 5, 65536)), df=pick(4),
            win=F.when(tcp, F.when(m == 2, (scalar.draw(k * 7919 + 9, 65535) + 1).cast("string")).otherwise(pick(1))).otherwise(""), optsig=F.when(tcp, pick(2)).otherwise(""), seqrel=F.when(tcp, pick(3)).otherwise(""),
            plen=F.when(F.col("pmask") == 2, "8").otherwise(""), phead=F.when(F.col("pmask") == 2, pick(5)).otherwise(""),
        )

    return f.select(
        "src", "h", seq.alias("seq"), F.col("t").alias("t0"), (F.col("t") + 1).alias("t1"), "port", "pmask", "pk", "bytes", (1 + seq % 3).alias("ud"), (1 + seq % 2).alias("ud24"), (m == 1).alias("zm"), ((m == 0) & tcp).alias("ms"), (m == 2).alias("mi"),
        F.col("asn").cast("string").alias("asn"), F.col("cc"), scalar.clean(F.col("org"), 48).alias("org"), F.when(F.col("src") % 10 == 0, "scan-7.example.org").otherwise("").alias("rdns"), F.array(one(0), one(1)).alias("samples"),
    )


def events_sql() -> str:
    """ev_rec and ev_smp, from a WITH member flows."""
    pick = lambda i: f"[{', '.join(repr(x[i]) for x in MACHINES)}][src % 4 + 1]"
    k = "(id * 2 + j)"
    near = f"(dst + {scalar.draw_sql('id * 7919 + 11', '3000')} - 1500 + 524288) % 524288"
    return f"""ev_rec AS (SELECT src, h, id AS seq, t AS t0, t + 1 AS t1, port, pmask, pk, bytes, 1 + id % 3 AS ud, 1 + id % 2 AS ud24, src % 4 = 1 AS zm, src % 4 = 0 AND pmask = 1 AS ms, src % 4 = 2 AS mi,
 CAST(asn AS VARCHAR) AS asn, cc, org, CASE WHEN src % 10 = 0 THEN 'scan-7.example.org' ELSE '' END AS rdns FROM flows),
ev_smp AS (SELECT src, h, id * 64 + j AS n, t + j AS t, port AS dport, CASE pmask WHEN 1 THEN 6 WHEN 2 THEN 17 ELSE 1 END AS proto, CASE WHEN j = 1 THEN {near} ELSE dst END + 591396864 AS dst,
 CASE WHEN pmask = 4 THEN '' ELSE CAST(CASE src % 4 WHEN 0 THEN 40000 WHEN 1 THEN 40000 + {k} % 8 WHEN 2 THEN 1024 + ({k} * 3) % 60000 ELSE {scalar.draw_sql(f'{k} * 7919 + 3', '60000')} END AS VARCHAR) END AS sport, {pick(0)} - 5 - src % 13 AS ttl,
 CASE src % 4 WHEN 0 THEN 54321 WHEN 1 THEN 0 WHEN 2 THEN ({k} * 7) % 65536 ELSE {scalar.draw_sql(f'{k} * 7919 + 5', '65536')} END AS ipid, {pick(4)} AS df,
 CASE WHEN pmask = 1 THEN CASE WHEN src % 4 = 2 THEN CAST({scalar.draw_sql(f'{k} * 7919 + 9', '65535')} + 1 AS VARCHAR) ELSE {pick(1)} END ELSE '' END AS win, CASE WHEN pmask = 1 THEN {pick(2)} ELSE '' END AS optsig, CASE WHEN pmask = 1 THEN {pick(3)} ELSE '' END AS seqrel,
 CASE WHEN pmask = 2 THEN '8' ELSE '' END AS plen, CASE WHEN pmask = 2 THEN {pick(5)} ELSE '' END AS phead FROM flows CROSS JOIN (SELECT unnest(range(0, 2)) AS j))"""


def from_raw(raw: DataFrame, start: int) -> DataFrame:
    """Records from raw JSON-lines rows (flows.read_raw): times parsed, attributes cleaned (PRJ1), sampled frames parsed; frames that don't parse are left out (D3)."""
    r = raw.withColumn("seq", F.monotonically_increasing_id())
    t0, t1 = scalar.iso_epoch(F.col("First")), scalar.iso_epoch(F.col("Last"))
    base = r.select(
        F.col("SourceIP").alias("src"), F.floor((F.when(t0 > 0, t0).otherwise(t1) - start) / 3600).alias("h"), "seq", t0.alias("t0"), t1.alias("t1"), F.col("Port").alias("port"), "pmask", F.col("Packets").alias("pk"), F.col("Bytes").alias("bytes"), F.col("UniqueDests").alias("ud"),
        F.col("UniqueDest24s").alias("ud24"), F.col("Zmap").alias("zm"), F.col("Masscan").alias("ms"), F.col("Mirai").alias("mi"), F.col("ASN").cast("string").alias("asn"), scalar.clean(F.col("Country"), 4).alias("cc"), scalar.clean(F.col("Org"), 48).alias("org"),
        scalar.clean(F.get(F.col("RDNS"), 0), 64).alias("rdns"), F.col("Samples").alias("frames"),
    )
    one = packets.parse_frames(base.select("seq", "t0", "port", F.posexplode("frames").alias("j", "frame")), "frame").filter("proto is not null")
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(""))
    value = {"n": F.col("seq") * 64 + F.col("j"), "t": F.col("t0"), "dport": F.col("port")} | {k: F.col(k) for k in ("proto", "dst", "ttl", "ipid", "df")} | {k: text(k) for k in ("sport", "win", "optsig", "seqrel", "plen", "phead")}
    got = one.groupBy("seq").agg(F.array_sort(F.collect_list(_sample(**value))).alias("samples"))
    out = base.join(got, "seq", "left").withColumn("samples", F.coalesce("samples", F.array().cast(f"array<struct<{SAMPLE.replace(' ', ':').replace(',:', ',')}>>")))
    return out.select(*COLUMNS)
