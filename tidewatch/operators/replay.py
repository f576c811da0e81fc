"""The replay document and what a viewer makes of it (Q14, MX1-MX3, MX5, MX8, MX10-MX13, SRC15, SC28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import bitmap, scalar
from . import decisions as words
from .campaigns import top

#: Names of strategies and protocols in the document. Fixed values.
STRATEGY = {"uperm": "uniform", "seq_fwd": "seq_inc", "seq_rev": "seq_dec", "perm": "nonuniform"}
PROTO = {1: "TCP", 2: "UDP", 4: "ICMP"}


def chosen(campaigns: DataFrame, most: int, most_orchestrated: int) -> DataFrame:
    """SET2, SO6: (camp, rank): the largest campaigns and the largest orchestrated ones, each once, ranked by size (smaller number on ties). Lists of campaigns, not of sources."""
    by = W.orderBy(F.desc("bots"), "camp")
    first = campaigns.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= most)
    orch = campaigns.filter("orchestrated").withColumn("r", F.row_number().over(by)).filter(F.col("r") <= most_orchestrated)
    both = first.drop("r").unionByName(orch.drop("r")).dropDuplicates(["camp"])
    return both.select("camp", "bots", F.row_number().over(by).alias("rank")).select("camp", "rank")


def points(samples: DataFrame, members: DataFrame, d0: int, d_size: int, hours: int, most: int = 400) -> DataFrame:
    """MX1, FIL7: (camp, points): at most ``most`` sampled destinations of each campaign as (hours, share of the block), rounded to 3 and 5 digits, in order; drawn by a reproducible hash. samples: (src, h, n, t, dst)."""
    off = (F.col("dst") - d0) / d_size
    x = samples.filter((F.col("h") >= 0) & (F.col("h") < hours) & (off >= 0) & (off < 1)).join(members.select("src", "camp"), "src")
    pick = scalar.draw(F.col("n") * 7919 + F.pmod("src", F.lit(1_000_003)) * 104729 + 29, scalar.M31)
    kept = x.withColumn("k", F.row_number().over(W.partitionBy("camp").orderBy(pick, "src", "n"))).filter(F.col("k") <= most)
    one = F.array(F.round(F.col("h") + (F.col("t") % 3600) / 3600.0, 3), F.round(off, 5))
    return kept.groupBy("camp").agg(F.array_sort(F.collect_list(one)).alias("points"))


def hourly_totals(hours: DataFrame) -> DataFrame:
    """MX2, AG26: (h, records, sources)."""
    return hours.groupBy("h").agg(F.sum("nrec").alias("records"), F.count("*").alias("sources"))


def cards(p: DataFrame, members: DataFrame, landscape: DataFrame, hours: int, d_size: int, min_size: int = 10) -> DataFrame:
    """Q14: a card for each campaign of members: what the document says of it, MX3's undetermined ones null. landscape: inference.landscape()."""
    m = members.select("src", "camp").join(p, "src")
    on = m.select("camp", F.explode(bitmap.hours(F.col("words"))).alias("h")).groupBy("camp", "h").agg(F.count("*").alias("n")).groupBy("camp").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("a"))
    activity = F.transform(F.sequence(F.lit(0), F.lit(hours - 1)), lambda h: F.coalesce(F.try_element_at("a", h), F.lit(0).cast("bigint")))
    det = m.withColumn("r", F.row_number().over(W.partitionBy("camp").orderBy("hfirst", "src"))).filter(F.col("r") <= min_size).groupBy("camp").agg(F.max("hfirst").alias("first_detected_h"))
    cc = top(m.withColumn("cc", F.when(F.col("cc") == "", "??").otherwise(F.col("cc"))), ["camp"], "cc", 12).groupBy("camp").agg(F.map_from_entries(F.collect_list(F.struct("cc", "n"))).alias("countries"))
    most = lambda c: F.expr(f"mode({c}, true)")
    said = m.groupBy("camp").agg(*[most(c).alias(f"m_{c}") for c in ("ttl", "ipid", "opts", "sportp")])
    x = landscape.join(on, "camp").join(det, "camp").join(cc, "camp").join(said, "camp")
    f = F.split("fpc", r"\|")
    tcp = F.get(f, 0) != "udp"
    win = F.coalesce(F.substring(F.get(F.filter(f, lambda y: y.startswith("w")), 0), 2, 9), F.lit(""))
    has = lambda y: F.array_contains(f, y)
    pairs = {
        "TTL": F.col("m_ttl").cast("string"), "IP ID": words.named(F.col("m_ipid"), words.IPID), "TCP window": F.when(tcp, F.when(win.isin("x", ""), "varies").otherwise(win)).otherwise("-"), "TCP options": F.when(tcp, words.options_text(F.col("m_opts"))).otherwise("-"),
        "Seq number": F.when(tcp, F.when(has("sD"), "equals destination").when(has("sZ"), "zero").otherwise("other")).otherwise("-"), "Source port": words.named(F.col("m_sportp"), words.SPORT),
    }
    port = F.regexp_replace(F.regexp_replace(F.regexp_replace("portsig", "^p+", ""), "multi", "many"), r"\+", "/")
    proto = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in PROTO.items() for v in kv]), F.col("proto").cast("int")), F.lit("mixed"))
    strategy = F.try_element_at(F.create_map(*[F.lit(v) for kv in STRATEGY.items() for v in kv]), F.col("strategy"))
    return x.select(
        "camp", "bots", port.alias("port"), proto.alias("proto"), words.tool_label(F.col("fpc"), F.col("research")).alias("tool"), strategy.alias("strategy"), F.when(F.col("testable"), F.col("orchestrated")).alias("orchestrated"), F.when(F.col("testable"), F.round("z", 2)).alias("z"), F.round("pph_med", 2).alias("pph_med"),
        F.round(F.least(F.lit(1.0), F.col("ud_sum") / d_size), 4).alias("coverage"), F.col("hfirst_min").alias("first_h"), F.col("hlast_max").alias("last_h"), "first_detected_h", F.col("n_asn").alias("asns"), F.create_map(*[y for k, v in pairs.items() for y in (F.lit(k), v)]).alias("fingerprint"), "countries", activity.alias("activity"),
    )


def document(cards_: DataFrame, picked: DataFrame, points_: DataFrame, hourly: DataFrame, meta: dict) -> DataFrame:
    """Q14: one row (meta, hourly, campaigns); campaigns by rank. A document holds the chosen campaigns alone, so its size is bounded by their number."""
    rows = cards_.join(picked, "camp").join(points_, "camp", "left").withColumn("points", F.coalesce("points", F.array().cast("array<array<double>>"))).withColumn("id", F.col("rank"))
    cols = ["id", *[c for c in rows.columns if c not in ("id", "camp", "rank")]]
    camps = rows.agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*cols).alias("c"))), lambda a, b: a["rank"] - b["rank"]).alias("x")).select(F.transform("x", lambda y: y["c"]).alias("campaigns"))
    hours = hourly.agg(F.array_sort(F.collect_list(F.struct("h", "records", "sources"))).alias("hourly"))
    return hours.crossJoin(camps).select(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]).alias("meta"), "hourly", "campaigns")


# ---------------------------------------------------------------- the viewer's side
def finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def unique_ids(ids: Column) -> Column:
    """MX13: whole ids of a document's campaigns, in order; a missing or repeated one becomes the first free number from its place on. A fold over one document."""
    def step(used: Column, x: Column) -> Column:
        own = F.round(x["id"]).cast("bigint")
        free = F.filter(F.sequence(x["at"], x["at"] + F.size(used)), lambda k: ~F.array_contains(used, k))
        return F.concat(used, F.array(F.when(own.isNotNull() & ~F.array_contains(used, own), own).otherwise(F.get(free, 0))))

    return F.aggregate(F.transform(ids, lambda x, i: F.struct(x.alias("id"), (i + 1).cast("bigint").alias("at"))), F.array().cast("array<bigint>"), step)


def normalised(documents: DataFrame) -> DataFrame:
    """SRC15, MX3, MX11-MX13: the campaigns of documents (readers.DOCUMENT) as rows, every field made whole: ids, activity of the window's length, first, last and peak hour, detection, points inside the window."""
    longest = F.array_max(F.concat(F.array(F.coalesce(F.size("hourly"), F.lit(0))), F.transform(F.coalesce("campaigns", F.array().cast(documents.schema["campaigns"].dataType)), lambda c: F.greatest(F.coalesce(F.size(c["activity"]), F.lit(0)), F.lit(0)))))
    given = F.floor(finite(F.col("meta.hours")))
    d = documents.withColumn("H", F.least(F.when(given >= 1, given).when(longest > 0, longest).otherwise(168), F.lit(24 * 366)).cast("int")).withColumn("ids", unique_ids(F.transform("campaigns", lambda c: finite(c["id"]))))
    d = d.select("H", F.explode(F.arrays_zip("ids", "campaigns")).alias("x")).select("H", F.col("x.ids").alias("id"), F.col("x.campaigns").alias("c"))
    act = F.transform(F.sequence(F.lit(0), F.col("H") - 1), lambda h: F.greatest(F.coalesce(finite(F.get(F.col("c.activity"), h)), F.lit(0.0)), F.lit(0.0)))
    d = d.withColumn("activity", act).withColumn("most", F.array_max("activity"))
    some = F.transform("activity", lambda v, h: F.when(v > 0, h))
    d = d.withColumn("lo", F.array_min(some)).withColumn("hi", F.array_max(some))
    clamp = lambda c: F.when(c.isNotNull(), F.least(F.greatest(F.floor(c).cast("int"), F.lit(0)), F.col("H") - 1))
    a = F.coalesce(clamp(finite(F.col("c.first_h"))), F.col("lo"), F.lit(0))
    b = F.coalesce(clamp(finite(F.col("c.last_h"))), F.col("hi"), F.col("H") - 1)
    d = d.withColumn("first_h", F.least(a, b)).withColumn("last_h", F.greatest(a, b)).withColumn("det", F.coalesce(clamp(finite(F.col("c.first_detected_h"))), F.col("first_h")))
    inside = F.filter("c.points", lambda q: (F.size(q) >= 2) & finite(q[0]).isNotNull() & finite(q[1]).isNotNull() & (q[0] >= 0) & (q[0] <= F.col("H")) & (q[1] >= 0) & (q[1] <= 1))
    orch = F.when(F.col("c.orchestrated").isNull(), "undetermined").when(F.col("c.orchestrated"), "orchestrated").otherwise("independent")
    return d.select(
        "id", F.greatest(F.round(F.coalesce(finite(F.col("c.bots")), F.col("most"))), F.lit(0.0)).cast("bigint").alias("bots"), F.col("c.port").alias("port"), F.upper("c.proto").alias("proto"), F.col("c.tool").alias("tool"), F.col("c.strategy").alias("strategy"), orch.alias("state"), finite(F.col("c.z")).alias("z"), "first_h", "last_h", "det",
        F.when(F.col("most") > 0, F.array_position("activity", F.col("most")) - 1).otherwise(F.lit(-1).cast("bigint")).alias("peak_h"), F.col("most").alias("peak"), span(F.col("first_h"), F.col("last_h"), F.col("H")).alias("span"), F.coalesce(F.size(inside), F.lit(0)).alias("points"),
        F.lower(F.concat_ws(" ", "c.port", "c.proto", "c.tool", "c.strategy", orch)).alias("search"), F.col("c.decision").alias("decision"),
    )


def span(first: Column, last: Column, hours: Column) -> Column:
    """MX11: (lo, hi) of a campaign's display: its life, at least 12 hours wide, inside the window."""
    wide = F.least(F.lit(12.0), hours.cast("double"))
    lo, hi = first.cast("double"), (last + 1).cast("double")
    mid = (lo + hi) / 2
    a, b = mid - wide / 2, mid + wide / 2
    narrow = F.when(a < 0, F.struct(F.lit(0.0).alias("lo"), F.least(b - a, hours.cast("double")).alias("hi"))).when(b > hours, F.struct(F.greatest(a - (b - hours), F.lit(0.0)).alias("lo"), hours.cast("double").alias("hi"))).otherwise(F.struct(a.alias("lo"), b.alias("hi")))
    return F.when(hi - lo < wide, narrow).otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))


def latest(campaigns: DataFrame, hour: int) -> DataFrame:
    """MX10: one row: the latest report by an hour (most sources on ties, then the smaller id), and how many came in that hour. campaigns: (id, det, bots)."""
    seen = campaigns.filter(F.col("det") <= hour)
    best = seen.agg(F.max(F.struct("det", "bots", (-F.col("id")).alias("id"))).alias("x"))
    n = seen.groupBy("det").agg(F.count("*").alias("same_hour"))
    return best.select((-F.col("x.id")).alias("id"), F.col("x.det").alias("det"), F.col("x.bots").alias("bots")).join(n, "det").select("id", "det", "bots", "same_hour")


def padded_range(rows: DataFrame, value: str) -> DataFrame:
    """AG28: one row (lo, hi) of a series, with room of 12 % below and 6 % above; null without values."""
    r = rows.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    wide = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).when(F.col("b") != 0, F.abs("b")).otherwise(1)
    return r.select((F.col("a") - wide * 0.12).alias("lo"), (F.col("b") + wide * 0.06).alias("hi"))


def agrees(p: Column, verdict: Column) -> Column:
    """MX8: whether a probability of coordination (0.5 or more) says what the test says; null where either is missing."""
    return F.when(p.isNotNull() & verdict.isNotNull(), (p >= 0.5) == verdict)


def sampled_hours(activity: Column, n: int, key: Column, seed: int = 5) -> Column:
    """WN14: n hours drawn in proportion to an array of hourly activity: the first hour whose cumulative share reaches a draw."""
    total = F.aggregate(activity, F.lit(0.0), lambda t, x: t + x)
    cum = F.transform(activity, lambda x, h: F.aggregate(F.slice(activity, F.lit(1), h + 1), F.lit(0.0), lambda t, y: t + y))
    draws = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (scalar.draw(key * 7919 + i.cast("bigint") * 104729 + seed, 999983) + 0.5) / 999983 * total)
    return F.when(total > 0, scalar.let(cum, lambda c: F.transform(draws, lambda u: F.size(F.filter(c, lambda x: x < u)).cast("bigint"))))


def service(port: Column) -> Column:
    """SC32: the service that a port stands for."""
    names = {"telnet": (23, 2323), "ssh": (22,), "web": (80, 81, 443, 8080, 8443, 8888), "smb": (139, 445), "sip": (5060,), "database": (1433, 3306, 6379, 9200, 27017), "remote desktop": (3389, 5900)}
    out = F.when(F.lit(False), F.lit(""))
    for name, ports in names.items():
        out = out.when(port.isin(*ports), name)
    return out.otherwise("other")


def sample_document(spark, campaigns: int = 12, hours: int = 168, seed: int = 1) -> DataFrame:  # noqa: ANN001
    """SRC17: a made-up replay document, one row of readers.DOCUMENT's main fields: campaigns of six shapes of activity in turn (always on, waves, ramp, burst, daily, decay), with countries and points, and hourly totals. Every draw is reproducible."""
    d = lambda salt, n, b=0: scalar.draw(F.col("id") * 7919 + (F.lit(b) if isinstance(b, int) else b).cast("bigint") * 104729 + salt * 1_000_003 + seed, n)
    x = spark.range(1, campaigns + 1).withColumn("bots", d(1, 900) + 20).withColumn("start", d(2, hours - 24))
    t = lambda h: h.cast("double")
    shapes = (lambda h: F.lit(0.85), lambda h: (1 + F.sin(t(h) * 2 * 3.141592653589793 / 48)) / 2, lambda h: t(h) / hours, lambda h: F.when(h.between(F.col("start"), F.col("start") + 11), 1.0).otherwise(0.0), lambda h: (1 + F.cos((t(h) % 24 - 14) * 2 * 3.141592653589793 / 24)) / 2, lambda h: F.exp(-t(h) / 40))
    shape = lambda h: F.element_at(F.array(*[s(h) for s in shapes]), (F.col("id") % 6 + 1).cast("int"))
    x = x.withColumn("activity", F.transform(F.sequence(F.lit(0), F.lit(hours - 1)), lambda h: F.round(F.col("bots") * shape(h) * (0.9 + d(3, 1000, h) / 5000.0))))
    share = {c: d(4, 90, i) + 10 for i, c in enumerate(("US", "CN", "BR", "VN"))}
    x = x.withColumn("countries", F.create_map(*[y for c, w in share.items() for y in (F.lit(c), (F.col("bots") * w / 400.0).cast("double"))])).withColumn("at", sampled_hours(F.col("activity"), 40, F.col("id"), seed))
    points = F.array_sort(F.transform("at", lambda h, i: F.array(h.cast("double") + d(5, 1000, i) / 1000.0, d(6, 100_000, i) / 100_000.0)))
    some = F.transform("activity", lambda v, h: F.when(v > 0, h))
    one = F.struct(F.col("id").cast("double").alias("id"), F.col("bots").cast("double").alias("bots"), F.element_at(F.array(*[F.lit(p) for p in ("23", "443", "22", "5060")]), (F.col("id") % 4 + 1).cast("int")).alias("port"), F.when(F.col("id") % 4 == 3, "UDP").otherwise("TCP").alias("proto"),
                   F.when(F.col("id") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("id") % 3 == 1).alias("orchestrated"), F.array_min(some).cast("double").alias("first_h"), F.array_max(some).cast("double").alias("last_h"), "activity", "countries", points.alias("points"))
    x = x.select("id", one.alias("c"), "activity")
    total = x.select(F.posexplode("activity").alias("h", "v")).groupBy("h").agg(F.sum("v").alias("v")).agg(F.array_sort(F.collect_list(F.struct(F.col("h").cast("double").alias("h"), (F.col("v") * 6).alias("records"), F.col("v").alias("sources")))).alias("hourly"))
    camps = x.agg(F.array_sort(F.collect_list(F.struct("id", "c")), lambda a, b: (a["id"] - b["id"]).cast("int")).alias("l")).select(F.transform("l", lambda y: y["c"]).alias("campaigns"))
    return total.crossJoin(camps).select(F.struct(F.lit("Sample").alias("title"), F.lit(float(hours)).alias("hours"), F.lit(True).alias("synthetic")).alias("meta"), "hourly", "campaigns")
