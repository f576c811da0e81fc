"""Reduction of records to source-hours and accumulation of these to sources, with bounded samples (AG1-AG6).

Sums, maxima, ors and counts are partial aggregates. Samples are bottom-k by a
reproducible hash: a rank with a limit, which Spark applies before its shuffle, so
a source with a third of all records sends at most k rows of each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import bitmap, scalar

#: Samples kept of a source-hour before and after the spaced pick, and of a source. Stride that counts as sequential.
RESERVOIR, KEEP, SOURCE_SAMPLES, STRIDE = 32, 8, 160, 1024


def sample_order(src: Column, n: Column) -> Column:
    """What samples are drawn by."""
    return scalar.draw(n * 7919 + F.pmod(src, F.lit(1_000_003)) * 104729 + 17, scalar.M31)


def strides(dst: Column) -> tuple[Column, Column, Column]:
    """AG2: steps between consecutive sampled destinations: forward and backward ones of at most STRIDE, and all others."""
    d = scalar.deltas(dst)
    up, down = F.size(F.filter(d, lambda x: x.between(1, STRIDE))), F.size(F.filter(d, lambda x: x.between(-STRIDE, -1)))
    return up, down, F.size(d) - up - down


def bottom(samples: DataFrame, by: list[str], most: int) -> DataFrame:
    """(*by, samples): the ``most`` samples of each group first in sample_order, by time. samples: (*by, src, s)."""
    w = W.partitionBy(*by).orderBy(sample_order(F.col("src"), F.col("s.n")), "s.n")
    kept = samples.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    sorted_ = F.array_sort(F.collect_list(F.struct("s.t", "s.n", "s")))
    return kept.groupBy(*by).agg(F.transform(sorted_, lambda x: x["s"]).alias("samples"))


def spaced(a: Column, k: int) -> Column:
    """SO9, AG4: k evenly spaced elements, or all where there are no more than k."""
    n = F.size(a)
    return F.when(n <= k, a).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(a, F.floor(i * n / k).cast("int"))))


def reduce_records(records: DataFrame) -> DataFrame:
    """AG1-AG4: one row per hour and source; attributes are those of the first record."""
    up, down, far = strides(F.transform("samples", lambda s: s["dst"]))
    lasting = F.when((F.col("t0") > 0) & (F.col("t1") >= F.col("t0")), F.col("t1") - F.col("t0")).otherwise(F.lit(0).cast("bigint"))
    r = records.withColumn("up", up).withColumn("down", down).withColumn("far", far).withColumn("lasting", lasting)
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    per_port = r.groupBy("h", "src", "port").agg(
        F.bit_or("pmask").alias("pm"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("pk", "bytes", "ud", "ud24", "lasting", "up", "down", "far")], F.max("ud").alias("udmax"), F.min(F.nullif("t0", F.lit(0))).alias("t0"), F.max("t1").alias("t1"),
        flag("zm"), flag("ms"), flag("mi"), F.min(F.struct("seq", "asn", "cc", "org", "rdns")).alias("first"),
    )
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "port"))), 1, 5)
    g = per_port.groupBy("h", "src").agg(
        F.bit_or("pm").alias("pmask"), F.sum("n").alias("nrec"), F.count("*").alias("nports"), F.map_from_entries(F.transform(top, lambda s: F.struct(s["port"], -s["k"]))).alias("topports"), F.sum("pk").alias("pk"), F.sum("bytes").alias("bytes"), F.sum("ud").alias("ud"),
        F.sum("ud24").alias("ud24"), F.max("udmax").alias("udmax"), F.coalesce(F.min("t0"), F.lit(0).cast("bigint")).alias("t0"), F.max("t1").alias("t1"), F.sum("lasting").alias("dur"), *[F.sum(k).alias(k) for k in ("zm", "ms", "mi")], F.min("first").alias("first"),
        F.sum("up").alias("stride_pos"), F.sum("down").alias("stride_neg"), F.sum("far").alias("stride_big"),
    )
    got = bottom(records.select("h", "src", F.explode("samples").alias("s")), ["h", "src"], RESERVOIR).withColumn("samples", spaced(F.col("samples"), KEEP))
    out = g.join(got, ["h", "src"], "left")
    none = F.array().cast(out.schema["samples"].dataType)
    return out.select(
        "h", "src", "pmask", "nrec", "nports", "topports", "pk", "bytes", "ud", "ud24", "udmax", "t0", "t1", "dur", "zm", "ms", "mi", *[F.col(f"first.{k}").alias(k) for k in ("asn", "cc", "org", "rdns")], "stride_pos", "stride_neg", "stride_big",
        F.coalesce("samples", none).alias("samples"),
    )


SUMS = ("nrec", "pk", "bytes", "ud", "ud24", "zm", "ms", "mi", "stride_pos", "stride_neg", "stride_big")


def _maps(rows: DataFrame, of: str, key: str, value: str) -> DataFrame:
    """(src, of): summed counts per key as a map."""
    return rows.groupBy("src", key).agg(F.sum(value).alias("n")).groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias(of))


def partial(hours: DataFrame, days: int = 7) -> DataFrame:
    """AG5: what a source's hours amount to, in a form that merge() can add up. Hours before the window (below 0) count in all sums and in no bitmap (FIL8)."""
    inside, known = F.col("h") >= 0, F.col("rdns") != ""
    h = F.when(inside, F.col("h"))
    base = hours.groupBy("src").agg(
        F.bit_or("pmask").alias("pm"), *[F.sum(c).alias(c) for c in SUMS], F.max("nports").alias("nports"), F.max("udmax").alias("udmax"), F.min(F.nullif("t0", F.lit(0))).alias("t0"), F.max("t1").alias("t1"), bitmap.day_words(h, days).alias("words"), F.min(h).alias("hfirst"), F.max(h).alias("hlast"),
        F.min(F.struct("h", "asn", "cc", "org")).alias("first"), F.min(F.when(known, F.struct("h", "rdns"))).alias("named"),
    )
    ports = _maps(hours.select("src", F.explode("topports").alias("port", "n")), "port_n", "port", "n")
    per_hour = _maps(hours.filter(inside), "hour_pk", "h", "pk")
    return _whole(base.join(ports, "src", "left").join(per_hour, "src", "left").join(bottom(hours.select("src", F.explode("samples").alias("s")), ["src"], SOURCE_SAMPLES), "src", "left"))


def _whole(parts: DataFrame) -> DataFrame:
    """Empty maps and samples where a source has none."""
    kinds = {f.name: f.dataType for f in parts.schema}
    none = {"port_n": F.create_map().cast("map<int,bigint>"), "hour_pk": F.create_map().cast("map<bigint,bigint>"), "samples": F.array().cast(kinds["samples"])}
    return parts.withColumns({k: F.coalesce(k, v) for k, v in none.items()})


def merge(parts: DataFrame, days: int = 7) -> DataFrame:
    """AG5's merge law: any number of partial() rows of a source as one. Sums, ors, minima, maxima, maps by key, bottom-k samples: whatever the split, the same rows."""
    base = parts.groupBy("src").agg(
        F.bit_or("pm").alias("pm"), *[F.sum(c).alias(c) for c in SUMS], F.max("nports").alias("nports"), F.max("udmax").alias("udmax"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.array(*[F.bit_or(F.get("words", d)) for d in range(days)]).alias("words"), F.min("hfirst").alias("hfirst"), F.max("hlast").alias("hlast"),
        F.min("first").alias("first"), F.min("named").alias("named"),
    )
    ports = _maps(parts.select("src", F.explode("port_n").alias("port", "n")), "port_n", "port", "n")
    per_hour = _maps(parts.select("src", F.explode("hour_pk").alias("h", "pk")), "hour_pk", "h", "pk")
    return _whole(base.join(ports, "src", "left").join(per_hour, "src", "left").join(bottom(parts.select("src", F.explode("samples").alias("s")), ["src"], SOURCE_SAMPLES), "src", "left")).select(*parts.columns)


def finished(parts: DataFrame) -> DataFrame:
    """One row per source, ready for a profile, from partial() or merge()."""
    ranked = F.slice(F.array_sort(F.transform(F.map_entries("port_n"), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("port")))), 1, 3)
    return parts.select(
        "src", "pm", "nrec", "nports", F.size("port_n").alias("ports"), F.transform(ranked, lambda x: x["port"]).alias("top3"), "pk", "bytes", "ud", "ud24", "udmax", F.coalesce("t0", F.lit(0).cast("bigint")).alias("t0"), "t1", "words", "hfirst", "hlast", "hour_pk", "zm", "ms", "mi", "stride_pos", "stride_neg", "stride_big",
        F.col("first.asn").alias("asn"), F.col("first.cc").alias("cc"), F.col("first.org").alias("org"), F.coalesce("named.rdns", F.lit("")).alias("rdns"), "samples",
    )


def accumulate(hours: DataFrame, days: int = 7) -> DataFrame:
    """AG5: one row per source from source-hours."""
    return finished(partial(hours, days))
