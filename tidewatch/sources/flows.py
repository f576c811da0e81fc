"""Readers of flow records, all with explicit schemas (no inference pass over the data)."""

from __future__ import annotations

import contextlib
import contextvars

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = """SourceIP STRING, Port INT, Traffic INT, First STRING, Last STRING, Packets BIGINT, Bytes BIGINT, UniqueDests BIGINT,
UniqueDest24s BIGINT, Country STRING, ASN BIGINT, Org STRING, RDNS ARRAY<STRING>, Zmap BOOLEAN, Masscan BOOLEAN, Mirai BOOLEAN, Samples ARRAY<STRING>"""
#: Traffic codes that are kept and the bit each sets.
CLASSES = {11: 1, 16: 2, 0: 4}
#: Hours from the epoch to the start of the test window, 2024-01-01 UTC.
START_HOUR = 473352


def class_bit(code: Column) -> Column:
    """The bit of a probing class; null for traffic that is dropped."""
    out = F.when(F.lit(False), F.lit(0))
    for k, v in CLASSES.items():
        out = out.when(code == k, F.lit(v))
    return out


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines records of the probing classes, unparsable lines dropped, missing keys as 0, "" or []."""
    rows = spark.read.schema(RAW + ", _corrupt_record STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = rows.filter(F.col("_corrupt_record").isNull() & F.col("SourceIP").isNotNull()).withColumn("pmask", class_bit(F.coalesce("Traffic", F.lit(-1)))).filter("pmask is not null")
    return rows.drop("_corrupt_record").fillna(0, ["Port", "Packets", "Bytes", "UniqueDests", "UniqueDest24s", "ASN"]).fillna("", ["Country", "Org"]).fillna(False, ["Zmap", "Masscan", "Mirai"])


def read_source_hours(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Tab-separated source-hour rows (plain or .zst) without header or quoting; rows of under 25 fields dropped, numbers that don't parse null."""
    names = "batch src pmask nrec nports topports pk bytes ud ud24 udmax t0 t1 dur zm ms mi asn cc org rdns stride_pos stride_neg stride_big samples".split()
    text = {"batch", "src", "topports", "asn", "cc", "org", "rdns", "samples"}
    f = F.split("value", "\t")
    rows = spark.read.text(paths).withColumn("f", f).filter(F.size("f") >= 25)
    out = rows.select(*[(F.get("f", i) if n in text else F.get("f", i).try_cast("bigint")).alias(n) for i, n in enumerate(names)])
    return out.withColumn("topports", F.expr("transform_values(transform_keys(str_to_map(topports, ',', ':'), (k, v) -> try_cast(k as int)), (k, v) -> try_cast(v as bigint))"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How event types stand for ports and traffic codes.
EVENT_PORT = {"click": 80, "view": 443, "purchase": 8080, "signup": 22, "error": 23}
EVENT_CLASS = {"click": 1, "view": 1, "purchase": 1, "signup": 2, "error": 4}


def lookup(key: Column, table: dict) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out


#: The week that event_flows() reads, counted from START_HOUR; None for the whole table.
WEEK: contextvars.ContextVar[int | None] = contextvars.ContextVar("week", default=0)


@contextlib.contextmanager
def week(k: int | None):
    """Within it event_flows() gives the flows of week k, its hours counted from 0, or with None all flows of the table."""
    token = WEEK.set(k)
    try:
        yield
    finally:
        WEEK.reset(token)


def event_weeks(spark: SparkSession, sf_dir: str) -> list[int]:
    """The weeks in which the events table has rows."""
    k = F.floor((F.floor(F.unix_timestamp("ts") / 3600) - START_HOUR) / 168)
    return sorted(r.k for r in load(spark, sf_dir, "events").select(k.alias("k")).distinct().collect() if r.k is not None)


def event_flows(spark: SparkSession, sf_dir: str, hours: int = 168) -> DataFrame:
    """The events table as flow records of a window: (id, src, t, h, port, pmask, pk, bytes, dst, cc, asn, org). The window is the first ``hours`` of a week(), or all."""
    e = load(spark, sf_dir, "events")
    h = F.floor(F.unix_timestamp("ts") / 3600) - START_HOUR
    k = WEEK.get()
    e = e.withColumn("h", h.cast("bigint") - 168 * (k or 0))
    if k is not None:
        e = e.filter((F.col("h") >= 0) & (F.col("h") < hours))
    who = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = e.join(who, F.col("user_id") == F.col("c_custkey"))
    return rows.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("src"), F.unix_timestamp("ts").alias("t"), "h",
        lookup(F.col("event_type"), EVENT_PORT).alias("port"), lookup(F.col("event_type"), EVENT_CLASS).alias("pmask"),
        F.ceil(F.col("value") / 10).cast("bigint").alias("pk"), F.round(F.col("value") * 100).cast("bigint").alias("bytes"),
        (F.get_json_object("props", "$.k").cast("bigint") * 5243).alias("dst"), F.col("n_name").alias("cc"), F.col("c_nationkey").cast("int").alias("asn"), F.col("c_mktsegment").alias("org"),
    )
