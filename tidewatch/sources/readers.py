"""Readers of the text formats and result files (SRC2-SRC11, SRC14, SRC15). Explicit schemas throughout: no inference pass over the data."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from . import records


def listed(spark: SparkSession, folder: str, stem: str = "*", most: int | None = None) -> list[str]:
    """SRC4: paths of folder/stem.tsv.zst and folder/stem.tsv, by name, at most ``most``. Found through Hadoop's file systems, so any store will do."""
    jvm, found = spark.sparkContext._jvm, []
    for end in (".tsv.zst", ".tsv"):
        pattern = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{stem}{end}")
        hits = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        found += [str(x.getPath().toString()) for x in hits or []]
    return sorted(found, key=lambda p: p.rsplit("/", 1)[-1])[:most]


def batch_hour(label: Column, start: int) -> Column:
    """SC3: hours from ``start`` (epoch seconds) to a label such as 2026-09-24.07."""
    return F.floor((F.unix_timestamp(F.try_to_timestamp(label, F.lit("yyyy-MM-dd.HH"))) - start) / 3600)


def hour_batch(h: Column, start: int) -> Column:
    """SC3, the other way round."""
    return F.date_format(F.timestamp_seconds(h * 3600 + start), "yyyy-MM-dd.HH")


def parsed_samples(text: Column) -> Column:
    """D3: samples from their text, entries of under 13 fields or with numbers that don't parse left out; n is an entry's place."""
    fields = records.SAMPLE_FIELDS[1:]
    kinds = dict(x.split() for x in records.SAMPLE.split(", "))
    part = lambda x, i, k: F.get(F.split(x, ","), i) if kinds[k] == "string" else F.get(F.split(x, ","), i).try_cast(kinds[k])
    every = F.transform(F.split(text, ";"), lambda x, j: F.when(F.size(F.split(x, ",")) >= 13, F.struct(j.cast("bigint").alias("n"), *[part(x, i, k).alias(k) for i, k in enumerate(fields)])))
    whole = lambda s: s.isNotNull() & F.lit(True)
    numbers = [k for k in fields if kinds[k] != "string"]

    def fine(s: Column) -> Column:
        ok = whole(s)
        for k in numbers:
            ok = ok & s[k].isNotNull()
        return ok

    return F.when(text == "", F.filter(every, lambda s: F.lit(False))).otherwise(F.filter(every, fine))


def read_hours(spark: SparkSession, paths: str | list[str], start: int, shard: tuple[int, int] | None = None, hours: tuple[int, int] | None = None, most: int | None = None) -> DataFrame:
    """SRC2, SRC3: source-hours from tab-separated lines, plain or .zst (bytes that aren't UTF-8 replaced), ready for accumulate().

    Lines of under 25 fields are dropped (FIL2). shard (k, n): sources whose crc32
    mod n is k (FIL3). hours: half-open range (FIL4). most: rows at most (FIL5).
    """
    names = "batch src pmask nrec nports topports pk bytes ud ud24 udmax t0 t1 dur zm ms mi asn cc org rdns stride_pos stride_neg stride_big samples".split()
    text = {"batch", "src", "topports", "asn", "cc", "org", "rdns", "samples"}
    lines = spark.read.text(paths).withColumn("f", F.split("value", "\t")).filter(F.size("f") >= 25)
    r = lines.select(*[(F.get("f", i) if n in text else F.get("f", i).try_cast("bigint")).alias(n) for i, n in enumerate(names)])
    r = r.withColumn("h", batch_hour(F.col("batch"), start))
    if shard:
        r = r.filter(F.pmod(F.crc32(F.col("src").cast("binary")), F.lit(shard[1])) == shard[0])
    if hours:
        r = r.filter((F.col("h") >= hours[0]) & (F.col("h") < hours[1]))
    if most is not None:
        r = r.limit(most)
    ports = F.expr("transform_values(transform_keys(str_to_map(topports, ',', ':'), (k, v) -> try_cast(k as int)), (k, v) -> try_cast(v as bigint))")
    return r.withColumn("topports", F.when(F.col("topports") == "", F.create_map().cast("map<int,bigint>")).otherwise(ports)).withColumn("samples", parsed_samples(F.col("samples"))).withColumn("pmask", F.col("pmask").cast("int"))


def read_profiles(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """SRC5, SRC6: profiles from tab-separated text without header, several shards as one. nan is undefined; the country NA stays NA, and empty text stays empty. Name the columns wanted: others are not parsed."""
    r = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("nanValue", "nan").option("nullValue", "\u0000").option("emptyValue", "").csv(paths)
    return r.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if t in ("double", "float") else F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in r.dtypes])


#: Header of the per-packet file. Fixed value.
PACKET_HEADER = "time,src_id,cntry,lat,long,asn,dst_ip,src_port"


def read_packets(spark: SparkSession, paths: str | list[str], slice_bits: int = 19) -> DataFrame:
    """SRC7, SRC8: (t, src, cc, asn, dst24, sport, slice) from per-packet lines, plain or .gz. The asn field can hold commas, so fields are counted from both ends; its leading digits count, 0 without any. A first line other than the header raises ValueError."""
    lines = spark.read.text(paths)
    first = lines.filter(F.col("value").startswith("time,")).select("value").distinct().limit(2).collect()
    if [r.value for r in first] != [PACKET_HEADER]:
        raise ValueError(f"not the header of per-packet lines: {[r.value for r in first]}")
    f = F.split("value", ",")
    r = lines.filter(F.col("value") != PACKET_HEADER).withColumn("f", f).filter(F.size("f") >= 8)
    dst = scalar.ip_int(F.element_at("f", -2)).bitwiseAND(F.lit(0xFFFFFF))
    r = r.select(F.get("f", 0).try_cast("double").alias("t"), scalar.ip_int(F.get("f", 1)).alias("src"), F.get("f", 2).alias("cc"), F.coalesce(F.regexp_extract(F.get("f", 5), r"^(\d+)", 1).try_cast("bigint"), F.lit(0)).alias("asn"), dst.alias("dst24"), F.element_at("f", -1).try_cast("int").alias("sport"))
    return r.withColumn("slice", F.shiftright("dst24", slice_bits).cast("int"))


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """SRC9: a JSON document; None where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: (src, camp) from tab-separated text; -1 is no campaign and is dropped."""
    return spark.read.schema("src STRING, camp BIGINT").option("sep", "\t").csv(path).filter("camp >= 0")


def read_embedding_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: (h, src, ports, t0, t1, pk) from lines of six tab-separated fields; shorter ones are dropped, empty times are 0."""
    f = F.split("value", "\t")
    r = spark.read.text(path).withColumn("f", f).filter(F.size("f") >= 6)
    ports = F.when(F.get("f", 2) == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(F.get("f", 2), F.lit(","), F.lit(":")))
    number = lambda i: F.coalesce(F.get("f", i).try_cast("bigint"), F.lit(0))
    r = r.select(number(0).alias("h"), F.get("f", 1).alias("src"), ports.alias("ports"), number(3).alias("t0"), number(4).alias("t1"), number(5).alias("pk"))
    return r.withColumn("ports", F.expr("transform_values(transform_keys(ports, (k, v) -> try_cast(k as int)), (k, v) -> try_cast(v as bigint))"))


def asked(states: DataFrame, ask: Callable[[str], dict], retries: int = 2, wait: float = 2.0) -> DataFrame:
    """SRC14: states(id, state) -> (id, answer, seconds): the answer of a decision service as JSON text, one call a row.

    ``ask`` makes the call (decisions.rule_service is an offline one); it is tried
    again after an error, and an error that stays is an answer {"error": ...}.
    """

    def run(batches):
        import time

        import pyarrow as pa

        for batch in batches:
            out = []
            for state in batch.column("state").to_pylist():
                began = time.time()
                for k in range(retries + 1):
                    try:
                        got = ask(state)
                        break
                    except Exception as e:  # noqa: BLE001  an answer of its own
                        got, began = {"error": str(e)}, time.time()
                        if k < retries:
                            time.sleep(wait)
                out.append((json.dumps(got, sort_keys=True), time.time() - began))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["id", "answer", "seconds"])

    return states.select(F.col("id").cast("long"), "state").mapInArrow(run, "id long, answer string, seconds double")


#: The replay document's schema; every field may be missing (SRC15).
DOCUMENT = """meta STRUCT<title: STRING, telescope: STRING, window_start: STRING, hours: DOUBLE, n_profiles: DOUBLE, n_campaigns: DOUBLE, n_orchestrated: DOUBLE, anonymized: BOOLEAN, synthetic: BOOLEAN, note: STRING>,
hourly ARRAY<STRUCT<h: DOUBLE, records: DOUBLE, sources: DOUBLE>>,
campaigns ARRAY<STRUCT<id: DOUBLE, bots: DOUBLE, port: STRING, proto: STRING, tool: STRING, strategy: STRING, orchestrated: BOOLEAN, z: DOUBLE, pph_med: DOUBLE, coverage: DOUBLE, first_h: DOUBLE, last_h: DOUBLE, first_detected_h: DOUBLE, asns: DOUBLE,
 fingerprint: MAP<STRING, STRING>, countries: MAP<STRING, DOUBLE>, activity: ARRAY<DOUBLE>, points: ARRAY<ARRAY<DOUBLE>>, decision: STRUCT<tool: MAP<STRING, DOUBLE>, service: MAP<STRING, DOUBLE>, cls: MAP<STRING, DOUBLE>, coordinated: DOUBLE, severity: MAP<STRING, DOUBLE>>>>"""
