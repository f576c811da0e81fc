"""Writers of source-hours, profiles, campaigns, logs, documents and metrics (SNK1-SNK9). All write through Spark's committers, so a lost task leaves nothing half done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources import records

HOUR_COLUMNS = "batch src pmask nrec nports topports pk bytes ud ud24 udmax t0 t1 dur zm ms mi asn cc org rdns stride_pos stride_neg stride_big samples".split()


def write_source_hours(hours: DataFrame, path: str) -> None:
    """SNK1: Parquet, a folder for each batch label; a batch that is written again replaces itself alone."""
    hours.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def source_hour_lines(hours: DataFrame) -> DataFrame:
    """SNK1: source-hours as lines of 25 tab-separated fields: ports as port:count by commas, most frequent first, samples of 13 fields by semicolons."""
    ports = F.array_sort(F.transform(F.map_entries("topports"), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("p"))))
    text = {
        "topports": F.array_join(F.transform(ports, lambda e: F.concat(e["p"].cast("string"), F.lit(":"), (-e["k"]).cast("string"))), ","),
        "samples": F.array_join(F.transform("samples", lambda s: F.concat_ws(",", *[F.coalesce(s[k].cast("string"), F.lit("")) for k in records.SAMPLE_FIELDS[1:]])), ";"),
    }
    return hours.select("batch", F.concat_ws("\t", *[text.get(c, F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in HOUR_COLUMNS]).alias("value"))


def write_source_hour_text(hours: DataFrame, path: str) -> None:
    """The lines of source_hour_lines(), a folder for each batch."""
    source_hour_lines(hours).write.mode("overwrite").partitionBy("batch").text(path)


def shortest(c: str, kind: str) -> Column:
    """A number as text with six significant digits, undefined ones as nan."""
    if kind in ("double", "float"):
        return F.when(F.col(c).isNull(), "nan").otherwise(F.format_string("%.6g", F.col(c)))
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def profile_lines(p: DataFrame) -> DataFrame:
    """SNK2: profiles as tab-separated text, floating-point numbers with six significant digits; arrays by commas."""
    text = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",") if t.startswith("array") else shortest(c, t) for c, t in p.dtypes]
    return p.select(F.concat_ws("\t", *text).alias("value"))


def write_profiles(p: DataFrame, path: str, **facts: object) -> dict:
    """SNK2: Parquet with full digits, and <path>.meta, one row of rows, sources and the facts given; counted in the same pass by an observation."""
    seen = Observation("profiles")
    p.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum("nrec"), F.lit(0)).alias("records")).write.mode("overwrite").parquet(path)
    got = dict(seen.get) | facts
    spark = p.sparkSession
    one = spark.range(1).select(*[F.lit(v).alias(k) for k, v in sorted(got.items())])
    one.coalesce(1).write.mode("overwrite").json(path.rstrip("/") + ".meta")
    return got


def write_campaigns(campaigns: DataFrame, members: DataFrame, path: str) -> None:
    """SNK3: campaigns as JSON lines, membership (src, camp) as tab-separated text and as Parquet."""
    campaigns.write.mode("overwrite").json(f"{path}/campaigns")
    members.select("src", "camp").write.mode("overwrite").option("sep", "\t").csv(f"{path}/membership.tsv")
    members.select("src", "camp").write.mode("overwrite").parquet(f"{path}/membership")


def write_section(row: DataFrame, path: str, section: str) -> None:
    """SNK5: one section of a keyed set of results; other sections stay as they are."""
    row.withColumn("section", F.lit(section)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section").json(path)


def document_lines(document: DataFrame, name: str) -> DataFrame:
    """SNK6: a one-row document as a script: window.NAME = {...};"""
    return document.select(F.concat(F.lit(f"window.{name} = "), F.to_json(F.struct(*document.columns)), F.lit(";")).alias("value"))


def metrics(row: DataFrame) -> DataFrame:
    """SNK7: the columns of a one-row frame as (name, value), values as text, missing ones as --."""
    kinds = dict(row.dtypes)
    show = lambda c: F.coalesce(F.format_string("%.2f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("--"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), show(c).alias("value")) for c in row.columns])).alias("x")).select("x.name", "x.value")


def write_sorted(df: DataFrame, path: str, by: str, files: int) -> None:
    """SNK8: Parquet whose files ascend by a column, so that a range of it reads few of them; ties in the order of arrival."""
    df.withColumn("tw_seq", F.monotonically_increasing_id()).repartitionByRange(files, by, "tw_seq").sortWithinPartitions(by, "tw_seq").drop("tw_seq").write.mode("overwrite").parquet(path)


def embedding_lines(hours: DataFrame) -> DataFrame:
    """SNK9: (value) the six columns that the embedding reads: hour, src, ports, t0, t1, packets."""
    ports = F.array_join(F.transform(F.array_sort(F.map_entries("topports")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return hours.select(F.concat_ws("\t", F.col("h").cast("string"), F.col("src").cast("string"), ports, F.col("t0").cast("string"), F.col("t1").cast("string"), F.col("pk").cast("string")).alias("value"))
