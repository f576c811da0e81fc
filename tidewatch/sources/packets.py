"""Header fields of sampled frames: base64 text in, one row of fields out, with JVM expressions only.

A frame is turned into hexadecimal text once; a field is a slice of it, so variable
offsets (VLAN tag, IP options) are plain arithmetic on columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of TCP options by kind where the payload isn't shown. Fixed values.
PLAIN_OPTIONS = {4: "S", 8: "T"}
FIELDS = ("proto", "dst", "sport", "ttl", "ipid", "df", "win", "optsig", "seqrel", "plen", "phead")


def unsigned(hexed: Column, at: Column | int, size: int) -> Column:
    """The big-endian number of ``size`` bytes that starts at byte ``at``; null beyond the end."""
    part = F.substring(hexed, (F.lit(at) if isinstance(at, int) else at) * 2 + 1, F.lit(size * 2))
    return F.when(F.length(part) == size * 2, F.conv(part, 16, 10).cast("bigint"))


def option_signature(hexed: Column) -> Column:
    """TCP options as text such as M1460.S.T.N.W7, up to the end mark or the first malformed one.

    A fold over the byte positions that skips to the position of the next option;
    a position of 99 ends it (options take 40 bytes at most).
    """
    size = (F.length(hexed) / 2).cast("int")

    def step(state: Column, i: Column) -> Column:
        kind, length = unsigned(hexed, i, 1), unsigned(hexed, i + 1, 1)
        whole = F.coalesce((length >= 2) & (i + length <= size), F.lit(False))
        word = F.when((kind == 2) & (length == 4), F.concat(F.lit("M"), unsigned(hexed, i + 2, 2).cast("string"))).when((kind == 3) & (length == 3), F.concat(F.lit("W"), unsigned(hexed, i + 2, 1).cast("string")))
        for k, name in PLAIN_OPTIONS.items():
            word = word.when(kind == k, name)
        word = word.otherwise(F.concat(F.lit("K"), kind.cast("string")))
        said = F.when(kind == 0, F.array(F.lit("E"))).when(kind == 1, F.array(F.lit("N"))).when(whole, F.array(word)).otherwise(F.array().cast("array<string>"))
        then = F.when(kind == 1, i + 1).when((kind != 0) & whole, i + length.cast("int")).otherwise(99)
        return F.when(i != state["at"], state).otherwise(F.struct(then.cast("int").alias("at"), F.concat(state["out"], said).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    where = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(where, start, step, lambda s: F.array_join(s["out"], "."))


def parse_frames(df: DataFrame, column: str) -> DataFrame:
    """df with the fields of each frame; every field is null for a frame that isn't whole IPv4 or doesn't decode.

    Fields that the transport has not are null (win is the type of an ICMP message).
    A header cut short leaves the transport's fields null and keeps those of IP.
    """
    h = F.col("tw_hex")
    rows = df.withColumn("tw_hex", F.hex(F.expr(f"try_to_binary(`{column}`, 'base64')"))).withColumn("tw_size", F.length(h) / 2)
    tagged = (unsigned(h, 12, 2) == 0x8100) & (F.col("tw_size") >= 18)
    rows = rows.withColumn("tw_ip", F.when(tagged, 18).otherwise(14))
    ip = F.col("tw_ip")
    rows = rows.withColumn("tw_head", (unsigned(h, ip, 1) % 16) * 4)
    fine = (F.col("tw_size") >= 34) & (unsigned(h, ip - 2, 2) == 0x0800) & (F.col("tw_size") >= ip + 20) & (F.floor(unsigned(h, ip, 1) / 16) == 4) & (F.col("tw_head") >= 20) & (F.col("tw_size") >= ip + F.col("tw_head"))
    rows = rows.withColumn("tw_ok", F.coalesce(fine, F.lit(False))).withColumn("tw_l4", (ip + F.col("tw_head")).cast("int"))
    l4, left = F.col("tw_l4"), F.col("tw_size") - F.col("tw_l4")
    proto, dst = unsigned(h, ip + 9, 1), unsigned(h, ip + 16, 4)
    tcp, udp, icmp = (proto == 6) & (left >= 20), (proto == 17) & (left >= 8), (proto == 1) & (left >= 1)
    seq, data = unsigned(h, l4 + 4, 4), F.floor(unsigned(h, l4 + 12, 1) / 16) * 4
    options = F.substring(h, (l4 + 20) * 2 + 1, ((data - 20) * 2).cast("int"))
    value = {
        "proto": proto, "dst": dst, "ttl": unsigned(h, ip + 8, 1), "ipid": unsigned(h, ip + 4, 2), "df": F.floor(unsigned(h, ip + 6, 1) / 64) % 2,
        "sport": F.when(tcp | udp, unsigned(h, l4, 2)), "win": F.when(tcp, unsigned(h, l4 + 14, 2)).when(icmp, unsigned(h, l4, 1)),
        "optsig": F.when(tcp & (data > 20) & (left >= data), option_signature(options)), "seqrel": F.when(tcp, F.when(seq == dst, "D").when(seq == 0, "Z").otherwise("")),
        "plen": F.when(udp, left.cast("bigint") - 8), "phead": F.when(udp, F.lower(F.substring(h, (l4 + 8) * 2 + 1, F.lit(16)))),
    }
    rows = rows.select("*", *[F.when(F.col("tw_ok"), value[k]).alias(k) for k in FIELDS])
    return rows.drop("tw_hex", "tw_size", "tw_ip", "tw_head", "tw_ok", "tw_l4")
