"""Scalar functions of the flow domain as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M31 = 2147483647


def clean(s: Column, n: int) -> Column:
    """Null as "", tabs and newlines as spaces, semicolons as commas, at most n characters."""
    return F.substring(F.translate(F.coalesce(s, F.lit("")), "\t\n;", "  ,"), 1, n)


def iso_epoch(s: Column) -> Column:
    """Whole seconds of an ISO-8601 time, fractions of any length dropped; 0 where it doesn't parse."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(s, r"\.\d+", ""))), F.lit(0))


def ip_int(s: Column) -> Column:
    p = F.split(s, r"\.")
    return sum(F.get(p, i).try_cast("bigint") * (1 << 8 * (3 - i)) for i in range(4))


def ip_text(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, 8 * i).bitwiseAND(F.lit(255)).cast("string") for i in (3, 2, 1, 0)])


def initial_ttl(t: Column) -> Column:
    return F.when(t <= 32, 32).when(t <= 64, 64).when(t <= 128, 128).otherwise(255)


def activity_bin(n: Column) -> Column:
    """0 to 6 for up to 1, 3, 7, 15, 31, 63 and more active hours."""
    out = F.when(n <= 1, 0)
    for k, most in enumerate((3, 7, 15, 31, 63), 1):
        out = out.when(n <= most, k)
    return out.otherwise(6)


def protocol(mask: Column) -> Column:
    return F.when(mask == 1, "tcp").when(mask == 2, "udp").when(mask == 4, "icmp").otherwise(F.concat(F.lit("mix"), mask.cast("string")))


def deltas(a: Column) -> Column:
    """Differences of neighbours in an array."""
    return F.zip_with(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda y, x: y - x)


def share(a: Column, test) -> Column:
    return F.try_divide(F.size(F.filter(a, test)), F.size(a))


def ipid_class(a: Column) -> Column:
    """SC9: how the IP-ids of a source's samples, in time order, are made. One sample that is neither 54321 nor 0 is ip1; na is for none."""
    step = F.transform(deltas(a), lambda d: F.pmod(d, F.lit(65536)))
    return (
        F.when(F.size(a) < 1, "na").when(F.forall(a, lambda x: x == 54321), "ip54321").when(F.forall(a, lambda x: x == 0), "ip0").when(F.size(a) < 2, "ip1")
        .when(F.size(F.array_distinct(a)) == 1, "ipconst").when(share(step, lambda d: (d >= 1) & (d <= 2048)) >= 0.8, "ipinc").otherwise("iprand")
    )


def port_policy(a: Column) -> Column:
    """How the source ports of a source's samples, in time order, are chosen."""
    return (
        F.when(F.size(a) < 2, "sp1").when(F.size(F.array_distinct(a)) == 1, "spfix").when(F.array_max(a) - F.array_min(a) < 64, "spnarrow")
        .when(share(deltas(a), lambda d: (d >= 1) & (d <= 64)) >= 0.8, "spinc").otherwise("sprand")
    )


def normal_tail(z: Column) -> Column:
    """P(Z > z) by a polynomial approximation of erfc, relative error about 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    p = F.lit(0.0)
    for k in reversed(ERFC):
        p = p * t + k
    upper = t * F.exp(-x * x + p) / 2
    return F.when(z >= 0, upper).otherwise(1 - upper)


#: Coefficients of the approximation of erfc. Fixed values.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def draw(x: Column, n: Column | int) -> Column:
    """A reproducible draw from 0..n-1 for a non-negative integer, the same in any SQL dialect."""
    for _ in range(2):
        x = F.pmod(x, F.lit(M31))
        x = F.pmod(x * x + x * 48271 + 12345, F.lit(M31))
    return F.pmod(x, F.lit(n) if isinstance(n, int) else n)


def let(x: Column, f) -> Column:  # noqa: ANN001
    """f of x, x evaluated once: for values that an expression uses several times."""
    return F.get(F.transform(F.array(x), f), 0)


def bound_draw(x: Column, n: Column | int) -> Column:
    """draw() for an x that is itself a long expression: the plan grows by a constant, not by its copies."""
    step = lambda v: F.pmod(v * v + v * 48271 + 12345, F.lit(M31))
    return F.pmod(let(let(F.pmod(x, F.lit(M31)), step), step), F.lit(n) if isinstance(n, int) else n)


def draw_sql(x: str, n: str) -> str:
    for _ in range(2):
        x = f"(({x}) % {M31})"
        x = f"(({x} * {x} + {x} * 48271 + 12345) % {M31})"
    return f"({x} % ({n}))"


def payload_class(hexed: Column, port: Column) -> Column:
    """SC21: what the first payload bytes, in hexadecimal, look like; the first test that holds decides. 64 31 3a is "d1:", 64 32 3a is "d2:"."""
    x = F.lower(F.coalesce(hexed, F.lit("")))
    b = F.when(x.rlike("^[0-9a-f]*$"), F.substring(x, F.lit(1), (F.length(x) / 2).cast("int") * 2)).otherwise("")
    return (
        F.when(port == 53, "dns").when(x == "", "empty").when(b.rlike("^643[12]3a"), "bittorrent-dht").when(b.rlike("^[0-4]1(00|01|02)"), "utp").when(b.rlike("^e[45]"), "kad")
        .when(F.substring(b, 9, 8) == "2112a442", "stun").when(b.rlike("^(4f505449|52454749|494e5649|5349502f)"), "sip").when(b.startswith("4d2d5345"), "ssdp")
        .when(b.rlike("^([2-6][0-9a-f]|7[0-9a-e]){4,}$"), "ascii-other").otherwise("binary-other")
    )
