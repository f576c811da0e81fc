"""Activity bitmaps: which hours of a window a source was active in, as one 24-bit word a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_words(h: Column, days: int) -> Column:
    """Aggregate: an array of days words, bit k of word d for hour 24 d + k. A bit_or, so partial and mergeable."""
    bit = F.call_function("shiftleft", F.lit(1), F.pmod(h, F.lit(24)).cast("int"))
    return F.array(*[F.coalesce(F.bit_or(F.when((h >= 24 * d) & (h < 24 * d + 24), bit)), F.lit(0)) for d in range(days)])


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def rotate_days(words: Column, by: Column) -> Column:
    """The words turned by whole days."""
    n = F.size(words)
    s = F.pmod(by, n).cast("int")
    return F.concat(F.slice(words, n - s + 1, s), F.slice(words, F.lit(1), n - s))


def rotate_hours(words: Column, by: Column) -> Column:
    """The words turned by hours: whole days first, then bits carried from a day to the next."""
    by = F.pmod(by, F.size(words) * 24).cast("int")
    days, r = rotate_days(words, F.floor(by / 24)), F.pmod(by, F.lit(24)).cast("int")
    before = rotate_days(words, F.floor(by / 24) + 1)
    up = lambda w: F.call_function("shiftleft", w, r).bitwiseAND(F.lit((1 << 24) - 1))
    return F.zip_with(days, before, lambda w, v: up(w).bitwiseOR(F.call_function("shiftright", v, F.lit(24) - r)).cast("int"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared active hours over all active hours; 0 where neither was active."""

    def bits(f) -> Column:  # noqa: ANN001
        one = lambda x, y: F.bit_count(f(x, y))
        # Spark compiles the sum of a week's words as it stands here; a fold it interprets, at many times the cost.
        week = sum((one(F.get(a, k), F.get(b, k)) for k in range(1, 7)), one(F.get(a, 0), F.get(b, 0)))
        return F.when((F.size(a) == 7) & (F.size(b) == 7), week).otherwise(F.aggregate(F.zip_with(a, b, one), F.lit(0), lambda n, x: n + x))

    return F.coalesce(F.try_divide(bits(Column.bitwiseAND), bits(Column.bitwiseOR)), F.lit(0.0))


def hours(words: Column) -> Column:
    """The active hours, ascending."""
    per = F.transform(words, lambda w, d: F.filter(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: F.when(F.call_function("shiftright", w, k).bitwiseAND(F.lit(1)) == 1, d * 24 + k)), lambda x: x.isNotNull()))
    return F.flatten(per)


def first_hours(words: Column, n: int) -> Column:
    """The words with all hours from n on cleared."""
    return F.transform(words, lambda w, d: F.when(d * 24 + 24 <= n, w).when(d * 24 >= n, F.lit(0)).otherwise(w.bitwiseAND(F.lit((1 << n % 24) - 1))))
