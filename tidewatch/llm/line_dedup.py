"""Line dedup by a deletion-neighbourhood join.

A line is its words with A-Z in lower case. A line of ``MIN_WORDS`` words or more
goes if the same line stands earlier (by doc_id, then line number); one of
``NEAR_WORDS`` or more also if an earlier line is within an edit distance of one
word (a word put in, taken out or replaced). Shorter lines stay.

How: copies meet in a partial aggregation, so one row per different line is left.
Two lines within the bound share their first or their last half of words, so only
lines that share such a half with another line emit their variants (an exact
filter). A variant is the line without its k-th word: equal variants without the
same k-th word are one replacement apart, a variant equal to a whole line is one
insertion apart. Each variant bucket keeps just its earliest lines (partial
minima), so a bucket of m lines gives m rows and no pairs. Edit distance is then
verified on the word sequences of each dropped line and its witness.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

MIN_WORDS, NEAR_WORDS = 3, 8
#: Bytes of a list of documents' lines that are broadcast at most, a document and a line counted as below; larger lists are joined by a shuffle.
LISTED, PER_DOC, PER_LINE = 64_000_000, 120, 4


class Lines:
    """The lines with words of a chunk of texts, and hashes of any run of their words."""

    def __init__(self, off: np.ndarray, data: np.ndarray) -> None:
        starts, ends, first = c.word_spans(off, data)
        self.h = c.span_hashes(data, starts, ends, c.byte_values(lower=True))
        n = len(self.h)
        self.doc_of = np.repeat(np.arange(len(off) - 1), np.diff(first))
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, starts)
        new = np.ones(n, bool)
        new[1:] = (line[1:] != line[:-1]) | (self.doc_of[1:] != self.doc_of[:-1])
        self.a = np.flatnonzero(new)
        self.b = np.r_[self.a[1:], n] if n else self.a
        self.doc = self.doc_of[self.a]
        self.no = line[self.a] - np.searchsorted(breaks, off[:-1])[self.doc]
        self.p, self.q = c._powers(n + 2)
        self.sums = np.zeros(n + 1, c.U)
        np.cumsum(self.h * self.p[:n], out=self.sums[1:])

    def run(self, lo: np.ndarray, hi: np.ndarray, by: np.ndarray | int = 0) -> np.ndarray:
        """Hash of words lo:hi as if they began ``by`` words after their line's first; unmixed, so runs add up."""
        return (self.sums[hi] - self.sums[lo]) * self.q[lo] * self.p[by]

    def salted(self, h: np.ndarray, kind: int, n: np.ndarray) -> np.ndarray:
        return c.fmix(h + c.U(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + n.astype(c.U) * c.U(0xD6E8FEB86659FD93))

    def whole(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.salted(self.run(a, b), 1, b - a)


def scan(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """docs(doc_id, h, text) -> (doc_id, h, no, line, n_words, halves) for each line of enough words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, _, off, data in c.chunks(batch.column("text")):
                x = Lines(off, data)
                ok = x.b - x.a >= min_words
                a, b, doc, no = x.a[ok], x.b[ok], x.doc[ok], x.no[ok]
                n = b - a
                keys = np.zeros((len(a), 4), c.U)
                for k, m in enumerate((n // 2, (n - 1) // 2)):
                    keys[:, 2 * k] = x.salted(x.run(a, a + m), 2, m)
                    keys[:, 2 * k + 1] = x.salted(x.run(b - m, b), 3, m)
                width = np.where(n < near_words, 0, np.where(n % 2, 2, 4))
                flat = keys[np.arange(4) < width[:, None]].view(np.int64)
                halves = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(width)], pa.int32()), pa.array(flat))
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(no, pa.int32()), pa.array(x.whole(a, b).view(np.int64)), pa.array(n, pa.int32()), halves],
                    ["doc_id", "h", "no", "line", "n_words", "halves"],
                )

    return docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, no int, line long, n_words int, halves array<long>")


def variants(docs: DataFrame) -> DataFrame:
    """docs(text, lines: array of (no, line, doc_id, h)) -> (key, role, line, words): role 0 lacks a word at a known place, 1 is whole, 2 lacks any one word; words, the line's word hashes, stand with role 1 alone."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            wanted = batch.column("lines").to_pylist()
            for lo, _, off, data in c.chunks(batch.column("text"), c.CHUNK // 2):
                x = Lines(off, data)
                pick = [k for k, (d, no) in enumerate(zip(x.doc.tolist(), x.no.tolist(), strict=True)) if no in wanted[lo + d]]
                a, b = x.a[pick], x.b[pick]
                n = b - a
                line = x.whole(a, b)
                rep = np.repeat(np.arange(len(a)), n)
                at = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                ra, rb = a[rep], b[rep]
                rest = x.run(ra, ra + at) + (x.sums[rb] - x.sums[ra + at + 1]) * x.q[ra + 1]
                sub = x.salted(rest, 4, at * 65536 + n[rep])
                out = x.salted(rest, 1, n[rep] - 1)
                keys = np.concatenate([sub, line, out]).view(np.int64)
                role = np.repeat(np.array([0, 1, 2], np.int8), [len(sub), len(line), len(out)])
                words = [None] * len(sub) + [x.h[i:j].tobytes() for i, j in zip(a, b, strict=True)] + [None] * len(out)
                lines = np.concatenate([line[rep], line, line[rep]]).view(np.int64)
                for s in range(0, len(keys), 1 << 16):
                    e = s + (1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[s:e]), pa.array(role[s:e]), pa.array(lines[s:e]), pa.array(words[s:e], pa.binary())], ["key", "role", "line", "words"])

    return docs.select("text", "lines").mapInArrow(run, "key long, role byte, line long, words binary")


def within_one(pairs: DataFrame) -> DataFrame:
    """The lines of pairs(line, x, y) whose word sequences x and y are at most one edit apart."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), c.U), np.frombuffer(y.as_buffer(), c.U)
                if abs(len(x) - len(y)) > 1:
                    keep.append(False)
                    continue
                m = min(len(x), len(y))
                front = np.flatnonzero(x[:m] != y[:m])
                back = np.flatnonzero(x[len(x) - m :][::-1] != y[len(y) - m :][::-1])
                same = (front[0] if len(front) else m) + (back[0] if len(back) else m)
                keep.append(bool(same >= max(len(x), len(y)) - 1))
            yield pa.RecordBatch.from_arrays([batch.column("line")], ["line"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("line", "x", "y").mapInArrow(run, "line long")


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs(doc_id, h, text) -> (doc_id, h, n_lines, gone: numbers of the lines that go), for documents that lose some."""
    seen = c.cut(scan(docs, min_words, near_words), "lines")
    order = F.struct("doc_id", "h", "no")
    uniq = c.cut(seen.groupBy("line").agg(F.min(order).alias("o"), F.first("halves").alias("halves")), "different")
    half = uniq.select("line", F.explode("halves").alias("key"))
    many = half.groupBy("key").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).filter("lo <> hi").select("key")
    near = half.join(many, "key", "left_semi").select("line").distinct()
    near = c.cut(uniq.select("line", "o").join(near, "line", "left_semi"), "near")
    wanted = near.groupBy("o.doc_id", "o.h").agg(F.collect_set("o.no").alias("lines"))
    wanted = F.broadcast(wanted) if near.count() * (PER_DOC + PER_LINE) <= LISTED else wanted
    texts = docs.alias("d").join(wanted.alias("w"), (F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))) & (F.col("d.h") == F.col("w.h"))).select("d.text", "w.lines")
    var = c.cut(variants(texts), "variants")
    rows = var.select("key", "role", "line").join(near, "line").select("key", "role", "line", "o")
    least = lambda r: F.min(F.when(F.col("role") == r, F.struct("o", "line")))
    first = rows.groupBy("key").agg(least(0).alias("m0"), least(1).alias("m1"), least(2).alias("m2"), F.min("line").alias("lo"), F.max("line").alias("hi")).filter("lo <> hi").drop("lo", "hi")
    witness = F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1"))
    found = rows.join(first, "key").withColumn("by", witness).filter("by.o < o").groupBy("line").agg(F.min("by").alias("by"))
    words = var.filter("role = 1").select("line", "words").dropDuplicates(["line"])
    pairs = found.select("line", F.col("by.line").alias("other")).join(words.withColumnRenamed("words", "x"), "line").join(words.select(F.col("line").alias("other"), F.col("words").alias("y")), "other")
    near_gone = within_one(pairs).distinct().withColumn("near", F.lit(True))
    verdict = c.cut(uniq.select("line", "o").join(near_gone, "line", "left").select("line", "o", F.coalesce("near", F.lit(False)).alias("near")), "verdicts")
    gone = seen.select("doc_id", "h", "no", "line").join(verdict, "line").filter(F.col("near") | (F.struct("doc_id", "h", "no") > F.col("o")))
    out = c.cut(gone.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("no")).alias("gone")), "gone")
    for t in (seen, uniq, near, var, verdict):
        c.drop(t)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, names: tuple[str, str] = ("n_lines", "gone")) -> DataFrame:
    """docs with any columns, doc_id and text among them -> the same rows with text without the lines that go, and n_lines, gone.

    ``names`` are those of the two new columns; columns of docs so named are replaced.

    Lines end at newlines. Nulls: a null text stays null and has no lines; a null
    doc_id comes before all others. Rows that repeat doc_id and text are one
    document's and get the same result. Empty texts and tables pass through.
    """
    gone = dropped_lines(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), min_words, near_words)
    size = gone.agg(F.count("*") * PER_DOC + F.coalesce(F.sum(F.size("gone")), F.lit(0)) * PER_LINE).first()[0]
    few = F.broadcast(gone) if size <= LISTED else gone
    own = [f"c{i}" for i in range(len(docs.columns))]  # names of our own while two more columns are there
    name = dict(zip([x.lower() for x in docs.columns], own, strict=True))
    doc_id, text = F.col(name["doc_id"]), F.col(name["text"])
    both = docs.toDF(*own).join(few.select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"), "gone"), doc_id.eqNullSafe(F.col("g_id")) & (F.xxhash64(text) == F.col("g_h")), "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    left = F.when(F.size(gone) > 0, F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")).otherwise(text)
    kept = [left.alias(x) if x.lower() == "text" else F.col(k).alias(x) for x, k in zip(docs.columns, own, strict=True) if x.lower() not in names]
    return both.select(*kept, F.coalesce(F.regexp_count(text, F.lit("\n")) + 1, F.lit(0)).alias(names[0]), gone.alias(names[1]))
