"""SpotSigs fingerprints with DataFrame and SQL functions alone: no Python runs on executors.

A signature is a common word (an anchor) and the chain of the next two content
words after it; of several anchors in a row the last counts. A text's fingerprint
is its set of signatures, as sorted 32-bit hashes. A text with words but no
anchor has its whole word sequence as its one signature; one without words none.
Likeness is the Jaccard share of two sets; two empty sets are alike (1).

``edits`` needs each document beside the next one in descending doc_id. There is
no global sort: rows go to ranges of doc_id cut by quantiles (found by a binary
search over a constant array, at most 2**17 ranges), a window runs in each range,
and the largest document of each range is also handed to the range above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Common words that serve as anchors. Fixed values.
ANCHORS = (
    "the a an of and to in is it that this was for on with as by at from be are or not have has had were "
    "der die das und von zu mit dem den des ein eine einer ist im für auf sich auch nicht als "
    "le la les de du et en un une est que qui dans pour par sur avec au aux ne "
    "el los las y una es por para con del se su al lo como"
).split()
MARK = "\u0001"
PER_RANGE, RANGES = 500, 1 << 17


def tokens(text: Column) -> Column:
    """Lower-cased content words in order, each with the anchors just before it in front, a mark after each."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "), F.lit(" "))
    marked = F.regexp_replace(F.regexp_replace(words, "^ +", " "), f"(?<= )({'|'.join(ANCHORS)}) ", f"$1{MARK}")
    return F.filter(F.split(marked, " "), lambda x: x != "")


def signatures(words: Column) -> Column:
    """The sorted distinct signatures of a column of tokens."""
    content = lambda x: F.substring_index(x, MARK, -1)
    chain = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.when(a.contains(MARK) & ~a.endswith(MARK), F.hash(F.substring_index(a, MARK, -2), F.coalesce(content(b), F.lit("")))))
    found = F.array_sort(F.array_distinct(F.array_compact(chain)))
    return F.when((F.size(found) == 0) & (F.size(words) > 0), F.array(F.hash(F.array_join(words, " ")))).otherwise(found)


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def shown(sigs: Column) -> Column:
    """A set as a string: its hashes in order, in hexadecimal."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))), ".")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, sigs). Null texts count as empty."""
    t = docs.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return t.select("doc_id", signatures(F.col("w")).alias("sigs"))


def range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below doc_id, by binary search; 0 for null."""
    if not cuts:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    held = F.array(*[F.lit(x) for x in cuts]) if len(cuts) < 64 else F.from_json(F.lit(str(cuts)), "array<bigint>")
    find = F.aggregate(steps, F.lit(0), lambda at, p: F.when((at + p <= len(cuts)) & (F.get(held, at + p - 1) <= doc_id), at + p).otherwise(at))
    return F.coalesce(find, F.lit(0))


def edits(docs: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by the first as many (or all) of the next document's; the next is
    the one with the next smaller doc_id, after the last the first. Null texts
    are empty. Rows that repeat a doc_id stand by the hash of their text, a null
    doc_id after all others. A table of one row is its own next. An empty table
    gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    k = min(RANGES, max(1, -(-n // per_range)))
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / k for i in range(1, k)], 0.2 / k)}) if k > 1 else []
    tops = docs.select("doc_id", range_of(F.col("doc_id"), cuts).alias("range")).groupBy("range").agg(F.max("doc_id").alias("top")).collect()
    tops = sorted((r["range"], r.top) for r in tops)
    above = [(t, tops[(i + 1) % len(tops)][0]) for i, (_, t) in enumerate(tops)]
    guard = docs.sparkSession.createDataFrame(above, "top long, above int")
    rows = docs.withColumn("range", range_of(F.col("doc_id"), cuts)).join(F.broadcast(guard), F.col("doc_id").eqNullSafe(F.col("top")), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guard"))
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("above").isNotNull(), F.array(own, F.struct(F.col("above").alias("range"), F.lit(True).alias("guard")))).otherwise(F.array(own))).alias("at")).select("doc_id", "text", "at.*")
    rows = rows.withColumn("h", F.xxhash64("text"))
    line = W.partitionBy("range").orderBy("guard", F.col("doc_id").desc_nulls_last(), "h")
    rows = rows.withColumn("next", F.lead("text").over(line))
    size = F.char_length("text")
    rows = rows.select("range", "guard", "doc_id", "h", "text", size.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), size - F.floor(size / 2).cast("int")), F.substring(F.coalesce("next", F.lit("")), F.lit(1), F.floor(size / 2).cast("int"))).alias("edited"))
    rows = rows.select("range", "guard", "doc_id", "h", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), tokens(F.col("text")).alias("w"), tokens(F.col("edited")).alias("we"))
    rows = rows.select("range", "guard", "doc_id", "h", "n_chars", "edited_sha256", signatures(F.col("w")).alias("s"), signatures(F.col("we")).alias("se"))
    rows = rows.withColumn("sn", F.lead("s").over(line)).filter(~F.col("guard"))
    return rows.select("doc_id", "n_chars", "edited_sha256", shown(F.col("s")).alias("fingerprint"), shown(F.col("se")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("se")).alias("near_edited"), likeness(F.col("s"), F.col("sn")).alias("near_next"))


def search(queries: DataFrame, all_: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """Pairs (query, doc_id, likeness) of two sets of fingerprints(doc_id, sigs) with likeness of num / den at least, query <> doc_id.

    Sets are partitioned by length so that alike sets lie in the same partition
    or the next; there, only sets that share one of their rarest
    size - ceil(size * num / den) + 1 signatures are compared. Both prunings are
    exact. ``queries`` is the stated query set; empty sets match nothing.
    """
    df = all_.select(F.explode("sigs").alias("x")).groupBy("x").agg(F.count("*").alias("df"))

    def prefixes(t: DataFrame, spread: bool) -> DataFrame:
        each = t.select("doc_id", F.size("sigs").alias("n"), F.explode("sigs").alias("x")).join(df, "x", "left")
        rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.coalesce("df", F.lit(0)), "x"))
        kept = each.withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1)
        part = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
        return kept.select("doc_id", "n", "x", F.explode(F.array(part - 1, part, part + 1) if spread else F.array(part)).alias("part"))

    q, a = prefixes(queries, True), prefixes(all_, False)
    alike = (F.col("q.n") * den >= F.col("a.n") * num) & (F.col("a.n") * den >= F.col("q.n") * num)
    pairs = q.alias("q").join(a.alias("a"), (F.col("q.x") == F.col("a.x")) & (F.col("q.part") == F.col("a.part")) & (F.col("q.doc_id") != F.col("a.doc_id")) & alike).select(F.col("q.doc_id").alias("query"), F.col("a.doc_id").alias("doc_id")).distinct()
    full = pairs.join(queries.select(F.col("doc_id").alias("query"), F.col("sigs").alias("sq")), "query").join(all_.select("doc_id", "sigs"), "doc_id")
    return full.select("query", "doc_id", likeness(F.col("sq"), F.col("sigs")).alias("likeness")).filter(F.col("likeness") * den >= num)
