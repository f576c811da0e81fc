"""What several operators share: shared storage, text buffers, hashing, components.

Scale notes: everything that runs on an executor works on one Arrow batch at a
time and cuts it into chunks of about ``CHUNK`` bytes of text, so memory follows
the chunk (or the longest document), not the partition.
"""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 19
#: Rows of an Arrow batch: whole texts travel in them, off the heap.
BATCH_ROWS = 500
U = np.uint64
#: Bytes 0x20 and 0x09 to 0x0D separate words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- shared storage
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 * CHUNK))
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tidewatch-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return str(fs.makeQualified(hadoop).toString())


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Within it Arrow batches hold fewer rows, for rows that are large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    global BATCH_ROWS
    before, BATCH_ROWS = BATCH_ROWS, rows
    try:
        yield
    finally:
        BATCH_ROWS = before
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a frame made by cut()."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        if "/tidewatch-" in f:
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in either case: name, with underscores before it as needed."""
    have = {x.lower() for x in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, across tasks."""
    return sys.modules.setdefault("_tidewatch_worker", types.ModuleType("_tidewatch_worker")).__dict__.setdefault(name, {})


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns asked for; other columns of the table, clashing names included, never travel along."""
    shared_dir(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


# ---------------------------------------------------------------- text as bytes
def chunks(texts, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of an Arrow string array (nulls are empty) as (first row, last row + 1, offsets, bytes)."""
    import pyarrow as pa

    settle()
    a = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    a = a.cast(pa.large_string()).fill_null("")
    if not len(a):
        return
    _, off, data = a.buffers()
    off = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi, off[lo : hi + 1] - off[lo], data[off[lo] : off[hi]]
        lo = hi
    trim()


def settle() -> None:
    """Let large arrays go straight back to the system when freed: a worker lives beside the executor's heap, and on after its task."""
    import ctypes

    import pyarrow as pa

    libc = worker_cache("libc")
    if "trim" not in libc:
        own = ctypes.CDLL(None)
        if hasattr(own, "mallopt"):
            own.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        libc["trim"] = getattr(own, "malloc_trim", lambda _: 0)
        pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    worker_cache("libc")["trim"](0)


def fmix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, in place."""
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    cache = worker_cache("powers")
    if cache.get("n", 0) < n:
        n = max(n, CHUNK + (CHUNK >> 2))
        p = 0x9E3779B97F4A7C15
        for name, base in (("p", p), ("q", pow(p, -1, 1 << 64))):
            a = np.full(n, base, U)
            a[0] = 1
            cache[name] = np.cumprod(a, dtype=U)
        cache["n"] = n
    return cache["p"], cache["q"]


def byte_values(lower: bool, seed: int = 7) -> np.ndarray:
    """A random 64-bit value for each byte; with lower, A-Z share those of a-z."""
    t = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
    if lower:
        t[65:91] = t[97:123]
    return t


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, in one pass over the bytes."""
    p, q = _powers(len(data) + 1)
    c = np.empty(len(data) + 1, U)
    c[0] = 0
    v = values[data]
    v *= p[: len(data)]
    np.cumsum(v, out=c[1:])
    h = c[ends] - c[starts]
    h *= q[starts]
    return fmix(h)


#: Bytes outside words, and bytes outside runs of ASCII letters, digits and everything beyond ASCII.
SPACE = np.zeros(256, bool)
SPACE[list(SPACES)] = True
MARK = np.ones(256, bool)
MARK[48:58] = MARK[65:91] = MARK[97:123] = MARK[128:] = False


def word_spans(off: np.ndarray, data: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words of all documents of a chunk; words first[i]:first[i+1] are those of document i."""
    inside = ~outside[data]
    begins, stops = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begins[edge] |= inside[edge]
        stops[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, off)


# ---------------------------------------------------------------- components
#: Edges up to which their minima are broadcast (two numbers a node, under 64 MB).
FEW = 1_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node that each node of an edge list reaches, by alternating large-star and small-star.

    Large-star hangs a node's larger neighbours on its smallest neighbour (itself
    included); small-star does so with its smaller ones. Both are a partial
    minimum and a join back, so a centre with a third of all edges is never
    gathered in one task (AQE splits the join). Up to ``FEW`` edges, counted, the
    minima are broadcast instead. It ends when a round changes nothing. No edges give no rows; loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    before, n = None, e.count()
    while n:
        near = F.broadcast if n <= FEW else lambda df: df
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(near(m), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(m), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        new = cut(small.filter("u <> v").distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        drop(e)
        e = new
        if state == before:
            break
        before, n = state, state[0]
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


# ---------------------------------------------------------------- learned models
def held_out(mod: int, rest: int):
    """Whether crc32 of doc_id as text leaves this remainder: such rows are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, most: int, longest: int, long: int = 100) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most ``most`` documents of each label from the rows learned from, smallest hash of doc_id first.

    Those of up to ``longest`` characters are drawn first; of longer ones, whole
    too, as many as there is room for, at most ``long`` of a label. Of rows that
    repeat a doc_id one is drawn, the text of smallest hash.
    """
    rows = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out(mod, rest)).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit(5), "doc_id")
    size = docs.select("doc_id", F.char_length("text").alias("n")).filter("n is not null").groupBy("doc_id").agg((F.max("n") > longest).alias("far"))
    known, pick = rows.join(size, "doc_id"), None
    for y in (1, 0):
        near = known.filter((F.col("y") == y) & ~F.col("far")).orderBy(order, "doc_id").limit(most)
        far = known.filter((F.col("y") == y) & F.col("far")).orderBy(order, "doc_id").limit(long)
        both = near.union(far).orderBy("far", order, "doc_id").limit(most)
        pick = both if pick is None else pick.union(both)
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(pick.select("doc_id", "y")), "doc_id")
    got = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    got.sort(key=lambda r: r.doc_id)
    return [r.text for r in got], np.array([r.y for r in got], np.int64)


def ngram_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the byte n-grams of each span, lower-cased in A-Z, with its edges marked by a zero byte."""
    size = ends - starts + 2
    at = np.repeat(np.cumsum(size) - size, size)
    owner = np.repeat(np.arange(len(starts)), size)
    pos = np.arange(len(owner)) - at
    src = starts[owner] + pos - 1
    edge = (pos == 0) | (pos == size[owner] - 1)
    b = np.where(edge, 0, data[np.clip(src, 0, max(0, len(data) - 1))] if len(data) else 0).astype(np.uint8)
    b[(b >= 65) & (b <= 90)] += 32
    code = b.astype(c_u := np.uint64)
    for k in range(1, n):
        code[:-k] = code[:-k] | (b[k:].astype(c_u) << c_u(8 * k))
    ok = pos <= np.maximum(size[owner] - n, 0)
    fmix(code)
    return owner[ok], (code[ok] >> c_u(64 - bits)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
