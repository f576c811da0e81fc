"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped, with bases from prefix sums.

A store is a folder with, for each range of doc_ids, files ``NNNNNN-NNNNNN-<write>.ids``
(the ids of its documents one after the other, uint16 where the vocabulary allows,
else uint32, little-endian) and ``.idx`` (int64 doc_ids, then uint64 offsets, one
more than documents). Ranges ascend, so documents ascend over the whole store. The
manifest (one row per file) holds counts; the base of a file is the prefix sum of
the tokens before it.

Ranges are cut by sampled quantiles and hold about ``PER_RANGE`` documents; ties of
doc_id are ordered by hash, so a doc_id that very many rows repeat fills several
ranges, and a file ends at twice as many documents. Each file is written by one
task under a name of its own and listed only when complete, so a lost or repeated
task leaves a file that nobody reads.
"""

from __future__ import annotations

import re
import sys
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from .bpe import byte_symbols

PER_RANGE = 4000
#: Bytes that a worker's caches take, about.
CACHED = 200_000_000
MANIFEST = ("range", "part", "ids", "idx", "documents", "nulls", "tokens", "dtype")


def local(path: str) -> str | None:
    """A path that can be memory-mapped, for a URI on a mounted file system; None for others."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def store_bytes(path: str, parts: list) -> None:
    from pyarrow import fs

    if (own := local(path)) is not None:
        with open(own, "wb") as f:
            f.writelines(parts)
        return
    system, at = fs.FileSystem.from_uri(path)
    with system.open_output_stream(at) as f:
        for x in parts:
            f.write(x)


def mapped(path: str, dtype: str) -> np.ndarray:
    """The numbers of a file, memory-mapped where it is on a mounted file system, else read."""
    from pyarrow import fs

    if (own := local(path)) is not None:
        import os

        return np.memmap(own, dtype, "r") if os.path.getsize(own) else np.zeros(0, dtype)
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype)


class Halves(dict):
    """A cache of two halves: a full young half becomes the old one, and what is still in use comes back from there. What neither has is made by ``make``."""

    def __init__(self, most: int, make) -> None:  # noqa: ANN001
        self.most, self.held, self.make, self.old = most, 0, make, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        self[word] = got
        self.held += len(word) + 200
        return got

    def turn(self) -> None:
        if self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()


class Spaced(Exception):
    """White space after a space: the text must be cut with care."""


class Encoder:
    """Ids of whole texts from the tokenizers library, asked once for each different word.

    The file's pre-tokenizer keeps a space with the letters, digits or marks that
    follow it, so a space before anything but white space begins a piece. Texts
    are cut at spaces, which needs no table of letters, and words are cached as
    bytes and joined. A new word of the commonest shape (letters, marks, perhaps
    a newline and again letters, marks) is put together from its pieces, cached
    too; others are asked for whole. Texts that hold an added token go to the
    library whole, and those with white space after a space are cut only where it
    is safe, their words not cached.
    """

    #: Fixed value: letters below U+0250, the same in all versions of Unicode in use.
    LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
    MARKS = r"!-/:-@\[-`{-~"

    def __init__(self, file: str, end: int) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(file)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.dtype = "<u2" if max(len(vocab), end + 1) <= 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        self.symbols = str.maketrans({chr(k): x for k, x in byte_symbols().items()})
        self.model = self.lib.model
        self.shape = re.compile(f"([{self.LETTERS}]+)([{self.MARKS}]*)(?:\n([{self.LETTERS}]+)([{self.MARKS}]*))?").fullmatch
        self.apart = re.compile(r"(?<!\s) |(?<=\s) (?=\S)").split
        self.words, self.pieces = Halves(CACHED // 2, self.spaced), Halves(CACHED // 2, self.piece)
        self.end = self.packed([end])

    def packed(self, ids: list[int]) -> bytes:
        x = array(self.code, ids)
        if sys.byteorder == "big":
            x.byteswap()
        return x.tobytes()

    def whole(self, text: str) -> bytes:
        return self.packed(self.lib.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str) -> bytes:
        return self.packed([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.symbols))])

    def spaced(self, word: str) -> bytes:
        """Ids of a word with a space before it."""
        if not word or word[0].isspace():
            raise Spaced
        return self.word(" ", word)

    def word(self, before: str, word: str) -> bytes:
        m = self.shape(word)
        if m is None:
            return self.whole(before + word)
        a, b, x, y = m.groups()
        pieces = self.pieces
        got = pieces[before + a]
        if b:
            got += pieces[b]
        if x:
            got += pieces["\n"] + pieces[x]
            if y:
                got += pieces[y]
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, the end id appended."""
        self.words.turn()
        self.pieces.turn()
        get, out = self.words.__getitem__, []
        for t in texts:
            if any(a in t for a in self.added):
                out.append(self.whole(t) + self.end)
                continue
            first, *words = t.split(" ")
            try:
                rest = b"".join(map(get, words))
            except Spaced:
                first, *words = self.apart(t)
                rest = b"".join([self.whole(" " + w) if not w or w[0].isspace() or w[-1].isspace() else get(w) for w in words])
            out.append((self.word("", first) if first else b"") + rest + self.end)
        return out


def encoder(file: str, end: int) -> Encoder:
    cache = c.worker_cache("encoders")
    key = (zlib.crc32(file.encode()), end)
    if key not in cache:
        cache[key] = Encoder(file, end)
    return cache[key]


def write_store(docs: DataFrame, path: str, folder: str, end: int = 0, per_range: int = PER_RANGE) -> list[tuple]:
    """Write docs(doc_id, text) as a store; returns its manifest: (range, part, ids file, index file, documents, nulls, tokens, dtype), ascending.

    Null and empty texts are the end id alone. Rows that repeat a doc_id stand
    side by side; with different texts in an order by hash, so that they may lie
    in several ranges. Null doc_ids stand before all others; the manifest says
    how many a file begins with. An empty table gives an empty manifest.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    n, most = docs.groupBy("doc_id").count().agg(F.sum("count"), F.max("count")).first()
    if not n:
        return []
    file = spark.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, here, ids, sizes, held, rows, unknown = encoder(file.value, end), TaskContext.get().partitionId(), [], [], [], [], 0
        width = np.dtype(enc.dtype).itemsize

        def close():
            nonlocal unknown
            name = f"{folder}/{here:06d}-{len(rows):06d}-{uuid.uuid4().hex}"
            off = np.r_[0, np.cumsum(np.array(sizes, np.int64))].astype("<u8")
            store_bytes(name + ".ids", held)
            store_bytes(name + ".idx", [np.array(ids, "<i8").tobytes(), off.tobytes()])
            rows.append((here, len(rows), name + ".ids", name + ".idx", len(ids), unknown, int(off[-1]), enc.dtype))
            held.clear(), ids.clear(), sizes.clear()
            unknown = 0

        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                for d, x in zip(part.column("doc_id").to_pylist(), enc.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    unknown += d is None
                    held.append(x)
                    ids.append(d or 0)
                    sizes.append(len(x) // width)
                if len(ids) >= 2 * per_range:
                    close()
        if ids:
            close()
        kinds = {"part": pa.int32(), "range": pa.int32(), "ids": pa.string(), "idx": pa.string(), "dtype": pa.string()}
        yield pa.RecordBatch.from_pylist([dict(zip(MANIFEST, r, strict=True)) for r in rows], pa.schema([(k, kinds.get(k, pa.int64())) for k in MANIFEST]))

    tie = F.xxhash64("text")
    spread = docs.repartitionByRange(-(-n // per_range), "doc_id", *[tie] * (most > per_range)).sortWithinPartitions("doc_id", tie)
    done = c.cut(spread.mapInArrow(run, "range int, part int, ids string, idx string, documents long, nulls long, tokens long, dtype string"), "manifest")
    manifest = sorted(tuple(r) for r in done.collect())
    c.drop(done)
    return manifest


def read_store(spark: SparkSession, manifest: list[tuple], ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), with ``ids`` the ids too, from the files: start counts all ids before the document."""
    base, rows = 0, []
    for m in (dict(zip(MANIFEST, r, strict=True)) for r in manifest):
        rows.append((m["ids"], m["idx"], m["documents"], m["nulls"], m["dtype"], base))
        base += m["tokens"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for m in batch.to_pylist():
                flat, index = mapped(m["ids"], m["dtype"]), mapped(m["idx"], "<i8")
                n = m["documents"]
                doc, off = index[:n], index[n:].view("<u8").astype(np.int64)
                for lo in range(0, n, 1000):
                    hi = min(n, lo + 1000)
                    wide = [flat[off[i] : off[i + 1]].astype("<u4") for i in range(lo, hi)]
                    out = [pa.array(doc[lo:hi], mask=np.arange(lo, hi) < m["nulls"]), pa.array(off[lo:hi] + m["base"]), pa.array(np.diff(off[lo : hi + 1])), pa.array([zlib.crc32(x.tobytes()) for x in wide], pa.int64())]
                    if ids:
                        out.append(pa.array([x.astype(np.int64) for x in wide], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + ids])

    files = spark.createDataFrame(rows, "ids string, idx string, documents long, nulls long, dtype string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def store_folder(spark: SparkSession) -> str:
    """A new folder in the shared storage."""
    path = f"{c.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return path
