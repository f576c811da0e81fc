"""BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent symbols that occurs inside no vocabulary token can never end
up inside one merged token, so every such pair is a certain cut. A word is cut
there, the fragments are encoded on their own and their ids concatenated: equal
to encoding the whole word, with far fewer distinct pieces to merge and cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: Entries of each of a worker's caches, which start anew beyond that.
CACHED = 300_000
#: Symbols of a fragment from which pairs are kept in a heap.
LONG = 100


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is visible, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file with byte-level symbols and an end-of-word suffix."""

    def __init__(self, file: str) -> None:
        import regex
        from tokenizers import Regex, normalizers, pre_tokenizers

        spec = json.loads(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in (self.vocab | self.special).items()}
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.cutter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.symbols = {chr(k): s for k, s in byte_symbols().items()}
        self.table = str.maketrans(self.symbols)
        inside: set[str] = set()
        for token in self.vocab:
            s = self.split(token)
            inside.update(x + y for x, y in zip(s, s[1:], strict=False))
        self.inside = inside
        self.cached = CACHED
        self.cache: dict[str, tuple[str, str, int]] = {}
        self.pieces: dict[tuple, tuple[int, ...]] = {}

    def split(self, token: str) -> list[str]:
        """A vocabulary token as the symbols it grew from; the last one holds the end of a word."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def fragments(self, symbols: list[str]) -> list[tuple[str, ...]]:
        out, lo = [], 0
        for k in range(1, len(symbols)):
            if symbols[k - 1] + symbols[k] not in self.inside:
                out.append(tuple(symbols[lo:k]))
                lo = k
        out.append(tuple(symbols[lo:]))
        return out

    def merge(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        """Ids of one fragment: the pair of lowest rank, the leftmost on ties, merges until none is left."""
        if len(symbols) > LONG:
            return self.merge_long(symbols)
        s, rank, none = list(symbols), self.ranks.get, 1 << 60
        r = [rank(p, none) for p in zip(s, s[1:], strict=False)]
        while r and (least := min(r)) < none:
            k = r.index(least)
            s[k : k + 2] = [s[k] + s[k + 1]]
            del r[k]
            if k:
                r[k - 1] = rank((s[k - 1], s[k]), none)
            if k < len(r):
                r[k] = rank((s[k], s[k + 1]), none)
        return tuple(self.vocab[x] for x in s if x in self.vocab)

    def merge_long(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        """merge() for long fragments: pairs wait in a heap, symbols are a linked list, so n symbols take n log n steps."""
        s, rank, n = list(symbols), self.ranks.get, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, s[k], s[k + 1]) for k in range(n - 1) if (r := rank((s[k], s[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            j = after[k]
            if s[k] != x or j >= n or s[j] != y:
                continue  # one of the two has merged since
            s[k], s[j] = x + y, ""
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] < n and (r := rank((s[a], s[after[a]]))) is not None:
                    heapq.heappush(heap, (r, a, s[a], s[after[a]]))
        return tuple(self.vocab[x] for x in s if x in self.vocab)

    def word(self, word: str) -> tuple[str, str, int]:
        """(ids, names, count) of a word, ids and names each with a space before."""
        symbols = list(word.encode().decode("latin-1").translate(self.table))
        symbols[-1] += self.end
        ids: list[int] = []
        for f in self.fragments(symbols):
            if (got := self.pieces.get(f)) is None:
                if len(self.pieces) >= self.cached:
                    self.pieces.clear()
                got = self.pieces[f] = self.merge(f)
            ids += got
        return "".join(f" {i}" for i in ids), "".join(f" {self.names[i]}" for i in ids), len(ids)

    def encode(self, text: str) -> tuple[str, str, int]:
        """(ids, names, count) of a text. Special tokens are found before anything else, then NFC, lower case, words."""
        parts = []
        for k, piece in enumerate(self.at_special.split(text) if "<|" in text else (text,)):
            if k % 2:
                i = self.special[piece]
                parts.append((f" {i}", f" {piece}", 1))
                continue
            get = self.cache.get
            if piece.isascii():
                words = self.words(piece.lower())
            elif max(piece) < "\u0250":
                words = self.words(unicodedata.normalize("NFC", piece).lower())
            else:  # Unicode tables differ in age: beyond Latin the library's own decide case, letters and digits
                words = [w for w, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(piece))]
            for w in words:
                if (got := get(w)) is None:
                    if len(self.cache) >= self.cached:
                        self.cache.clear()
                    got = self.cache[w] = self.word(w)
                parts.append(got)
        if not parts:
            return "", "", 0
        ids, names, n = zip(*parts, strict=True)
        return "".join(ids)[1:], "".join(names)[1:], sum(n)

    def decode(self, ids: str) -> str:
        """The text of decimal ids: this file has no decoder, so the tokens' names stand with a space between."""
        return " ".join([self.names[int(i)] for i in ids.split()])


def codec(file: str, cached: int = CACHED) -> Codec:
    """The worker's codec of a file, made once."""
    cache = c.worker_cache("codecs")
    key = hashlib.sha1(file.encode()).digest()
    if key not in cache:
        cache[key] = Codec(file)
    cache[key].cached = cached
    return cache[key]


def encode_decode(docs: DataFrame, path: str, text: bool = False, cached: int = CACHED) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256), with ``text`` also ids and decoded.

    path: the tokenizer's JSON, read by the driver and sent along (a few MB, fixed by the file).
    Null and empty texts have no tokens. Repeated rows give repeated results; an
    empty table gives none. A text of any length is one string of ids.
    """
    file = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def run(batches):
        import pyarrow as pa

        c.settle()
        enc = codec(file.value, cached)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                out = [enc.encode(t or "") for t in part.column("text").to_pylist()]
                named = [pa.array([x[2] for x in out], pa.int64()), pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in out]), pa.array([hashlib.sha256(x[1].encode()).hexdigest() for x in out])]
                if text:
                    named += [pa.array([x[0] for x in out]), pa.array([x[1] for x in out])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *named], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * text][: 4 + 2 * text])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * text
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
