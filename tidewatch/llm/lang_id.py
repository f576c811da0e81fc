"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores with a switching penalty labels spans.

A word's score in a language is the log likelihood of its hashed byte trigrams.
Its script, told from the ranges of its code points, leaves only languages that
were seen in that script. Viterbi runs over all words of a text at once: words are cut into
segments, each segment's best paths from every entry label are found side by
side, segments are chained, and the path is read back. So a text of any length
costs its words, and long texts don't hold up short ones.

Trigram counts come from at most about ``SAMPLE`` documents of each language,
drawn by hash. The table (2**14 buckets by language, at most ``LANGUAGES``) is
of fixed size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

BITS, SAMPLE, LANGUAGES, SWITCH, SEGMENT = 14, 4000, 200, 12.0, 128
HELD = (3, 1)
#: Script of the code points from each value on, up to the next; "" for digits, marks and symbols. Fixed values, from the blocks of Unicode.
RANGES = (
    (0x00, ""), (0x41, "Latin"), (0x5B, ""), (0x61, "Latin"), (0x7B, ""), (0xAA, "Latin"), (0xAB, ""), (0xB5, "Greek"), (0xB6, ""), (0xBA, "Latin"), (0xBB, ""), (0xC0, "Latin"), (0xD7, ""), (0xD8, "Latin"), (0xF7, ""), (0xF8, "Latin"),
    (0x300, ""), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Syriac"), (0x750, "Arabic"), (0x780, "Thaana"), (0x7C0, "Nko"), (0x800, "Other"), (0x870, "Arabic"),
    (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1680, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Canadian"), (0x1900, "Other"), (0x1C80, "Cyrillic"),
    (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1DC0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2071, "Latin"), (0x2072, ""), (0x207F, "Latin"), (0x2080, ""), (0x2090, "Latin"), (0x20A0, ""), (0x2100, "Latin"), (0x2190, ""),
    (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Greek"), (0x2D00, "Georgian"), (0x2D30, "Tifinagh"), (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"), (0x2E00, ""), (0x2E2F, "Latin"), (0x2E30, ""), (0x2E80, "Han"), (0x2FE0, ""), (0x3005, "Han"), (0x3008, ""),
    (0x3021, "Han"), (0x302A, ""), (0x3031, "Kana"), (0x3036, ""), (0x3038, "Han"), (0x303D, ""), (0x3041, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, ""), (0x31A0, "Bopomofo"), (0x31C0, ""), (0x31F0, "Kana"), (0x3200, ""), (0x3400, "Han"),
    (0x4DC0, ""), (0x4E00, "Han"), (0xA000, "Yi"), (0xA4D0, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xA8E0, "Devanagari"), (0xA900, "Other"), (0xA960, "Hangul"), (0xA980, "Other"), (0xA9E0, "Myanmar"), (0xAA00, "Other"),
    (0xAA60, "Myanmar"), (0xAA80, "Other"), (0xAB00, "Ethiopic"), (0xAB30, "Latin"), (0xAB70, "Cherokee"), (0xABC0, "Other"), (0xAC00, "Hangul"), (0xD800, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""),
    (0xFE70, "Arabic"), (0xFEFF, ""), (0xFF21, "Latin"), (0xFF3B, ""), (0xFF41, "Latin"), (0xFF5B, ""), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x10000, "Other"), (0x1B000, "Kana"), (0x1B170, "Other"), (0x1D400, "Latin"), (0x1D800, "Other"), (0x1F000, ""),
    (0x20000, "Han"), (0x323B0, ""),
)
NAMES = ["", *sorted({s for _, s in RANGES if s})]
SCRIPTS = len(NAMES)


def scripts_of(data: np.ndarray) -> np.ndarray:
    """The script (its place in NAMES) of the character that begins at each byte; 0 at other bytes."""
    starts, names = np.array([x for x, _ in RANGES]), np.array([NAMES.index(s) for _, s in RANGES], np.int8)
    out = names[np.searchsorted(starts, np.arange(256), "right") - 1]
    out[128:] = 0
    out = out[data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        b = np.r_[data, np.zeros(3, np.uint8)].astype(np.int32)
        x, y, z, w = b[at], b[at + 1] & 63, b[at + 2] & 63, b[at + 3] & 63
        point = np.where(x < 0xE0, (x & 31) << 6 | y, np.where(x < 0xF0, (x & 15) << 12 | y << 6 | z, (x & 7) << 18 | y << 12 | z << 6 | w))
        out[at] = names[np.searchsorted(starts, point, "right") - 1]
    return out


def words_of(off: np.ndarray, data: np.ndarray):
    """(first, word ids, owner, trigrams, bytes, script) of a chunk; the last four for its distinct words, without ASCII digits' words a script of 0."""
    starts, ends, first = c.word_spans(off, data, c.MARK)
    h = c.span_hashes(data, starts, ends, c.byte_values(lower=True))
    u, at, ids = np.unique(h, return_index=True, return_inverse=True)
    owner, grams = c.ngram_ids(data, starts[at], ends[at], 3, BITS)
    size = ends[at] - starts[at]
    kinds = scripts_of(data)
    span = np.stack([starts[at], ends[at]], 1).ravel() if len(at) else np.zeros(0, np.int64)
    script = np.maximum.reduceat(np.r_[kinds, np.int8(0)], span)[::2] if len(at) else kinds[:0]
    return first, ids, owner, grams, size, script


class Model:
    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        """counts: languages by trigram buckets; scripts: languages by scripts, words seen."""
        self.names = names
        total = counts.sum(1, keepdims=True) + 0.1 * counts.shape[1]
        self.log = np.log((counts + 0.1) / np.maximum(total, 1)).astype(np.float32).T.copy()
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
        self.allowed = (share >= 0.002).T
        self.allowed[~self.allowed.any(1)] = True
        self.allowed[0] = True

    def scores(self, owner, grams, n: int, script) -> np.ndarray:
        """Log likelihoods, distinct words by languages; 0 for all where a word has no letters."""
        s = np.zeros((n, len(self.names)), np.float32)
        if n:
            edges = np.searchsorted(owner, np.arange(n))
            s = np.add.reduceat(self.log[grams], edges)
            s -= s.max(1, keepdims=True)
            s = np.where(self.allowed[script], np.maximum(s, -25), -40).astype(np.float32)
            s[script == 0] = 0
        return s

    def path(self, first: np.ndarray, s: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The label of each word."""
        n_lang, n_words = s.shape[1], np.diff(first)
        segs = -(-n_words // SEGMENT)
        doc = np.repeat(np.arange(len(n_words)), segs)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(segs) - segs, segs)
        lo = first[doc] + k * SEGMENT
        size = np.minimum(first[doc + 1] - lo, SEGMENT)
        out = np.zeros(len(ids), np.int16)
        if not len(doc):
            return out
        most = int(size.max())
        v = np.where(np.eye(n_lang, dtype=bool), 0, -1e6).astype(np.float32)[None].repeat(len(doc), 0)
        stay, came = np.ones((most, len(doc), n_lang, n_lang), bool), np.zeros((most, len(doc), n_lang), np.int16)
        for t in range(most):
            on = t < size
            best = v.max(2)
            came[t] = v.argmax(2)
            up = best[:, :, None] - SWITCH
            stay[t] = v >= up
            new = np.maximum(v, up) + s[ids[np.where(on, lo + t, lo)]][:, None, :]
            if on.all():
                v = new
            else:
                v = np.where(on[:, None, None], new, v)
                stay[t, ~on] = True
        chain = np.zeros((len(doc), n_lang), np.float32)
        entry = np.zeros((len(doc), n_lang), np.int16)
        by = [np.flatnonzero(k == j) for j in range(int(k.max()) + 1)]
        for j, at in enumerate(by):
            total = v[at] if j == 0 else chain[at - 1][:, :, None] + v[at]
            chain[at], entry[at] = total.max(1), total.argmax(1)
        last = np.zeros(len(doc), np.int16)
        ends = np.cumsum(segs)[segs > 0] - 1
        last[ends] = chain[ends].argmax(1)
        start = np.zeros(len(doc), np.int16)
        for j in range(len(by) - 1, -1, -1):
            at = by[j]
            start[at] = entry[at, last[at]]
            if j:
                last[at - 1] = start[at]
        label, row = last.copy(), np.arange(len(doc))
        for t in range(most - 1, -1, -1):
            on = t < size
            out[(lo + t)[on]] = label[on]
            moved = on & ~stay[t, row, start, label]
            label = np.where(moved, came[t, row, start], label)
        return out

    def label(self, texts):
        """For each text (label or None, share of its letters' bytes in that label, spans as (first word, words, label))."""
        for _, _, off, data in c.chunks(texts, 2 * c.CHUNK):
            first, ids, owner, grams, size, script = words_of(off, data)
            path = self.path(first, self.scores(owner, grams, len(size), script), ids)
            n = len(off) - 1
            doc = np.repeat(np.arange(n), np.diff(first))
            weight = np.where(script > 0, size, 0)[ids]
            bare = np.bincount(doc, weight, n)[doc] == 0
            weight = np.where(bare, size[ids], weight)  # letters of no range listed: their words count all the same
            mass = np.bincount(doc * len(self.names) + path, weight, n * len(self.names)).reshape(n, -1)
            best, total = mass.argmax(1), mass.sum(1)
            cut = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])]) if len(path) else np.zeros(0, np.int64)
            runs = np.diff(np.r_[cut, len(path)])
            own = np.searchsorted(doc[cut], np.arange(n + 1)) if len(cut) else np.zeros(n + 1, np.int64)
            for i in range(n):
                spans = [(int(a - first[i]), int(m), self.names[path[a]]) for a, m in zip(cut[own[i] : own[i + 1]], runs[own[i] : own[i + 1]], strict=True)] if total[i] else []
                yield (self.names[best[i]], float(mass[i, best[i]] / total[i]), spans) if total[i] else (None, 0.0, [])


def learn(docs: DataFrame) -> Model | None:
    """A model from docs(doc_id, text, lang): rows with a language that aren't held out; None without any."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~c.held_out(*HELD))
    have = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(have) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not have:
        return None
    names = sorted(r.lang for r in have)
    share = F.create_map(*[F.lit(x) for r in have for x in (r.lang, min(1.0, SAMPLE / r.n))])
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    place = {x: k for k, x in enumerate(names)}

    def count(batches):
        import pyarrow as pa

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi, off, data in c.chunks(batch.column("text")):
                first, ids, owner, grams, size, script = words_of(off, data)
                lang_of = np.repeat(langs[lo:hi], np.diff(first))
                for k in np.unique(langs[lo:hi]):
                    n = np.bincount(ids[lang_of == k], minlength=len(size))
                    t = total.setdefault(int(k), np.zeros((1 << BITS) + SCRIPTS))
                    t[: 1 << BITS] += np.bincount(grams[script[owner] > 0], n[owner][script[owner] > 0], 1 << BITS)
                    t[1 << BITS :] += np.bincount(script, n, SCRIPTS)
        for k, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(t[at])], ["lang", "slot", "n"])

    table = np.zeros((len(names), (1 << BITS) + SCRIPTS))
    for r in drawn.select("text", "lang").mapInArrow(count, "lang long, slot long, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect():
        table[r.lang, r.slot] = r.n
    return Model(names, table[:, : 1 << BITS], table[:, 1 << BITS :] * (np.arange(SCRIPTS) > 0))


def label_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, lang_pred, score, spans). lang_pred: the language with most bytes of words; score: its share of them.

    ``und``, score 0 and no spans where the text is null or has no letter, or
    nothing was learned. Spans are (first word, words, lang), words being runs of
    letters and digits. Repeated rows get equal results; a tie goes to the first
    language by name; a null doc_id is labelled like any other. Letters outside
    all ranges are labelled by their trigrams alone.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        import regex

        letter = regex.compile(r"\p{L}").search
        kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            texts = batch.column("text")
            if known.value is None:
                got = [(None, 0.0, [])] * len(batch)
            else:
                got = list(known.value.label(texts))
            got = [g if g[0] and t and letter(t) else ("und", 0.0, []) for g, t in zip(got, texts.to_pylist(), strict=True)]
            spans = pa.array([[{"first": a, "words": n, "lang": x} for a, n, x in g[2]] for g in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got]), spans], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first:int,words:int,lang:string>>")
