"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax, trained by stochastic gradient descent in numpy.

Features of a text: its words, its pairs of neighbouring words (hashed without
regard to order, so a word said twice falls in one bucket whatever the word) and
its character 4-grams (bytes, A-Z lower-cased). The fit runs on the driver on at
most ``SAMPLE`` labelled documents of each label, whole: those of up to
``LONGEST`` characters first, then at most 100 longer ones. With two labels, softmax of an average of vectors is a sigmoid of an
average of one number per bucket; those (1 MB, fixed) go to the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

BITS, DIM, GRAM = 18, 8, 4
SAMPLE, LONGEST, EPOCHS, RATE, BATCH = 3000, 12_000, 6, 0.02, 32
HELD = (4, 2)
THRESHOLD = 0.7


def features(off: np.ndarray, data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Three pairs (buckets, offsets) for a chunk: words, word pairs, character n-grams; buckets offsets[i]:offsets[i+1] are document i's."""
    starts, ends, first = c.word_spans(off, data)
    h = c.span_hashes(data, starts, ends, c.byte_values(lower=True))
    shift = c.U(64 - BITS)
    words = (h >> shift).astype(np.int32)
    if len(h) > 1:
        ok = np.ones(len(h) - 1, bool)
        edge = first[1:-1]
        ok[edge[(edge > 0) & (edge < len(h))] - 1] = False
        both = c.fmix(h[:-1] ^ h[1:])
        pairs = (c.fmix(both + c.U(1)) >> shift).astype(np.int32)[ok]
        at = np.r_[0, np.cumsum(ok), int(ok.sum())][first]
    else:
        pairs, at = words[:0], np.zeros_like(first)
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    b = low[data].astype(np.uint32)
    n = max(0, len(b) - GRAM + 1)
    code = b[:n].copy()
    for k in range(1, GRAM):
        code |= b[k : k + n] << np.uint32(8 * k)
    code *= np.uint32(2654435761)
    code ^= code >> np.uint32(15)
    code *= np.uint32(2246822519)
    grams = (code >> np.uint32(32 - BITS)).astype(np.int32)
    keep = np.ones(n, bool)
    for e in off[1:-1]:
        keep[max(0, e - GRAM + 1) : e] = False
    to = np.r_[0, np.cumsum(keep)][np.minimum(off, n)]
    return [(words, first), (pairs, at), (grams[keep], to)]


def sums(weights: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(weights, dtype=np.float64)]
    return total[off[1:]] - total[off[:-1]]


def fit(texts: list[str], y: np.ndarray, seed: int = 4) -> tuple[np.ndarray, float]:
    """(one number for each bucket of each of the three kinds, bias): the difference of the two labels' logits. The same texts in the same order give the same result."""
    import pyarrow as pa

    size = 3 << BITS
    if not len(y) or y.min() == y.max():
        return np.zeros(size, np.float32), 6.0 if len(y) and y.max() else -6.0
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, off, data in c.chunks(pa.array(texts)):
        kinds = features(off, data)
        for i in range(len(off) - 1):
            ids = np.concatenate([x[o[i] : o[i + 1]].astype(np.int64) + (k << BITS) for k, (x, o) in enumerate(kinds)])
            share = np.concatenate([np.full(o[i + 1] - o[i], 1 / max(1, o[i + 1] - o[i]), np.float32) for _, o in kinds])
            u, at = np.unique(ids, return_inverse=True)
            docs.append((u, np.bincount(at, share, len(u)).astype(np.float32) if len(u) else share))
    rng = np.random.default_rng(seed)
    e = (rng.standard_normal((size, DIM)) * 0.05).astype(np.float32)
    w, bias = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32), np.zeros(2, np.float32)
    grown = np.full(size, 1e-6, np.float32)
    epochs = max(EPOCHS, min(10 * EPOCHS, EPOCHS * 3000 // len(docs)))
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs) + 0.002)
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            ids, share = np.concatenate([docs[i][0] for i in part]), np.concatenate([docs[i][1] for i in part])
            if not len(ids):
                continue
            row = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
            mean = np.zeros((len(part), DIM), np.float32)
            weighed = e[ids] * share[:, None]
            for d in range(DIM):
                mean[:, d] = np.bincount(row, weighed[:, d], len(part))
            z = mean @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = p @ w.T
            u, at = np.unique(ids, return_inverse=True)
            g = np.empty((len(u), DIM), np.float32)
            for d in range(DIM):
                g[:, d] = np.bincount(at, back[row, d] * share, len(u))
            grown[u] += (g * g).mean(1)
            e[u] -= rate * g / np.sqrt(grown[u])[:, None]
            w -= 5 * rate * (mean.T @ p)
            bias -= 5 * rate * p.sum(0)
    return e @ (w[:, 1] - w[:, 0]), float(bias[1] - bias[0])


def score_texts(model: tuple[np.ndarray, float], texts) -> np.ndarray:
    """Probability of label 1 for each text of an Arrow array; texts without words get what the bias alone gives."""
    table, bias = model
    out = np.zeros(len(texts))
    for lo, hi, off, data in c.chunks(texts):
        z = np.full(hi - lo, bias)
        for k, (ids, o) in enumerate(features(off, data)):
            z += sums(table[k << BITS : k + 1 << BITS][ids], o) / np.maximum(1, np.diff(o))
        out[lo:hi] = c.sigmoid(z)
    return out


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> (doc_id, held_out, score, predicted) for every row.

    Null texts count as empty; an empty text's score is the bias alone. Repeated
    rows get equal results; of labels that contradict each other 1 counts. With
    one label only, or none, all scores are 1 or 0 but for rounding. A null
    doc_id is scored like any other, held_out false.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(*c.labelled_sample(docs, labels, "quality", *HELD, SAMPLE, LONGEST)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(model.value, batch.column("text")))], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double").select("doc_id", c.held_out(*HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
