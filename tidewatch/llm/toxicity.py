"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A word's input is a hashed word vector beside the mean of its hashed character
trigram vectors. A text is scored in windows of ``SPAN`` words, a new one every
``STEP``, all of them; its score is that of its worst window. Training, in numpy,
is by multiple instances: a toxic document teaches through its currently worst
window, a clean one through its worst and a random one.

The fit runs on the driver on at most ``SAMPLE`` labelled documents of each label,
whole: those of up to ``LONGEST`` characters first, then at most 100 longer ones. The parameters (about 1.5 MB, fixed) go to the
executors, which read each text once and hold a chunk of it at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

SPAN, STEP = 24, 8
SAMPLE, LONGEST, EPOCHS = 2000, 12_000, 4
BITS, WORD_DIM, CHAR_DIM, HIDDEN, ATT = 14, 6, 12, 8, 8
HELD = (4, 2)
THRESHOLD = 0.3


class Words:
    """The words of a chunk of texts: ids into its distinct words, their buckets, windows over them."""

    def __init__(self, off: np.ndarray, data: np.ndarray) -> None:
        starts, ends, self.first = c.word_spans(off, data, c.MARK)
        h = c.span_hashes(data, starts, ends, c.byte_values(lower=True))
        u, at, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.bucket = (u >> c.U(64 - BITS)).astype(np.int64)
        self.owner, self.grams = c.ngram_ids(data, starts[at], ends[at], 3, BITS)
        self.n_grams = np.bincount(self.owner, minlength=len(u)).astype(np.float32)
        n = np.diff(self.first)
        per = np.where(n > 0, 1 + np.maximum(0, -(-(n - SPAN) // STEP)), 0)
        self.doc = np.repeat(np.arange(len(n)), per)
        k = np.arange(len(self.doc)) - np.repeat(np.cumsum(per) - per, per)
        self.lo = self.first[self.doc] + k * STEP
        self.size = np.minimum(self.first[self.doc + 1] - self.lo, SPAN)

    def windows(self, pick) -> tuple[np.ndarray, np.ndarray]:
        """(word ids, mask) of the windows picked; ids stand at 0 beyond a window's end."""
        lo, size = self.lo[pick], self.size[pick]
        t = np.arange(SPAN)
        mask = t < size[:, None]
        at = lo[:, None] + np.where(mask, t, 0)
        return self.ids[at], mask


class Net:
    def __init__(self, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": (0.1 * r.standard_normal((1 << BITS, WORD_DIM))).astype(np.float32), "char": (0.3 * r.standard_normal((1 << BITS, CHAR_DIM))).astype(np.float32)}
        for k in "fb":
            self.p |= {f"W{k}": g(d, 3 * h), f"c{k}": np.zeros(3 * h, np.float32), f"U{k}": g(h, 3 * h)}
        self.p |= {"A": g(2 * h, ATT), "a": np.zeros(ATT, np.float32), "v": g(ATT), "o": g(2 * h), "z": np.full(1, -1, np.float32)}

    def inputs(self, w: Words, use: np.ndarray | None = None) -> np.ndarray:
        """Vectors of a chunk's distinct words."""
        p = self.p
        x = np.empty((len(w.bucket), WORD_DIM + CHAR_DIM), np.float32)
        x[:, :WORD_DIM] = p["word"][w.bucket]
        edges = np.r_[0, np.cumsum(w.n_grams.astype(np.int64))[:-1]] if len(x) else []
        x[:, WORD_DIM:] = np.add.reduceat(p["char"][w.grams], edges) / w.n_grams[:, None] if len(x) else 0
        return x

    def walk(self, k: str, proj: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction, (time, window, hidden)."""
        h, n = HIDDEN, len(ids)
        out, s, u = np.empty((SPAN, n, h), np.float32), np.zeros((n, h), np.float32), self.p[f"U{k}"]
        full = mask.all(0)
        for t in range(SPAN) if k == "f" else range(SPAN - 1, -1, -1):
            x, y = proj[ids[:, t]], s @ u
            zr = x[:, : 2 * h] + y[:, : 2 * h]
            np.negative(zr, out=zr)
            np.exp(np.minimum(zr, 30, out=zr), out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :h], zr[:, h:]
            m = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
            new = m + z * (s - m)
            if not full[t]:
                new = np.where(mask[:, t, None], new, s)
            if keep is not None:
                keep.append((t, s, z, r, m, y[:, 2 * h :]))
            out[t] = s = new
        return out

    def score(self, w: Words, pick=slice(None), most: int = 2048) -> np.ndarray:
        """Logits of the windows picked."""
        p, x = self.p, self.inputs(w)
        pf, pb = x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]
        at = np.arange(len(w.lo))[pick]
        got = [np.zeros(0, np.float32)]
        for k in range(0, len(at), most):
            ids, mask = w.windows(at[k : k + most])
            s = np.concatenate([self.walk("f", pf, ids, mask), self.walk("b", pb, ids, mask)], 2)
            got.append(self.head(s, mask)[0])
        return np.concatenate(got)

    def head(self, s: np.ndarray, mask: np.ndarray):
        p = self.p
        q = np.tanh(s @ p["A"] + p["a"])
        e = np.where(mask.T, q @ p["v"], -1e9)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pool = (e[:, :, None] * s).sum(0)
        return pool @ p["o"] + p["z"][0], q, e, pool

    def gradients(self, w: Words, pick: np.ndarray, y: np.ndarray, rng) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        x = self.inputs(w)
        hidden = rng.random(len(x)) < 0.3
        x[hidden, :WORD_DIM] = 0
        ids, mask = w.windows(pick)
        kept: dict[str, list] = {"f": [], "b": []}
        s = np.concatenate([self.walk(k, x @ p[f"W{k}"] + p[f"c{k}"], ids, mask, kept[k]) for k in "fb"], 2)
        logit, q, e, pool = self.head(s, mask)
        d = (c.sigmoid(logit) - y).astype(np.float32) / len(y)
        g = {"o": pool.T @ d, "z": d.sum(keepdims=True)}
        dpool = d[:, None] * p["o"]
        de = (s * dpool).sum(2)
        ds = e[:, :, None] * dpool
        de = e * (de - (e * de).sum(0))
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["v"] = (q * de[:, :, None]).sum((0, 1))
        g["A"] = np.tensordot(s, dq, ((0, 1), (0, 1)))
        g["a"] = dq.sum((0, 1))
        ds += dq @ p["A"].T
        dx = np.zeros_like(x)
        for j, k in enumerate("fb"):
            dp = np.zeros((len(x), 3 * h), np.float32)
            du, dh = np.zeros_like(p[f"U{k}"]), np.zeros((len(ids), h), np.float32)
            for t, prev, z, r, m, yn in reversed(kept[k]):
                dh = dh + ds[t, :, j * h : (j + 1) * h]
                on = mask[:, t, None]
                dn = np.where(on, dh, 0)
                dm = dn * (1 - z) * (1 - m * m)
                dz = dn * (prev - m) * z * (1 - z)
                dr = dm * yn * r * (1 - r)
                dy = np.concatenate([dz, dr, dm * r], 1)
                du += prev.T @ dy
                dh = np.where(on, dn * z + dy @ p[f"U{k}"].T, dh)
                np.add.at(dp, ids[:, t], np.where(on, np.concatenate([dz, dr, dm], 1), 0))
            g[f"U{k}"], g[f"W{k}"], g[f"c{k}"] = du, x.T @ dp, dp.sum(0)
            dx += dp @ p[f"W{k}"].T
        dx[hidden, :WORD_DIM] = 0
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], w.bucket, dx[:, :WORD_DIM])
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], w.grams, (dx[:, WORD_DIM:] / w.n_grams[:, None])[w.owner])
        return g


def gram_odds(chunks: list, pos: int, neg: int) -> np.ndarray:
    """For each trigram bucket the log odds, shrunk towards 0 where documents are few, that a document with it is toxic: where training begins."""
    n = np.zeros((2, 1 << BITS))
    for w, labels in chunks:
        doc = np.repeat(np.arange(len(labels)), np.diff(w.first))
        seen = np.unique(doc * len(w.bucket) + w.ids)
        d, u = seen // max(1, len(w.bucket)), seen % max(1, len(w.bucket))
        at = np.r_[0, np.cumsum(w.n_grams.astype(np.int64))]
        size = at[u + 1] - at[u]
        g = w.grams[np.repeat(at[u] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
        k = np.unique(np.repeat(d, size) << BITS | g)
        np.add.at(n, (labels[k >> BITS], k & (1 << BITS) - 1), 1)
    both = n.sum(0)
    return (np.log((n[1] + 0.5) / (pos + 1)) - np.log((n[0] + 0.5) / (neg + 1))) * both / (both + 3)


def fit(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Net:
    """A net trained by Adam; the same texts, in the same order, give the same net."""
    import pyarrow as pa

    net, rng = Net(seed), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        net.p["o"][:] = 0
        net.p["z"][:] = 6 if len(y) and y.max() else -6
        return net
    chunks = []
    for lo, hi, off, data in c.chunks(pa.array(texts), 256 << 10):
        chunks.append((Words(off, data), y[lo:hi]))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    odds = gram_odds(chunks, int(y.sum()), int(len(y) - y.sum()))
    net.p["char"][:, 0] = odds / 2
    step, batch = 0, 96
    for epoch in range(max(epochs, min(10 * epochs, epochs * 3000 // len(y)))):
        for w, labels in (chunks[i] for i in rng.permutation(len(chunks))):
            if not len(w.doc):
                continue
            if epoch:
                s = net.score(w)
            else:
                word = np.bincount(w.owner, odds[w.grams], len(w.bucket)) / w.n_grams
                ids, mask = w.windows(slice(None))
                s = np.where(mask, word[ids], -9).max(1)
            order = np.lexsort((-s, w.doc))
            top = order[np.r_[True, w.doc[order][1:] != w.doc[order][:-1]]]
            pos = top[labels[w.doc[top]] == 1]
            neg = np.flatnonzero(labels[w.doc] == 0)
            neg = np.r_[top[labels[w.doc[top]] == 0], rng.choice(neg, min(len(neg), max(8, 2 * len(pos))), replace=False)] if len(neg) else neg
            pick = rng.permutation(np.r_[pos, neg])
            for k in range(0, len(pick), batch):
                part = pick[k : k + batch]
                g = net.gradients(w, part, labels[w.doc[part]].astype(np.float32), rng)
                step += 1
                for name, x in g.items():
                    m[name] += 0.1 * (x - m[name])
                    v[name] += 0.01 * (x * x - v[name])
                    net.p[name] -= 0.01 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)
    return net


def score_texts(net: Net, texts) -> np.ndarray:
    """The worst window's probability for each text of an Arrow array; 0 for texts without words."""
    out = np.zeros(len(texts))
    for lo, hi, off, data in c.chunks(texts):
        w = Words(off, data)
        if len(w.doc):
            np.maximum.at(out[lo:hi], w.doc, c.sigmoid(net.score(w).astype(np.float64)))
    return out


def fitted(docs: DataFrame, labels: DataFrame):
    """The net learned from the labelled rows, as a broadcast (its size is fixed)."""
    return docs.sparkSession.sparkContext.broadcast(fit(*c.labelled_sample(docs, labels, "toxic", *HELD, SAMPLE, LONGEST)))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold: one pass over the texts, no join."""
    net = fitted(docs.select(F.col("doc_id").cast("long"), "text"), labels)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(score_texts(net.value, batch.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> (doc_id, held_out, score, predicted) for every row.

    Null and empty texts, and texts without letters or digits, score 0. Repeated
    rows get equal results; of labels that contradict each other the toxic one
    counts. Without labels of both kinds every text with words gets one score.
    A null doc_id is scored like any other, held_out false.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    net = fitted(docs, labels)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(net.value, batch.column("text")))], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double").select("doc_id", c.held_out(*HELD).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
