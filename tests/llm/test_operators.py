"""Brute-force, round-trip and edge-case tests of the corpus operators."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import _common as c
from tidewatch.llm import bpe, knn_dedup, lang_id, line_dedup, mixing, near_dup, quality, spotsigs, token_store, toxicity

SF = "/root/testdata/sf0.001"
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, tw_h int, size string"
A = "One two three four five six seven eight nine ten eleven twelve"
ROWS = [
    (1, A, "en", "b", 1, "x", 1, "s"), (2, A.upper(), None, None, 1, "x", 1, "s"), (3, None, "de", "a", None, None, None, None), (4, "", "de", "a", 0, None, None, None), (5, " \n\t ", "en", "b", 3, "", 0, ""),
    (6, A, "en", "b", 1, "x", 1, "s"), (7, A.replace("ten", "tan"), "en", "a", 1, "x", 1, "s"), (8, "Ünï ΑΣ <|endoftext|> 漢字", "xx", "é", 1, "x", 1, "s"), (8, "Ünï ΑΣ <|endoftext|> 漢字", "xx", "é", 1, "x", 1, "s"), (9, "la " * 20000, "fr", "b", 1, "x", 1, "s"),
]


@pytest.fixture(scope="module", params=["edge", "empty"])
def docs(spark, request):
    return spark.createDataFrame(ROWS if request.param == "edge" else [], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (7, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")


def words(t):
    return [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def roots(ids, linked):
    up = {i: i for i in ids}

    def f(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = f(a), f(b)
        up[max(a, b)] = min(a, b)
    return {i: f(i) for i in ids}


def test_near_duplicates(docs):
    rows = docs.collect()
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in rows}
    ids = sorted(sets)
    want = roots(ids, [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_near_duplicate_families(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        t = list(base)
        for j in rng.choice(120, rng.integers(0, 9), replace=False):
            t[j] = f"x{rng.integers(5)}"
        rows.append((k, " ".join(t)))
    sets = {k: shingles(t) for k, t in rows}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= max(2 * got[0].block, 0.02 * t) for t, n in by.values())
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).select("doc_id", "taken").collect())) == sorted((r.doc_id, r.taken) for r in got)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in got)


def test_apportionment():
    rng = np.random.default_rng(2)
    for _ in range(50):
        votes, seats = rng.integers(1, 1000, 6).tolist(), int(rng.integers(0, 60))
        got, order = [0] * 6, []
        for _ in range(seats):
            k = max(range(6), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
            got[k] += 1
        assert mixing.sainte_lague(votes, seats) == got, order
    assert mixing.targets([10, 1000, 10], [5, 2, 1]) == [30.0, 960.0, 30.0]


def test_bpe_is_the_library(docs):
    lib = Tokenizer.from_file(WORD)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encode_decode(docs, WORD, text=True).collect():
        ids = lib.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids) and r.decoded == lib.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest() and bpe.codec(open(WORD).read()).decode(r.ids) == r.decoded


def test_language(docs):
    model = lang_id.learn(docs)
    got = lang_id.label_documents(docs, model).collect()
    assert len(got) == docs.count() and all(r.lang_pred == "und" for r in got if r.doc_id in (3, 4, 5))


def test_viterbi_is_best():
    rng = np.random.default_rng(0)
    model = lang_id.Model.__new__(lang_id.Model)
    for n in (1, 5, 127, 128, 129, 1000):
        s, ids = (-rng.exponential(6, (50, 4))).astype(np.float32), rng.integers(0, 50, n)
        path, v = model.path(np.array([0, n]), s, ids), s[ids[0]].astype(float)
        for w in ids[1:]:
            v = np.maximum(v, v.max() - lang_id.SWITCH) + s[w]
        assert abs(v.max() - (s[ids, path].sum(dtype=float) - lang_id.SWITCH * (path[1:] != path[:-1]).sum())) < 1e-2


@pytest.mark.parametrize("op", [quality, toxicity])
def test_scores(docs, labels, op):
    got = op.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


@pytest.mark.parametrize("n", [1, 17, 24, 25, 32, 33, 100, 1001])
def test_runs_of_seventeen_words_are_whole_in_a_window(n):
    data = np.frombuffer(" ".join(f"w{i}" for i in range(n)).encode(), np.uint8)
    w = toxicity.Words(np.array([0, len(data)]), data)
    assert all(any(lo <= p and lo + size >= min(p + 17, n) for lo, size in zip(w.lo, w.size, strict=True)) for p in range(max(1, n - 16)))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, lab = c.documents(spark, sf, "doc_id", "text", "lang"), spark.read.parquet(f"{sf}/labels.parquet")
    for op, name, least in ((quality, "quality", 0.97), (toxicity, "toxic", 0.97)):
        right = op.score_documents(docs, lab).filter("held_out").join(lab, "doc_id").agg(F.avg((F.col("predicted") == F.col(name)).cast("double"))).first()[0]
        assert right >= least
    got = lang_id.label_documents(docs, lang_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter(c.held_out(*lang_id.HELD))
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97


def test_token_store(spark, docs):
    lib = Tokenizer.from_file(BYTE)
    manifest = token_store.write_store(docs, BYTE, token_store.store_folder(spark), per_range=3)
    got = sorted(token_store.read_store(spark, manifest, ids=True).collect(), key=lambda r: r.start)
    want = [lib.encode(t or "", add_special_tokens=False).ids + [0] for _, t in sorted((r.doc_id, r.text) for r in docs.collect())]
    assert [r.ids for r in got] == want
    assert [r.start for r in got] == np.cumsum([0, *map(len, want)])[: len(want)].tolist()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]


def test_spotsigs(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    out = spotsigs.edits(docs, per_range=3).collect()
    got, digests = {r.doc_id: r for r in out}, {(r.doc_id, r.edited_sha256) for r in out}
    assert len(out) == len(rows)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        h = len(t) // 2
        assert got[i].n_chars == len(t) and (i, hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()) in digests
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert not rows or got[1].fingerprint == got[6].fingerprint


def test_spotsigs_search(spark):
    fp = spotsigs.fingerprints(c.documents(spark, SF)).cache()
    got = {(r["query"], r.doc_id) for r in spotsigs.search(fp, fp).collect()}
    sets = {r.doc_id: set(r.sigs) for r in fp.collect()}
    assert got == {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}


def near(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    x, y = sorted((x, y), key=len)
    return any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def test_line_dedup(docs, spark):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "gone"] and out.count() == docs.count()
    docs = c.documents(spark, SF)
    seen, want = {}, {}
    for i, t in sorted((r.doc_id, r.text) for r in docs.collect()):
        for no, line in enumerate(t.split("\n")):
            w = words(line)
            if len(w) >= 3:
                k = tuple(w)
                if k in seen or len(w) >= 8 and any(len(v) >= 8 and near(w, list(v)) for v in seen):
                    want.setdefault(i, []).append(no)
                seen.setdefault(k, i)
    assert {r.doc_id: r.gone for r in line_dedup.dedup_lines(docs).collect() if r.gone} == want


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base[rng.integers(0, 40, 300)] + rng.normal(0, 0.25, (300, 16)), np.repeat(base[:1], 30, 0)]).astype(np.float32)
    rows = [(int(i), [float(v) for v in r], 1) for i, r in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [1.0], 1)]
    got = {r.vec_id: r for r in knn_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    want = roots(range(330), [(a, b) for a in range(330) for b in range(a) if s[a, b]])
    assert {i: (got[i].n_links, got[i].component_id) for i in range(330)} == {i: (int(s[i].sum()) - 1, want[i]) for i in range(330)}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 905)) and len(got) == len(rows)


def test_groups_linked_beyond_full_lists(spark):
    rng = np.random.default_rng(4)
    a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    x = np.repeat([a, 0.927 * a + (1 - 0.927**2) ** 0.5 * b], 30, 0) + rng.normal(0, 0.003, (60, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    assert s.min() >= 0.9 and all(set(np.argsort(-r)[:11] // 30) == {i // 30} for i, r in enumerate(s))
    got = knn_dedup.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, 59, 0, i == 0) for i in range(60)}


def test_lost_links_beside_a_hot_group_are_refused(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = np.linalg.qr(rng.standard_normal((64, 21)))[0].T
    x = np.repeat(base, [100] + [2] * 20, 0) + rng.normal(0, 0.003, (140, 64))
    real = knn_dedup.compared
    monkeypatch.setattr(knn_dedup, "compared", lambda groups, kind: real(groups, kind).filter("u not between 100 and 115"))
    monkeypatch.setattr(knn_dedup, "TRIES", 1)
    with pytest.raises(RuntimeError, match="recall of links is 0.600"):
        knn_dedup.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()


def test_no_embeddings(spark):
    assert knn_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    assert p.run(spark, SF).count() > 0
