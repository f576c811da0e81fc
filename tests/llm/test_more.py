"""Edge rows with null and repeated doc_ids, clashing columns, scripts, plain recomputations, and the pipeline stage by stage."""

import hashlib
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from test_operators import near, roots, shingles, words
from tokenizers import Tokenizer

from tidewatch.llm import _common as c
from tidewatch.llm import bpe, knn_dedup, lang_id, line_dedup, mixing, near_dup, quality, queries, spotsigs, token_store, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, n_lines int, tw_h int, range string"
A = "one two three four five six seven eight nine ten eleven twelve"
LAST = ("g", 3, 4, "r")
ROWS = {
    "nulls": [(None, A, "en", "b", 1, *LAST), (None, None, None, None, None, None, None, None, None), (None, A, "en", "b", 1, *LAST), (2, A, "de", "a", 1, *LAST), (3, "", "de", "a", 0, *LAST)],
    "one id, many texts": [(5, A, "en", "b", 1, *LAST), (5, "la " * 9, "fr", "b", 1, *LAST), (5, None, "fr", "b", 1, *LAST), (6, A, "en", "b", 1, *LAST)],
    "all equal": [(7, f"{A}\n{A}", "en", "b", 1, *LAST)] * 6,
    "one row": [(8, "ʃʊʌ  \n \n x  y", None, None, 1, *LAST)],
    "very long": [(9, "word " * 300_000, "en", "b", 1, *LAST), (10, "z" * 400_000, "en", "b", 1, *LAST)],
}


@pytest.fixture(scope="module", params=sorted(ROWS))
def docs(spark, request):
    return spark.createDataFrame(ROWS[request.param], SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (5, 0, 1), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_every_row_has_a_result(docs, labels):
    n, ids = docs.count(), sorted((r.doc_id for r in docs.collect()), key=str)
    model = lang_id.learn(docs)
    outs = {
        "op1": near_dup.near_duplicates(docs), "op2": mixing.mix(docs), "op3": bpe.encode_decode(docs, P.path("word_bpe_49k.json")), "op4": lang_id.label_documents(docs, model), "op5": quality.score_documents(docs, labels), "op7": spotsigs.edits(docs, per_range=2),
        "op8": line_dedup.dedup_lines(docs), "op10": toxicity.score_documents(docs, labels),
    }
    for name, out in outs.items():
        got = out.collect()
        assert len(got) == n and sorted((r.doc_id for r in got), key=str) == ids, name


def test_columns_that_clash_pass_through(docs):
    out = line_dedup.dedup_lines(docs, names=("_lines", "_gone"))
    assert out.columns == [*docs.columns, "_lines", "_gone"]
    kept = [x for x in docs.columns if x != "text"]
    assert sorted(map(str, out.select(*kept).collect())) == sorted(map(str, docs.select(*kept).collect()))
    assert [x for x in line_dedup.dedup_lines(docs).columns if x in ("gone", "n_lines")] == ["n_lines", "gone"]
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_stages_take_any_columns(docs, labels, spark, tmp_path):
    import corpus_pipeline as p

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in p.STAGES[:4]:
        now = c.cut(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
    assert p.encode(spark, now, str(tmp_path)).count() == now.count()


def test_store_with_null_ids(docs, spark):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    m = token_store.write_store(docs, P.path("byte_bpe_50k.json"), token_store.store_folder(spark), per_range=2)
    got = sorted(token_store.read_store(spark, m, ids=True).collect(), key=lambda r: r.start)
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(r.doc_id), lib.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect())
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    seen = [r.doc_id for r in got]
    assert seen == sorted(seen, key=lambda x: (x is not None, x or 0))


def test_encoder_is_the_library():
    path, rng = P.path("byte_bpe_50k.json"), np.random.default_rng(8)
    lib, enc = Tokenizer.from_file(path), token_store.Encoder(open(path, encoding="utf-8").read(), 0)
    alphabet = ["a", "The", " ", "  ", "\n", " \n", "\n ", "\t", "'s", "’", "1", "漢", "é", "é", "́", "\xa0", "　", "ß", "🙂", "\x85", "\x1c", "--", "<|endoftext|>", "<|", "ʃ", "कि", " ", " ", "don't", "x.", "x.\nAb,", "²"]
    for _ in range(30):
        texts = ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(0, 40))) for _ in range(100)]
        for t, got in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(got, enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids + [0], repr(t)


def test_every_letter_has_a_script():
    for cp in [*range(0x80, 0x3400), *range(0x9F00, 0xD800), *range(0xF900, 0x10000), *range(0x10000, 0x1F000, 7), 0x4E00, 0x20000, 0x30000]:
        if unicodedata.category(chr(cp))[0] == "L":
            assert lang_id.scripts_of(np.frombuffer(chr(cp).encode(), np.uint8))[0] > 0, hex(cp)
    name = lambda s: lang_id.NAMES[lang_id.scripts_of(np.frombuffer(s.encode(), np.uint8))[0]]
    assert [name(x) for x in "aʃΩЖאعकไก한あ漢ქ"] == ["Latin", "Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Devanagari", "Thai", "Thai", "Hangul", "Kana", "Han", "Georgian"] and name("1") == name("—") == ""


def test_letters_of_any_script_get_a_language(spark):
    train = spark.createDataFrame([(i, "the cat sat on the mat and more", "en") for i in range(20)] + [(100 + i, "кот сидел на ковре и ещё", "ru") for i in range(20)], "doc_id long, text string, lang string")
    rows = [(1, "ʃʊʌ"), (2, "12 — !"), (3, None), (4, "и вот"), (5, "the mat"), (6, "the cat sat on the mat кот сидел на ковре и")]
    got = {r.doc_id: r for r in lang_id.label_documents(spark.createDataFrame(rows, "doc_id long, text string"), lang_id.learn(train)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == [got[1].lang_pred, "und", "und", "ru", "en"] and got[1].lang_pred in ("en", "ru")
    assert [(s.lang, s.first) for s in got[6].spans] == [("en", 0), ("ru", 6)]


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.05, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in knn_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6)}


def test_planted_clusters_of_vectors(spark):
    """Clusters of 2 to 400 members about the threshold and a hub, in 24 dimensions, among unrelated vectors."""
    rng = np.random.default_rng(6)
    base = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    x = np.concatenate([base[k] + rng.normal(0, 0.055, (n, 24)) for k, n in enumerate((2, 3, 9, 40, 400))] + [rng.standard_normal((300, 24))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    want = roots(range(len(x)), [(a, b) for a, b in np.argwhere(np.triu(s, 1))])
    got = {r.vec_id: r for r in knn_dedup.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    links = s.sum(1) - 1
    assert sum(got[i].n_links for i in got) >= 0.98 * links.sum() and all(got[i].n_links <= links[i] for i in got)
    assert np.mean([got[i].component_id == want[i] for i in got]) >= 0.99


def plain_signatures(text):
    seq = regex.sub(r"[^\p{L}\p{N}\p{M}]+", " ", (text or "").lower()).split()
    found, anchor, chain = set(), None, []
    for w in seq:
        if w in spotsigs.ANCHORS:
            anchor = w
        else:
            chain.append((anchor, w))
            anchor = None
    for i, (a, w) in enumerate(chain):
        if a:
            found.add((a, w, chain[i + 1][1] if i + 1 < len(chain) else ""))
    return found or ({tuple(seq)} if seq else set())


def test_likeness_is_that_of_plain_sets(spark):
    rows = sorted(((r.doc_id, r.text or "") for r in c.documents(spark, SF).collect()), reverse=True)
    got = {r.doc_id: r for r in spotsigs.edits(c.documents(spark, SF), per_range=40).collect()}
    like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        s, e, n = plain_signatures(t), plain_signatures(edited), plain_signatures(nxt)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and len(got[i].fingerprint.split(".")) == max(1, len(s))
        assert got[i].near_edited == pytest.approx(like(s, e)) and got[i].near_next == pytest.approx(like(s, n))


@pytest.mark.parametrize("op", [quality, toxicity])
def test_a_score_does_not_hang_on_its_neighbours(op):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, rng.integers(0, 90))) for _ in range(40)]
    y = np.array([int("w7 " in t) for t in texts])
    model = op.fit(texts, y)
    every = op.score_texts(model, pa.array(texts))
    assert np.allclose(every, [op.score_texts(model, pa.array([t]))[0] for t in texts], atol=1e-6)


def test_quality_is_an_average_of_bucket_weights():
    texts = ["good words here", "bad bad words", "good good", "bad here"] * 6
    table, bias = quality.fit(texts, np.array([1, 0, 1, 0] * 6))
    for t in texts[:4]:
        data = np.frombuffer(t.encode(), np.uint8)
        z = bias
        for k, (ids, _) in enumerate(quality.features(np.array([0, len(data)]), data)):
            z += sum(float(table[(k << quality.BITS) + i]) for i in ids) / max(1, len(ids))
        assert quality.score_texts((table, bias), pa.array([t]))[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_gradients_of_the_net():
    net = toxicity.Net()
    data = np.frombuffer(b"one two three four five six seven eight nine ten", np.uint8)
    w, y = toxicity.Words(np.array([0, 23, len(data)]), data), np.array([1.0, 0.0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for k in "ofbAav":
        for name in (k, f"W{k}", f"U{k}", f"c{k}"):
            if name in net.p:
                net.p[name] = net.p[name] + 0.1 * np.random.default_rng(len(name)).standard_normal(net.p[name].shape)
    pick = np.array([0, int(np.flatnonzero(w.doc == 1)[0])])

    def loss():
        z = net.score(w)[pick].astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    class Nothing:
        def random(self, n):
            return np.ones(n)

    g = net.gradients(w, pick, y, Nothing())
    rng = np.random.default_rng(0)
    for name in ("o", "z", "v", "A", "a", "Wf", "Uf", "cf", "Wb", "Ub", "cb"):
        flat = net.p[name].reshape(-1)
        for i in rng.choice(len(flat), min(3, len(flat)), replace=False):
            keep = flat[i]
            flat[i] = keep + 1e-2
            up = loss()
            flat[i] = keep - 1e-2
            down = loss()
            flat[i] = keep
            assert np.asarray(g[name]).reshape(-1)[i] == pytest.approx((up - down) / 2e-2, abs=2e-4, rel=0.05), name


def test_mix_takes_whole_passes_and_one_more(spark):
    """taken is the sum over a document's blocks of words times passes; passes of a shard's blocks differ by one at most and add up to its seats."""
    got = mixing.mix(c.documents(spark, SF, "doc_id", "text", "source")).collect()
    size = {r.doc_id: len(words(r.text)) for r in c.documents(spark, SF).collect()}
    for r in got:
        b, lo, hi = r.block, r.first_word, r.first_word + r["size"]
        assert r["size"] == size[r.doc_id] and r.taken == sum(p.times * (min(hi, (p.block + 1) * b) - max(lo, p.block * b)) for p in r.passes) and r.taken <= 3 * r["size"]
        assert not r.passes or max(p.times for p in r.passes) - min(p.times for p in r.passes) <= 1


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    key = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    first = spark.read.parquet(f"{SF}/documents.parquet")
    lab = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    clean = c.cut(p.remove_toxic(spark, first, SF), "t1")
    fine = {r.doc_id for r in toxicity.score_documents(first, lab).filter("predicted = 0").collect()}
    assert key(clean) == sorted((str(r.doc_id), r.text or "") for r in first.collect() if r.doc_id in fine)
    lines = c.cut(p.drop_repeated_lines(spark, clean, SF), "t2")
    seen, want = [], []
    for i, t in sorted((r.doc_id, r.text or "") for r in clean.collect()):
        left, lost = [], False
        for line in t.split("\n"):
            w = words(line)
            gone = len(w) >= 3 and (w in seen or len(w) >= 8 and any(len(v) >= 8 and near(w, v) for v in seen))
            if len(w) >= 3:
                seen.append(w)
            lost |= gone
            left += [] if gone else [line]
        if not lost or words("\n".join(left)):
            want.append((str(i), "\n".join(left)))
    assert key(lines) == sorted(want)
    one = c.cut(p.drop_near_duplicates(spark, lines, SF), "t3")
    sets = {r.doc_id: shingles(r.text) for r in lines.collect()}
    root = roots(sorted(sets), [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert {r.doc_id for r in one.collect()} == {i for i in sets if root[i] == i}
    mixed = c.cut(p.mix_sources(spark, one, SF), "t4")
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in mixing.mix(one).collect())
    lib, got = Tokenizer.from_file(P.path("word_bpe_49k.json")), p.encode(spark, mixed, SF)
    ids = [lib.encode(r.text, add_special_tokens=False).ids for r in mixed.collect()]
    assert sorted(r.ids_sha256 for r in got.collect()) == sorted(hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_held_out_flags(spark):
    ids = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ids.select("doc_id", c.held_out(4, 2).alias("h")).collect())


def test_words_are_those_of_the_contract():
    assert words("A b\tC d") == ["a b", "c", "d"] and re.findall(c.WORD, " x ") == ["x"]
