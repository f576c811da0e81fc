import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.config import SMALL, SMALL_STAGED, Config
from tidewatch.functions import bitmap, scalar
from tidewatch.operators import cluster, synchrony
from tidewatch.sources import flows
from tidewatch.streaming import landmark


def test_bitmaps(spark):
    r = spark.createDataFrame([([1, 3, 0], [2, 3, 8], 4)], "a array<int>, b array<int>, s int")
    got = r.select(bitmap.popcount(F.col("a")), bitmap.rotate_days(F.col("a"), F.col("s")), bitmap.jaccard(F.col("a"), F.col("b")), bitmap.hours(F.col("a")), bitmap.first_hours(F.col("a"), 25)).first()
    assert tuple(got) == (3, [0, 1, 3], 2 / 5, [0, 24, 25], [1, 1, 0])


def test_scalars(spark):
    r = spark.createDataFrame([("2024-01-01T00:00:01.123456789Z", "10.2.3.4", [5, 6, 7], [54321, 54321])], "t string, ip string, p array<int>, i array<int>")
    got = r.select(scalar.iso_epoch(F.col("t")), scalar.ip_int(F.col("ip")), scalar.ip_text(scalar.ip_int(F.col("ip"))), scalar.port_policy(F.col("p")), scalar.ipid_class(F.col("i")), scalar.iso_epoch(F.lit("x")), scalar.normal_tail(F.lit(1.96))).first()
    assert tuple(got)[:6] == (1704067201, 167904004, "10.2.3.4", "spnarrow", "ip54321", 0)
    assert abs(got[6] - math.erfc(1.96 / math.sqrt(2)) / 2) < 1e-7


def test_payload_classes(spark):
    rows = [("", 80, "empty"), ("00", 53, "dns"), ("64313a61", 1, "bittorrent-dht"), ("4100", 1, "utp"), ("e4", 1, "kad"), ("000100002112a442", 1, "stun"), ("5245474953", 1, "sip"), ("4d2d534541", 1, "ssdp"), ("41424344", 1, "ascii-other"), ("00ff", 1, "binary-other")]
    df = spark.createDataFrame(rows, "h string, p int, want string")
    assert df.filter(scalar.payload_class(F.col("h"), F.col("p")) != F.col("want")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6))
def test_blobs_are_told_apart(seed):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(0, 0.1, (30, 3)), r.normal(8, 0.1, (30, 3))])
    label = cluster.block_labels(x, np.arange(60), Config(min_size=10))
    assert len(set(label[:30])) == len(set(label[30:])) == 1 and label[0] != label[30]


def test_step_up(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.02, 0.03, 0.5, 0.9])], "i int, p double")
    assert [r.passed for r in synchrony.step_up(df, "p", 0.05).orderBy("i").collect()] == [True, True, True, False, False]


def test_one_synchronised_campaign_of_twenty_passes(spark):
    r = np.random.default_rng(6)
    pattern = r.integers(0, 1 << 24, (160, 7)) & r.integers(0, 1 << 24, (160, 7)) & r.integers(0, 1 << 24, (160, 7))
    pattern[:8] = pattern[0]
    p = spark.createDataFrame([(i, w.tolist(), 80, sum(int(x).bit_count() for x in w), "NA") for i, w in enumerate(pattern)], "src long, words array<int>, top1 int, nact long, cc string").cache()
    members = spark.createDataFrame([(i, i // 8) for i in range(160)], "src long, camp int").cache()
    assert synchrony.decide(p, members, SMALL).filter("orchestrated").count() == 0
    got = {r.camp: r for r in synchrony.decide_staged(p, members, spark.createDataFrame([(2,)], "camp int"), SMALL_STAGED).collect()}
    assert len(got) == 20 and {k for k, x in got.items() if x.orchestrated} == {0}
    assert got[0].p == 1 / 10_001 and got[2].residue and got[2].p == 1 and not got[2].testable


def drawn(x, n):
    for _ in range(2):
        x %= scalar.M31
        x = (x * x + x * 48271 + 12345) % scalar.M31
    return x % n


def turned(words, hours):
    x, hours = sum(int(w) << 24 * d for d, w in enumerate(words)), hours % (24 * len(words))
    return (x << hours | x >> 24 * len(words) - hours) & (1 << 24 * len(words)) - 1


@pytest.mark.parametrize(("days", "size"), [(7, 7), (3, 7), (1, 7), (2, 2)])
def test_rotation_is_that_of_turning_both_members_for_each_draw(spark, days, size):
    r = np.random.default_rng(days)
    words = (r.integers(0, 1 << 24, (12, size)) & r.integers(0, 1 << 24, (12, size))).tolist()
    words[11] = [0] * size
    pair = [(i // 6, i, j) for i in range(12) for j in range(i + 1, 12) if i // 6 == j // 6]
    p, pairs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "src long, words array<int>"), spark.createDataFrame(pair, "camp int, a long, b long")
    null = synchrony.rotation_null(pairs, p, synchrony.coactivity(pairs, p), 60, days, 7)
    like = lambda x, y: (x & y).bit_count() / (x | y).bit_count() if x | y else 0.0
    unit, n = (24, days) if days >= 2 else (1, 24)
    off = lambda s, b: drawn(s * 7919 + b * 104729 + 7, n) * unit
    for row in null.collect():
        mine = [(a, c) for camp, a, c in pair if camp == row.camp]
        obs = np.mean([like(turned(words[a], 0), turned(words[c], 0)) for a, c in mine])
        t = np.array([np.mean([like(turned(words[a], off(a, b)), turned(words[c], off(c, b))) for a, c in mine]) for b in range(1, 61)])
        assert row.p_rot == pytest.approx((np.sum(t >= obs - 1e-12) + 1) / 61) and row.z_rot == pytest.approx((obs - t.mean()) / t.std())
    # A draw looks its likeness up: above the step that multiplies rows, nothing folds words.
    plan = null._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "zip_with" in plan and "zip_with" not in plan[: plan.index("Generate explode")]


def test_no_pass_is_run_that_no_campaign_is_left_for(spark):
    obs, runs = spark.createDataFrame([(1, 0.5), (2, 0.5)], "camp int, coact double"), []

    def null(pairs, obs, draws, seed):
        runs.append((draws, sorted(r.camp for r in obs.collect())))
        return obs.select("camp", F.when((F.col("camp") == 1) & (draws < 1000), 0.05).otherwise(0.4).alias("p_x"))

    got = synchrony.refine(null, obs.select("camp"), obs, "x", [200, 300, 10_000], [0.1, 0.01], 7)
    assert runs == [(200, [1, 2]), (300, [1])] and {r.camp: r.p_x for r in got.collect()} == {1: 0.05, 2: 0.4}


def test_likeness_of_words_of_any_number(spark):
    r = np.random.default_rng(3)
    pairs = [tuple(r.integers(0, 1 << 24, n).tolist() for _ in range(2)) for n in (1, 6, 7, 7, 8)] + [([0] * 7, [0] * 7)]
    for x in spark.createDataFrame(pairs, "a array<int>, b array<int>").withColumn("j", bitmap.jaccard(F.col("a"), F.col("b"))).collect():
        both, any_ = (sum(f(u, v).bit_count() for u, v in zip(x.a, x.b, strict=True)) for f in (int.__and__, int.__or__))
        assert x.j == (both / any_ if any_ else 0.0)


def test_raw_records(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"SourceIP":"1.2.3.4","Traffic":11,"Port":80,"Packets":2}\nnot json\n{"SourceIP":"1.2.3.5","Traffic":5}\n{"SourceIP":"1.2.3.6","Traffic":0,"Country":"NA"}\n')
    got = {r.SourceIP: r for r in flows.read_raw(spark, str(tmp_path)).collect()}
    assert set(got) == {"1.2.3.4", "1.2.3.6"} and got["1.2.3.4"].pmask == 1 and got["1.2.3.6"].Country == "NA" and got["1.2.3.6"].Packets == 0


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    f = flows.event_flows(spark, "/root/testdata/sf0.001").select("src", "t", "h", "pk", "bytes").cache()
    for k in range(3):
        f.filter((F.col("h") >= 56 * k) & (F.col("h") < 56 * k + 56)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = landmark.replay(spark, str(tmp_path / "in"), "src long, t long, h long, pk long, bytes long", str(tmp_path / "out"), str(tmp_path / "ck"))
    want = f.groupBy("src").agg(F.count("*").alias("nrec"), F.sum("pk").alias("pk"), F.sum("bytes").alias("bytes"), F.min("t").alias("t0"), F.max("t").alias("t1"), bitmap.day_words(F.col("h"), 7).alias("words"), F.min("h").alias("hfirst"), F.max("h").alias("hlast"))
    key = lambda df: sorted(tuple(r) for r in df.select("src", "nrec", "pk", "bytes", "t0", "t1", "words", "hfirst", "hlast").collect())
    assert key(got) == key(want)
