import base64
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import intervals
from tidewatch.operators import sentences
from tidewatch.sources import packets

ETH = "00" * 12
IP = "4500000000070000{ttl}{proto}0000f0000001{dst}"


def fields(spark, *frames):
    rows = [(i, base64.b64encode(bytes.fromhex(x)).decode() if x is not None and x != "?" else x and "!!!") for i, x in enumerate(frames)]
    got = packets.parse_frames(spark.createDataFrame(rows, "i int, s string"), "s").orderBy("i").collect()
    return [tuple(r[f] for f in packets.FIELDS) for r in got]


def test_frames(spark):
    ip = lambda proto: IP.format(ttl="80", proto=proto, dst="0a000001")
    icmp = ETH + "0800" + ip("01") + "0800"
    longer = ETH + "0800" + ip("11").replace("45", "46", 1) + "01010101" + "00350035000c0000" + "aa" * 9
    got = fields(spark, icmp, longer, ETH + "0806" + ip("01"), ETH + "0800" + ip("06") + "0050", None, "", "?", (ETH + "0800" + ip("01"))[:-2])
    none = (None,) * 11
    assert got[0] == (1, 0x0A000001, None, 128, 7, 0, 8, None, None, None, None)
    assert got[1][:4] == (17, 0x0A000001, 53, 128) and got[1][9:] == (9, "aa" * 8)
    assert got[2] == none and got[4:] == [none] * 4
    assert got[3][0] == 6 and got[3][2] is None and got[3][8] is None


@pytest.mark.parametrize(("options", "want"), [("020405b4", "M1460"), ("00", "E"), ("0101", "N.N"), ("0402080a0000000000000000", "S.T"), ("0204", ""), ("01fe", "N"), ("1e03aa", "K30"), ("020305", "K2"), ("0301", ""), ("", "")])
def test_option_signature(spark, options, want):
    assert spark.createDataFrame([(options,)], "s string").select(packets.option_signature(F.col("s"))).first()[0] == want


def test_rate_bounds(spark):
    df = spark.createDataFrame([(0, 1), (3, 2), (150, 0), (None, 4), (200_000, 10)], "k bigint, t bigint")
    got = [tuple(r.b) for r in df.select(intervals.rate_bounds(F.col("k"), F.col("t")).alias("b")).collect()]
    pmf = lambda i, m: math.exp(i * math.log(m) - m - math.lgamma(i + 1))
    assert got[0][0] == 0 and abs(got[0][1] + math.log(0.025)) < 1e-9
    for (lo, hi), k, t in ((got[1], 3, 2), (got[2], 150, 1)):
        assert abs(1 - sum(pmf(i, lo * t) for i in range(k)) - 0.025) < 1e-9 and abs(sum(pmf(i, hi * t) for i in range(k + 1)) - 0.025) < 1e-9
    assert all(b is None or math.isnan(b) for b in got[3])
    assert abs(got[4][0] - (200_000 - 1.959964 * 200_000**0.5 + 0.95) / 10) < 0.1


def test_proportion_bounds():
    lo, hi = intervals.proportion_bounds(0, 10)
    assert lo == 0 and abs(hi - (1 - 0.025**0.1)) < 1e-9
    lo, hi = intervals.proportion_bounds(4, 9)
    assert abs(intervals.binomial_tail(4, 9, lo) - 0.025) < 1e-9 and abs(1 - intervals.binomial_tail(5, 9, hi) - 0.025) < 1e-9
    assert np.isclose(intervals.proportion_bounds(10, 10)[1], 1)


def test_sentences(spark):
    hours = spark.createDataFrame([(0, 1, 10, 30, 9), (0, 2, 0, 0, 40), (1, 3, 5, 5, 1)], "h bigint, src bigint, t0 bigint, t1 bigint, pk bigint")
    ports = spark.createDataFrame([(0, 1, 80, 1), (0, 1, 22, 1), (0, 2, 80, 4), (1, 3, 80, 1)], "h bigint, src bigint, port int, n bigint")
    got = {tuple(r)[:3]: r.words for r in sentences.sentences(hours, ports, 1, 9, 5, 4).collect()}
    assert got == {(0, 0, 0): [1, 1, 1, 1], (0, 0, 1): [2] * 4, (0, 0, 2): [2], (1, 0, 0): [1] * 4}
    assert sentences.sentences(hours.limit(0), ports.limit(0)).count() == 0
