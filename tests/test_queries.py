"""Every query that has an oracle gives the oracle's rows."""

import math

import duckdb
import pytest

from tidewatch.plans import queries as plans
from tidewatch.plans import robust, study, views  # noqa: F401  they register their queries

SF = "/root/testdata/sf0.01"
#: Run in tests/test_study.py, with what they should say.
ELSEWHERE = {"study_decisions_modes", "study_stages", "study_resampled_decisions"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "nation customer part lineitem events documents embeddings labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, float) else str(v)
    return sorted((tuple(clean(r[i]) for i in order) for r in values), key=str)


def test_no_event_is_left_out(spark, con):
    n = con.sql("select count(*) from events").fetchall()[0][0]
    assert plans.QUERIES["reduce_hourly_all"](spark, SF).agg({"nrec": "sum"}).first()[0] == n
    assert plans.QUERIES["profile_basic_weeks"](spark, SF).agg({"nrec": "sum"}).first()[0] == n


@pytest.mark.parametrize("name", ["profile_basic", "block_campaigns", "sliding_windows"])
def test_every_week_is_that_of_the_sql(spark, con, name):
    df = plans.QUERIES[f"{name}_weeks"](spark, SF).cache()
    weeks = sorted(r.week for r in df.select("week").distinct().collect())
    assert weeks == [0, 1, 2, 3, 4]
    for k in weeks:
        got, want = df.filter(f"week = {k}").drop("week"), con.sql(plans.ORACLES[name].replace("473352", str(473352 + 168 * k)))
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
    df.unpersist()


def test_bursts_whose_tail_is_too_small_for_a_double(spark, tmp_path):
    """Blocks of 5 to 300 sources that all begin in one hour, by port and machine: tails of all digits, of a few, and of none."""
    sizes = [5, 100, 300, *range(157, 174)]
    c, kinds = duckdb.connect(), ["click", "view", "purchase", "signup", "error"]
    users = [(4 * (1000 * (g // 4) + i) + g % 4, kinds[g // 4], 5 + g) for g, n in enumerate(sizes) for i in range(n)]
    c.execute("create table u (id bigint, kind varchar, h integer)")
    c.execute(f"insert into u values {', '.join(map(str, users))}")
    c.sql(f"copy (select id as event_id, timestamp '2024-01-01' + to_hours(h) + to_seconds(id % 3600) as ts, id as user_id, kind as event_type, 20.0::double as value, '{{\"k\": ' || id % 100 || '}}' as props from u) to '{tmp_path}/events.parquet'")
    c.sql(f"copy (select id as c_custkey, 'c' as c_name, (id % 25)::integer as c_nationkey, 0.0::double as c_acctbal, 'BUILDING' as c_mktsegment from u) to '{tmp_path}/customer.parquet'")
    c.sql(f"copy (from '{SF}/nation.parquet') to '{tmp_path}/nation.parquet'")
    for t in "events customer nation".split():
        c.sql(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    df = plans.QUERIES["study_bursts"](spark, str(tmp_path))
    got, want = df.collect(), c.sql(plans.ORACLES["study_bursts"])
    tails = {r.k: r.ln_p for r in got}
    assert set(sizes) <= set(tails) and tails[300] == -math.inf and -math.inf < tails[166] < -708.4
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


@pytest.fixture(scope="module", autouse=True)
def shared_steps():
    study.KEPT, plans.KEPT = {}, {}
    yield
    study.KEPT = plans.KEPT = None


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - ELSEWHERE))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in plans.ORACLES:
        want = con.sql(plans.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    spark.catalog.clearCache()
