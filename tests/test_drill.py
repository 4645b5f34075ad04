"""Drill-downs against plain Python."""

import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from conftest import DATA
from joblattice.operators import drill, stats
from joblattice.plans import QUERIES

AS_OF = date(2024, 3, 31)


def test_peers_by_plain_python(spark):
    rng = random.Random(2)
    sizes = rng.sample(range(10_000), 120)
    rows = [(i, rng.choice("ab"), rng.choice(["x", "y", f"own{i}"]), rng.choice("gh"), sizes[i]) for i in range(120)]
    got = {}
    for r in sorted(drill.peers(spark.createDataFrame(rows, "id long, country string, sector string, grp string, headcount long"), k=3).collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append((r.peer, r.tier))
    for i, country, sector, grp, size in rows:
        pool, tier = [r for r in rows if r[0] != i and r[1] == country and r[2] == sector], "sector"
        if not pool:
            pool, tier = [r for r in rows if r[0] != i and r[1] == country and r[3] == grp], "group"
        assert got.get(i, []) == [(r[0], tier) for r in sorted(pool, key=lambda r: (abs(r[4] - size), r[0]))[:3]]


def test_scope_pay_by_numpy(spark):
    rng = random.Random(4)
    rows = [(s, rng.choice([(float(rng.randrange(50, 60)), c), (float(rng.randrange(50, 90)), "AUD"), None])) for s, c, n in (("a", "SGD", 90), ("b", "CNY", 200), ("few", "AUD", 12)) for _ in range(n)]
    got = {r.scope: r for r in drill.scope_pay(spark.createDataFrame(rows, "scope string, pay struct<annual: double, currency: string>")).collect()}
    assert set(got) == {"a", "b"}
    for s, r in got.items():
        of = {}
        for scope, pay in rows:
            if scope == s and pay:
                of.setdefault(pay[1], []).append(pay[0])
        currency, values = min(of.items(), key=lambda x: (-len(x[1]), x[0]))
        assert (r.currency, r.n, r.live) == (currency, len(values), sum(x[0] == s for x in rows))
        assert np.allclose([r.p25, r.p50, r.p75], np.quantile(values, [0.25, 0.5, 0.75]))


def test_durations_need_forty_advertisements(spark):
    schema = "job_key string, skills array<string>, last_seen date, days_since_posted int"
    rows = [(f"k{i}", ["a"] if i % 2 else ["a", "b"], AS_OF - timedelta(1 + i), i) for i in range(40)]
    rows += [("open", ["a"], AS_OF, 999), ("unposted", ["a"], AS_OF - timedelta(1), None), ("odd", ["a"], AS_OF - timedelta(1), -4)]
    df = spark.createDataFrame(rows, schema)
    assert {(r.skill, r.days, r.n, r.place) for r in drill.ad_durations(df, AS_OF).collect()} == {(None, 20, 40, 0), ("a", 20, 40, 1), ("b", 19, 20, 2)}
    assert drill.ad_durations(df.where("job_key <> 'k3'"), AS_OF).count() == 0


def test_employer_movers(spark):
    day = lambda n: AS_OF - timedelta(n)
    rows = [(1, ["a", "a", "b"], day(5), day(0)), (1, ["b"], day(50), day(40)), (1, ["c"], day(50), day(30)), (None, ["a"], day(1), day(0)), (2, ["a"], day(1), day(0))]
    got = drill.employer_movers(spark.createDataFrame(rows, "company_id long, skills array<string>, first_seen date, last_seen date"), AS_OF).collect()
    assert {(r.company_id, r.skill, r.now_n, r.prev_n, r.pct, r.dir, r.place) for r in got} == {(1, "a", 1, 0, 100, "up", 1), (2, "a", 1, 0, 100, "up", 1)}
    assert got[0].series == [0] * 12 + [1] and drill.employer_movers(spark.createDataFrame([], "company_id long, skills array<string>, first_seen date, last_seen date"), AS_OF).select(F.count("*")).first()[0] == 0


def test_places_over_all_rows_are_not_given_in_one_task(spark):
    """Places in order, nulls last; the only window over everything is over the buckets' counts."""
    rng = random.Random(4)
    rows = [(i, None if i % 17 == 0 else rng.randrange(-500, 500) / 100) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v double")
    out = stats.placed(df, F.floor("v"), "v", "k")
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert [(r.k, r.v) for r in sorted(out.collect(), key=lambda r: r.nth)] == want and sorted(r.nth for r in out.collect()) == list(range(1, 301))
    plan = QUERIES["peers_with_fallback"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_bucket" in plan and "row_number() windowspecdefinition(c_acctbal" not in plan
