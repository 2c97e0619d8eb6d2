import math
import warnings

import numpy as np
import pytest

from veilframe import accounting as acc
from veilframe import audit, benchmarks
from veilframe.engine import Engine
from veilframe.errors import AggregationError, EngineError, InsufficientPrivacyBudgetError, InvalidPrivacyParametersError, PrivacyConstraintError, QueryParseError, UnsupportedQueryError, ValidationError
from veilframe.functions import mechanisms as m
from veilframe.functions.calibrate import gaussian_delta, gaussian_sigma, split
from veilframe.functions.noise import NoiseMode, gaussian
from veilframe.model import Aggregation, AggregationColumn, DPParams, sensitivity
from veilframe.plans.sql import Parser

SF = "/root/testdata/sf0.001"
UNITS = {(None, "ptbl"): "uid", (None, "other"): "uid"}
plain = lambda x, s: x


def parse(sql, strict=True, **o):
    return Parser(sql, UNITS, strict=strict, **o).parse()


TAIL = " SELECT k, COUNT(uid) AS n FROM q GROUP BY k"


@pytest.mark.parametrize("body", [
    "SELECT uid, a AS k FROM ptbl", "SELECT t.uid, p.a AS k FROM ptbl AS t LEFT JOIN pub AS p ON t.x < p.y", "SELECT t.uid, o.a AS k FROM ptbl AS t JOIN other AS o ON t.uid = o.uid AND t.b = o.b",
    "SELECT uid, a AS k FROM ptbl UNION SELECT uid, b AS k FROM other", "SELECT /*+ REPARTITION(3) */ uid, CASE a WHEN 1 THEN x'FF' ELSE NULL END AS k FROM ptbl WHERE a IN () OR NOT b IS NULL",
    "SELECT uid, SUM(a) OVER (PARTITION BY uid ORDER BY b DESC ROWS 2 PRECEDING) AS k FROM ptbl", "SELECT uid, COUNT(a) AS k FROM ptbl GROUP BY uid HAVING COUNT(a) > 1",
])
def test_accepted(body):
    q = parse(f"WITH q AS ({body}){TAIL}")
    assert q.keys == ["k"] and q.aggregates[0].name == "n" and q.unit.lower() == "uid"


@pytest.mark.parametrize(("sql", "error"), [
    ("", QueryParseError), ("SELECT 5 -- 3", QueryParseError), ("SELECT COUNT(*) FROM pub", PrivacyConstraintError),
    (f"WITH q AS (SELECT a AS k FROM ptbl){TAIL}", PrivacyConstraintError), (f"WITH q AS (SELECT uid, uid AS k FROM ptbl){TAIL}", PrivacyConstraintError),
    (f"WITH q AS (SELECT uid, hash(uid) AS k FROM ptbl){TAIL}", PrivacyConstraintError), (f"WITH q AS (SELECT * FROM ptbl){TAIL}", QueryParseError), (f"WITH q AS (SELECT uid, 5 AS k FROM ptbl){TAIL}", QueryParseError),
    (f"WITH q AS (SELECT a.uid, b.x AS k FROM ptbl AS a JOIN ptbl AS b ON a.uid = b.uid){TAIL}", PrivacyConstraintError), (f"WITH q AS (SELECT a.uid, b.x AS k FROM ptbl AS a JOIN other AS b ON a.x = b.x){TAIL}", PrivacyConstraintError),
    (f"WITH q AS (SELECT a.uid, b.x AS k FROM ptbl AS a JOIN other AS b ON a.uid > b.uid){TAIL}", QueryParseError), (f"WITH q AS (SELECT uid, x AS k FROM ptbl AS a JOIN pub AS b ON a.x = b.x){TAIL}", QueryParseError),
    (f"WITH q AS (SELECT uid, a AS k FROM ptbl UNION ALL SELECT uid, a AS k FROM pub){TAIL}", PrivacyConstraintError), (f"WITH q AS (SELECT uid, a AS k FROM ptbl UNION ALL SELECT a AS k, uid FROM other){TAIL}", PrivacyConstraintError),
    (f"WITH q AS (SELECT uid, SUM(a) OVER () AS k FROM ptbl){TAIL}", PrivacyConstraintError), (f"WITH q AS (SELECT uid, AVG(a) AS k FROM ptbl GROUP BY a){TAIL}", PrivacyConstraintError),
    (f"WITH q AS (SELECT uid, a MATCH 'x' AS k FROM ptbl){TAIL}", UnsupportedQueryError), (f"WITH q AS (SELECT uid, c AS k FROM ptbl LATERAL VIEW EXPLODE(a) AS c){TAIL}", UnsupportedQueryError),
    ("SELECT uid, COUNT(*) FROM ptbl GROUP BY uid", PrivacyConstraintError), ("SELECT SUM(uid, 0, 1) FROM ptbl", PrivacyConstraintError), ("SELECT a, COUNT(*) FROM ptbl", ValidationError), ("SELECT COUNT(*) FROM ptbl GROUP BY a", ValidationError),
    ("SELECT * FROM ptbl", ValidationError), ("SELECT SUM(DISTINCT a, 0, 1) FROM ptbl", AggregationError), ("SELECT COUNT(DISTINCT a, b) FROM ptbl", ValidationError), ("SELECT a AS z, COUNT(*) FROM ptbl GROUP BY a", ValidationError),
    ("SELECT SUM(a, 0, 1), SUM(a, 0, 9) FROM ptbl", ValidationError), ("SELECT a, COUNT(*) AS n FROM ptbl GROUP BY a ORDER BY z", ValidationError), ("SELECT PRIVATE_QUERY OPTIONS (MIN_FREQUENCY = 3) COUNT(*) FROM ptbl", UnsupportedQueryError),
    ("SELECT PRIVATE_QUERY OPTIONS (EPSILON = 1, DELTA = 0.1, CONTRIBUTION_BOUND = 1.0) COUNT(*) FROM ptbl", ValidationError), ("ALTER PRIVATE_TABLE ptbl OPTIONS (PRIVACY_UNIT_COLUMN = x); SELECT COUNT(*) FROM ptbl", ValidationError),
])
def test_rejected(sql, error):
    with pytest.raises(error):
        parse(sql)


def test_rewrites():
    q = parse(f"WITH q AS MATERIALIZED (SELECT uid, CAST(a AS TEXT) AS k FROM ptbl WHERE a GLOB 'x*' && b = 'it\\x'){TAIL}")
    assert "RLIKE '^x.*\\u0024'" in q.inner_sql and " AND " in q.inner_sql and "STRING" in q.inner_sql and "'it\\\\x'" in q.inner_sql


def test_calibration_and_sensitivity():
    for e, d, k, count, sigma, thr, tau, at in [(1, 1e-5, 1, 1, 7.351149, 7.661109, 35.971337, 1), (0.5, 5e-5, 1, 2, 18.500360, 19.540567, 94.130412, 10), (1, 1e-5, 2, 4, 36.418375, 37.977600, 190.772686, 5)]:
        sigmas, t, s = split([float(k)] * count, DPParams(k, [None] * count, at, e, d), e, d)
        assert np.allclose([sigmas[0], s, t], [sigma, thr, tau], rtol=1e-6)
    assert gaussian_delta(gaussian_sigma(1.0, 1e-6, 3.0), 1.0, 3.0) == pytest.approx(1e-6, rel=1e-6)
    clip = ((-10, 10),)
    assert [sensitivity(a, 2, clip) for a in (Aggregation.COUNT, Aggregation.SUM, Aggregation.AVG)] == [2, 20, 40]


def test_mechanisms_without_noise():
    assert m.private_avg(10, 50, -10, 10, 0, plain) == pytest.approx(5)
    assert m.private_var(10, 50, 300, -10, 10, 0, plain, False) == pytest.approx(5)
    assert m.private_stddev(10, 50, 300, -10, 10, 0, plain, True) == pytest.approx(math.sqrt(50 / 9))
    assert m.private_covar(10, 50, 80, 450, (-10, 10), (-10, 10), 0, plain, True) == pytest.approx(50 / 9)


def test_noise():
    assert gaussian(3, 0) == 3 and gaussian(1, 2, NoiseMode.DEBUG) == 1 + 2 * 0.9417154046806644
    draws = np.array([gaussian(5, 2) for _ in range(1500)])
    assert abs(draws.mean() - 5) < 0.25 and abs(draws.std() - 2) < 0.2
    with pytest.raises(ValueError):
        gaussian(math.nan, 1)


def preset(**o):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return DPParams(**({"contribution_bound": 2, "clipping_thresholds": [None], "sigmas": [3.0], "tau": 1, "sigma_for_thresholding": 1.0} | o))


def test_accountants():
    assert acc.zcdp_cost([3.0], [3.0], 1, 1.0, preset()) == pytest.approx((2.5, 0.75))
    assert acc.minimum_epsilon(0.5, 0.05, 0.1) == pytest.approx(0.5 + math.sqrt(2 * math.log(20)))
    assert math.isinf(acc.minimum_epsilon(0.5, 0.2, 0.1))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        basic = acc.BasicAccountant(1.00001, 0.1)
    assert [basic.remaining_queries(*x) for x in [(0.1, 0.01), (0.2, 0.01), (0.1, 0.05)]] == [10, 5, 2]
    loss = acc.PrivacyLoss.gaussian(2.0, 1.0, 1e-3)
    for e in (0.1, 0.5, 1.0):
        assert gaussian_delta(2.0, e, 1.0) <= loss.delta(e) <= gaussian_delta(2.0, e, 1.0) + 2e-3
    two = loss.then(loss)
    assert two.delta(0.5) == pytest.approx(gaussian_delta(2.0 / math.sqrt(2), 0.5, 1.0), abs=3e-3)
    assert acc.PLDAccountant(1.0, 1e-5, 1e-3).remaining_queries(0.1, 1e-6) >= 10
    aggs = [AggregationColumn(Aggregation.COUNT, ("*",))] * 10
    base = DPParams(1, [None] * 10, 1, 1.0, 1e-5)
    better = DPParams(1, [None] * 10, 1, 1.0, 1e-5, accountant_class=acc.RenyiAccountant)
    from veilframe.functions.calibrate import noise_parameters

    assert noise_parameters(aggs, better)[0][0] * 2 <= noise_parameters(aggs, base)[0][0]


@pytest.mark.parametrize("o", [{"contribution_bound": 0}, {"min_frequency": 0}, {"epsilon": 0, "delta": 0.1}, {"epsilon": 1}, {"epsilon": 1, "delta": 0.1, "sigmas": [1]}])
def test_bad_parameters(o):
    with pytest.raises(InvalidPrivacyParametersError):
        DPParams(**({"contribution_bound": 1, "clipping_thresholds": [None]} | o))


def test_audit():
    assert audit.calculate_hockey_stick_divergence((0.1, 0.2, 0.3, 0.4), (0.2, 0.3, 0.4, 0.1), math.log(2)) == pytest.approx(0.2)


def test_engine(spark):
    spark.createDataFrame([(i, i % 5 if i % 7 else None, float(i % 3) if i % 2 else None) for i in range(1, 1001)], "uid int, k int, x double").createOrReplaceTempView("ptbl")
    own = Engine(spark, acc.RenyiAccountant(1.0, 1.0))
    with pytest.raises(EngineError):
        own.register_database(None, {"nope": "uid"})
    own.register_database(None, {"ptbl": "uid"})
    out = own.execute_query("SELECT k, COUNT(*) AS n, SUM(x) AS s FROM ptbl GROUP BY k", preset(clipping_thresholds=[None, ((1, 5),)], sigmas=[0, 0], sigma_for_thresholding=0, contribution_bound=5)).collect()
    assert len(out) == 6 and sum(r.n for r in out) == 1000  # the NULL key is a key
    want = spark.sql("SELECT sum(CASE WHEN x IS NOT NULL THEN greatest(1, x) END) s FROM ptbl").first()[0]
    assert sum(r.s for r in out) == pytest.approx(want)
    tight = Engine(spark, acc.RenyiAccountant(0.5, 1e-6))
    tight.register_database(None, {"PTBL": "UID"})
    with pytest.raises(InsufficientPrivacyBudgetError):
        tight.execute_query("SELECT PRIVATE_QUERY OPTIONS (EPSILON = 3.0, DELTA = 0.00001, CONTRIBUTION_BOUND = 1) COUNT(*) AS n FROM ptbl")
    ok = tight.execute_query("SELECT PRIVATE_QUERY OPTIONS (EPSILON = 0.4, DELTA = 0.0000005, CONTRIBUTION_BOUND = 1) COUNT(*) AS n FROM ptbl")
    assert ok.collect() == ok.collect() and tight.accountant.spent_epsilon == 0.4  # drawn once, charged once


@pytest.mark.parametrize("name", sorted(benchmarks.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in benchmarks.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = benchmarks.QUERIES[name](spark, SF)
    cols = ", ".join(f'"{c}"' for c in out.columns)
    want = con.execute(f"SELECT {cols} FROM ({benchmarks.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple(str(round(x, 4) if isinstance(x, float) else x) for x in r)
    assert sorted(map(key, map(tuple, out.collect()))) == sorted(map(key, want))


def test_remaining_queries_beyond_a_thousand():
    from veilframe.functions.calibrate import gaussian_sigma

    ledger = acc.PLDAccountant(1.0, 1e-5, 1e-4)
    n = ledger.remaining_queries(0.004, 1e-7)
    sigma = gaussian_sigma(0.004, 1e-7, 1.0)
    assert n > 1000 and gaussian_delta(sigma / math.sqrt(n), 1.0, 1.0) <= 1e-5
    few, one = acc.PLDAccountant(1.0, 1e-5, 1e-3), acc.PrivacyLoss.gaussian(gaussian_sigma(0.1, 1e-6, 1.0), 1.0, 1e-3)
    loss, steps = one, 0
    while loss.epsilon(1e-5) <= 1.0:
        loss, steps = loss.then(one), steps + 1
    assert few._remaining(0.1, 1e-6) == steps


# shapes of queries that the language has, and of those that it refuses
PUBLIC = "WITH p AS (SELECT h FROM pub {}), q AS (SELECT /*+ REPARTITION(3), MERGE(t1, t2) */ ptbl.uid, other.a AS k FROM ptbl JOIN other USING (uid)) SELECT k, COUNT(k) AS n FROM q AS t GROUP BY t.k"


@pytest.mark.parametrize("reshape", [
    "PIVOT (SUM(x) AS a, AVG(y) AS c FOR z IN ('J' AS j, 'M' AS m))", "PIVOT (SUM(x) FOR (z, w) IN (('J', 30) AS c1, ('M', -4) AS c2))", "UNPIVOT EXCLUDE NULLS ((f, s) FOR half IN ((q1, q2) AS H1, (q3, q4) AS H2))",
    "UNPIVOT INCLUDE NULLS (v FOR quarter IN (q1 AS Q1, q2)) AS up", "LATERAL VIEW EXPLODE(ARRAY(30, 60)) t AS c LATERAL VIEW OUTER EXPLODE(ARRAY(4)) AS d", "PIVOT (SUM(x) FOR z IN (1)) UNPIVOT (v FOR c IN (a, b)) LATERAL VIEW EXPLODE(ARRAY(1)) AS d",
])
def test_reshaping_public_tables(reshape):
    assert reshape.split(" ")[0] in parse(PUBLIC.format(reshape)).inner_sql
    with pytest.raises(UnsupportedQueryError):
        parse(f"WITH q AS (SELECT uid, a AS k FROM ptbl {reshape}){TAIL}")


@pytest.mark.parametrize("reshape", [
    "LATERAL VIEW EXPLODE(ARRAY((SELECT MAX(x) FROM ptbl))) AS c", "LATERAL VIEW c AS d", "PIVOT (SUM(x) FOR z IN (SELECT x FROM ptbl))", "PIVOT (MAX((SELECT x FROM ptbl)) FOR z IN (1))", "PIVOT (SUM(x) FOR z IN (a))",
    "UNPIVOT (v FOR c IN (a)) UNION ALL SELECT x FROM ptbl", "PIVOT (SUM(x) FOR z IN (1)",
])
def test_reshaping_is_parsed(reshape):
    with pytest.raises((QueryParseError, PrivacyConstraintError)):
        parse(PUBLIC.format(reshape))


@pytest.mark.parametrize("hint", ["REPARTITION(3) /* x", "A -- ", "A(B(c))", "A('b')", "", "A;"])
def test_hints_are_parsed(hint):
    with pytest.raises(QueryParseError):
        parse(f"WITH q AS (SELECT /*+ {hint} */ uid, a AS k FROM ptbl){TAIL}")


@pytest.mark.parametrize("sql", ["SELECT uid FROM pub", "SELECT * FROM pub", "SELECT SUM(*), uid FROM pub", "select a, b, sum(*), count(distinct uid), avg(*), avg(uid), uid from pub", "SELECT uid FROM pub GROUP BY uid", "SELECT * FROM pub GROUP BY a", "SELECT a, SUM(*) AS b, uid FROM pub GROUP BY a ORDER BY z LIMIT 3"])
def test_parsing_alone_accepts_public_queries(sql):
    assert Parser(f"ALTER PRIVATE_TABLE t OPTIONS (PRIVACY_UNIT_COLUMN = uid); {sql};", private_mode=False).parse()


@pytest.mark.parametrize(("sql", "error"), [
    (f"WITH q AS (SELECT a.uid, b.x AS k FROM ptbl AS a JOIN other AS b ON a.uid = b.uid OR a.x = b.x){TAIL}", QueryParseError), (f"WITH q AS (SELECT a.uid, b.x AS k FROM ptbl AS a JOIN other AS b ON a.uid = b.uid = a.x){TAIL}", QueryParseError),
    (f"WITH q AS (SELECT a.uid, b.x AS k FROM ptbl AS a JOIN other AS b ON a.uid AND b.uid){TAIL}", QueryParseError), (f"WITH q AS (SELECT a.uid, b.x AS k FROM ptbl AS a CROSS JOIN other AS b USING (uid)){TAIL}", PrivacyConstraintError),
    (f"WITH q AS (SELECT uid, RANK() OVER w AS k FROM ptbl){TAIL}", QueryParseError), (f"WITH q AS (SELECT uid, SUM(a) OVER (PARTITION BY uid ORDER BY b GROUPS 1 PRECEDING) AS k FROM ptbl){TAIL}", UnsupportedQueryError),
    (f"WITH q AS (SELECT uid, SUM(a) OVER (PARTITION BY uid ORDER BY b ROWS 1 PRECEDING EXCLUDE TIES) AS k FROM ptbl){TAIL}", UnsupportedQueryError), (f"WITH q AS (SELECT uid, SUM(a) OVER (PARTITION BY uid ORDER BY b + 1) AS k FROM ptbl){TAIL}", QueryParseError),
    (f"WITH q AS (SELECT uid, COUNT(a) AS k FROM ptbl GROUP BY ROLLUP(uid)){TAIL}", PrivacyConstraintError), (f"WITH q AS (SELECT uid, reflect('java.lang.System', 'lineSeparator') AS k FROM ptbl){TAIL}", UnsupportedQueryError),
    ("ALTER PRIVATE_TABLE t OPTIONS (PRIVACY_UNIT_COLUMN = z.u); SELECT COUNT(*) FROM t", ValidationError), ("SELECT uid FROM ptbl", ValidationError), ("SELECT a FROM ptbl", ValidationError),
])
def test_kinds_of_refusals(sql, error):
    with pytest.raises(error):
        parse(sql)


def test_alter_private_table():
    q = Parser("ALTER PRIVATE_TABLE db.t OPTIONS (PRIVACY_UNIT_COLUMN = t.u); SELECT COUNT(u) AS n FROM db.t").parse()
    assert q.unit == "u" and q.units == {("db", "t"): "u"}


def test_no_text_of_the_caller_becomes_sql(spark):
    spark.createDataFrame([(1, 10), (1, 11), (2, 77)], "uid int, x int").createOrReplaceTempView("ptbl")
    own = Engine(spark, acc.RenyiAccountant(1.0, 1.0))
    own.register_database(None, {"ptbl": "uid"})
    run = lambda sql: own.execute_query(sql, preset(sigmas=[0], sigma_for_thresholding=0, contribution_bound=1)).collect()
    smuggled = "\n AS k FROM ptbl UNION ALL SELECT monotonically_increasing_id() AS uid, 1 AS k FROM ptbl) SELECT * FROM q -- "
    for one in (f"- -1 + LENGTH('{smuggled}')", f"'{smuggled}'", "'${spark.app.name}'", "'--'", "- - -1", "'/*'"):
        rows = run(f"WITH q AS (SELECT uid, {one} AS k, x FROM ptbl WHERE x > 0) SELECT COUNT(uid) AS n FROM q".replace(f"{one} AS k, ", f"CASE WHEN x > 5 THEN {one} ELSE {one} END AS k, "))
        assert [r.n for r in rows] == [2.0]  # one row a person
    got = run("WITH q AS (SELECT uid, CASE WHEN x > 0 THEN '${spark.app.name}' ELSE '' END AS k FROM ptbl) SELECT k, COUNT(uid) AS n FROM q GROUP BY k")
    assert [r.k for r in got] == ["${spark.app.name}"]


def test_rendered_queries_are_checked_again(spark):
    from veilframe.plans.guard import check_relations, check_text

    for bad in ("SELECT (--1", "SELECT 1 /* x */", "SELECT '${a}'", "SELECT 1; SELECT 2", "SELECT `a`", "SELECT 'a", "SELECT 1\n", 'SELECT "a"'):
        with pytest.raises(QueryParseError):
            check_text(bad)
    check_text("SELECT /*+ MERGE(a, b) */ '--' AS a, 'it\\'s /*' AS b FROM t")
    check_relations(spark, "WITH a AS (SELECT * FROM db.t AS x) SELECT * FROM a", ["db.T", "a"])
    for sql in ("SELECT (SELECT max(x) FROM t) FROM a", "SELECT * FROM a JOIN a", "SELECT * FROM b", "SELECT * FROM a LATERAL VIEW explode(array((SELECT 1 FROM t))) AS c"):
        with pytest.raises(PrivacyConstraintError):
            check_relations(spark, sql, ["a"])


def test_operators_bind_as_in_the_host(spark):
    import random

    r = random.Random(4)
    spark.createDataFrame([(1, 5, 12)], "uid int, a int, b int").createOrReplaceTempView("ptbl")
    for _ in range(25):
        text = "a"
        for _ in range(5):
            text += f" {r.choice(['|', '&', '^', '<<', '>>', '+', '-', '*'])} {r.choice(['', '', '~', '- '])}{r.choice(['a', 'b', '1', '3'])}"
        want = spark.sql(f"SELECT {text} AS k FROM ptbl").first()[0]
        q = parse(f"WITH q AS (SELECT uid, {text} AS k FROM ptbl) SELECT k, COUNT(uid) AS n FROM q GROUP BY k")
        assert spark.sql(q.inner_sql).first()["k"] == want, text


def test_units_beyond_the_group_limit(spark, monkeypatch):
    from pyspark.sql import functions as F

    from veilframe.operators import private

    rows = spark.range(9000).select(F.when(F.col("id") < 6000, F.lit(None)).otherwise(F.col("id") % 3).alias("uid"), "id")
    count = lambda df: {r.uid: r["count"] for r in df.groupBy("uid").count().collect()}
    want = {None: 1500, 0: 1000, 1: 1000, 2: 1000}
    assert count(private.bound_contributions(rows, "uid", 1500)) == want
    assert private.heavy_units(rows, "uid", 1500) == [None] and private.heavy_units(rows, "uid", 6000) == []
    assert count(private.bound_contributions(rows, "UID", 1500, [None])) == want and private.bound_contributions(rows, "uid", 6000, []).count() == 9000
    monkeypatch.setattr(private, "HEAVY_UNITS", 1)
    assert private.heavy_units(rows, "uid", 10) is None


def test_many_keys_are_drawn_once_by_tasks(spark, monkeypatch):
    from veilframe.plans import release

    spark.range(500).selectExpr("int(id) AS uid", "int(id % 50) AS k").createOrReplaceTempView("ptbl")
    own = Engine(spark, acc.RenyiAccountant(1.0, 1.0))
    own.register_database(None, {"ptbl": "uid"})
    for limit, first in ((10, 0), (10, 1 << 40), (100, 0)):
        monkeypatch.setattr(release, "DRIVER_KEYS", limit)
        monkeypatch.setattr(release, "WRITE_FIRST", first)
        out = own.execute_query("SELECT k, COUNT(*) AS n FROM ptbl GROUP BY k", preset(contribution_bound=1, sigmas=[1.0], sigma_for_thresholding=0))
        rows = out.collect()
        assert len(rows) == 50 and sorted(out.collect()) == sorted(rows) and any(x.n != 10 for x in rows)


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace as Stub

    from veilframe import storage
    from veilframe.errors import ExecutionBackendError

    def session(master, folder=None):
        return Stub(sparkContext=Stub(master=master, applicationId=f"app-{master}", getConf=lambda: Stub(get=lambda k, d: folder)))

    assert storage.shared_root(session("yarn", "hdfs://c/")) == "hdfs://c"
    local = session("local[4]")
    assert storage.shared_root(local) == storage.shared_root(local)
    with pytest.raises(ExecutionBackendError):
        storage.shared_root(session("spark://somewhere:7077"))
    own = session("yarn", f"file://{tmp_path}")
    kept = tmp_path / "veilframe-app-yarn" / "x"
    kept.mkdir(parents=True)
    assert storage.session_folder(own).endswith("/veilframe-app-yarn")
    storage.clear(own)
    assert not kept.exists() and tmp_path.exists()


def test_parameters_come_from_one_place(spark):
    spark.createDataFrame([(1, 10)], "uid int, x int").createOrReplaceTempView("ptbl")
    own = Engine(spark, acc.RenyiAccountant(1.0, 1.0))
    own.register_database(None, {"ptbl": "uid"})
    option = "PRIVATE_QUERY OPTIONS (EPSILON = 1, DELTA = 0.1, CONTRIBUTION_BOUND = 1) "
    for sql, params in (("SELECT COUNT(*) AS n FROM ptbl", None), (f"SELECT {option}COUNT(*) AS n FROM ptbl", preset())):
        with pytest.raises(InvalidPrivacyParametersError):
            own.execute_query(sql, params)
    with pytest.raises(InvalidPrivacyParametersError):  # one threshold for two aggregates
        own.execute_query("SELECT COUNT(*) AS n, COUNT(x) AS m FROM ptbl", preset())
    with pytest.raises(ValidationError):
        own.execute_query("SELECT COUNT(*) AS n FROM ptbl", preset(), "db.view")
    assert own.get_db_schema()["ptbl"] == ["uid", "x"] and "ptbl" in own.db_schema[None]


def test_audit_of_a_gaussian():
    class Gauss(audit.Mechanism):
        sigma = gaussian_sigma(0.1, 0.01, 1.0)

        def draw(self, value, n):
            return np.random.default_rng(int(value)).normal(value, self.sigma, n)

    assert audit.estimate_hockey_stick_divergence(Gauss(), (0.0, 1.0), 0.1, 10, 1_000_000) <= 0.01 + 1e-3
