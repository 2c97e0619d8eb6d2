"""Queries of the engine with the same meaning in SQL.

Noise is off (scale 0, an unlimited budget) and the bound of rows a unit does
not bind, so that every release equals plain SQL; ``noisy_debug_count`` adds
the fixed debug deviate.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .accounting import RenyiAccountant
from .engine import Engine
from .functions.noise import DEBUG_DEVIATE, NoiseMode
from .model import DPParams
from .sources.catalog import load_views

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
UNITS = {"orders": "o_custkey", "customer": "c_custkey", "events": "user_id", "lineitem": "l_orderkey"}
K = 1000


@dataclass(frozen=True)
class Case:
    sql: str
    oracle: str
    clips: tuple = (None,)
    min_frequency: int = 1
    digits: int | None = None
    sigma: float = 0.0
    k: int = K
    budget: tuple[float, float] | None = None  # with debug noise


def engine(spark: SparkSession, sf_dir: str, mode: NoiseMode = NoiseMode.SECURE, sql: str = "", budget: tuple[float, float] = (1.0, 1.0)) -> Engine:
    """An engine over the tables that the query names (all, if none is given)."""
    named = set(re.findall(r"\w+", sql)) & set(TABLES) or set(TABLES)
    load_views(spark, sf_dir, sorted(named))
    own = Engine(spark, RenyiAccountant(*budget), mode)
    own.register_database(None, {t: u for t, u in UNITS.items() if t in named})
    return own


def run(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = engine(spark, sf_dir, NoiseMode.DEBUG if case.sigma or case.budget else NoiseMode.SECURE, case.sql, case.budget or (1.0, 1.0))
        params = None
        if "PRIVATE_QUERY" not in case.sql:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", DeprecationWarning)
                params = DPParams(case.k, list(case.clips), case.min_frequency, sigmas=[case.sigma] * len(case.clips), tau=case.min_frequency, sigma_for_thresholding=0.0)
        out = own.execute_query(case.sql, params)
        if case.digits is not None:
            out = out.select(*[F.round(c, case.digits).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
        return out

    return query


def _clip(x: str, low: float, high: float) -> str:
    return f"least({high}, greatest({low}, {x}))::DOUBLE"


_Q, _D, _V, _P = _clip("l_quantity", 5, 40), _clip("l_discount", 0.0, 0.08), _clip("value", 10, 300), _clip("o_totalprice", 0, 200000)
_LINES = "WITH q AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem) "


def _grouped(agg: str, oracle: str, clips: tuple, digits: int = 4) -> Case:
    return Case(f"{_LINES}SELECT l_returnflag, {agg} AS r FROM q GROUP BY l_returnflag", f"SELECT l_returnflag, round({oracle}, {digits}) AS r FROM lineitem GROUP BY l_returnflag", (clips,), digits=digits)


def _counted(cte: str, key: str = "k", oracle: str | None = None) -> Case:
    """Rows of each key of the CTE q (its unit is u)."""
    return Case(f"WITH {cte} SELECT {key}, COUNT(u) AS n FROM q GROUP BY {key}", f"WITH {oracle or cte} SELECT {key}, count(u)::DOUBLE AS n FROM q GROUP BY {key} HAVING count(DISTINCT u) >= 1")


_O = "o_custkey AS u, o_orderpriority AS k"
CASES: dict[str, Case] = {
    "count_star_by_priority": Case("SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*)::DOUBLE AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 5", min_frequency=5),
    "count_col": Case("SELECT c_mktsegment, COUNT(c_acctbal) AS n FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, count(c_acctbal)::DOUBLE AS n FROM customer GROUP BY 1"),
    "count_distinct_by_type": Case("SELECT event_type, COUNT(DISTINCT user_id) AS n FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id)::DOUBLE AS n FROM events GROUP BY 1"),
    "sum_clipped": _grouped("SUM(l_quantity)", f"sum({_Q})", ((5, 40),), 2),
    "avg_clipped": _grouped("AVG(l_quantity)", f"avg({_Q})", ((5, 40),)),
    "avg_price": Case("SELECT o_orderstatus, AVG(o_totalprice) AS r FROM orders GROUP BY o_orderstatus", f"SELECT o_orderstatus, round(avg({_P}), 4) AS r FROM orders GROUP BY 1", (((0, 200000),),), digits=4),
    "global_count": Case("SELECT COUNT(*) AS n FROM events", "SELECT count(*)::DOUBLE AS n FROM events"),
    "global_avg": Case("SELECT AVG(value) AS r FROM events", f"SELECT round(avg({_V}), 4) AS r FROM events", (((10, 300),),), digits=4),
    "multi_key_group": Case(f"{_LINES}SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM q GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2"),
    "multi_agg_single_pass": Case("SELECT event_type, COUNT(*) AS n, SUM(value) AS s, AVG(value) AS a, VAR_POP(value) AS v, STDDEV(value) AS d FROM events GROUP BY event_type", f"SELECT event_type, count(*)::DOUBLE AS n, round(sum({_V}), 4) AS s, round(avg({_V}), 4) AS a, round(var_pop({_V}), 4) AS v, round(stddev_samp({_V}), 4) AS d FROM events GROUP BY 1", (None, *[((10, 300),)] * 4), digits=4),
    "min_frequency_filter": Case("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, count(*)::DOUBLE AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) >= 60", min_frequency=60),
    "min_frequency_empty": Case("SELECT event_type, AVG(value) AS r FROM events GROUP BY event_type", "SELECT event_type, avg(value) AS r FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 100000000", (((10, 300),),), min_frequency=100_000_000),
    "null_key_group": _counted("q AS (SELECT o_custkey AS u, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS k FROM orders)"),
    "null_value_skip": Case("WITH q AS (SELECT user_id, event_type, CASE WHEN value > 200 THEN NULL ELSE value END AS x FROM events) SELECT event_type, SUM(x) AS s, AVG(x) AS a FROM q GROUP BY event_type", f"SELECT event_type, round(sum(CASE WHEN value <= 200 THEN {_clip('value', 50, 150)} END), 4) AS s, round(avg(CASE WHEN value <= 200 THEN {_clip('value', 50, 150)} END), 4) AS a FROM events GROUP BY 1", (((50, 150),),) * 2, digits=4),
    "cte_filter": _counted(f"q AS (SELECT {_O} FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F')"),
    "cte_nested": _counted("p AS (SELECT o_custkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 5e4), q AS (SELECT o_custkey AS u, o_orderpriority AS k FROM p WHERE o_totalprice < 200000)"),
    "cte_materialized": _counted(f"q AS NOT MATERIALIZED (SELECT {_O} FROM orders)"),
    "cte_distinct": _counted(f"q AS (SELECT DISTINCT {_O} FROM orders)"),
    "cte_groupby_having": _counted(f"q AS (SELECT {_O} FROM orders GROUP BY o_custkey, o_orderpriority HAVING COUNT(o_orderkey) > 1)"),
    "cte_case_cast": _counted("q AS (SELECT o_custkey AS u, CASE WHEN CAST(o_totalprice AS INTEGER) > 150000 THEN 'high' ELSE 'low' END AS k FROM orders)"),
    "cte_like_regexp": _counted(f"q AS (SELECT {_O} FROM orders WHERE o_orderpriority LIKE '%-%I%' OR o_orderpriority REGEXP '^[12]')", oracle=f"q AS (SELECT {_O} FROM orders WHERE o_orderpriority LIKE '%-%I%' OR regexp_matches(o_orderpriority, '^[12]'))"),
    "cte_glob": _counted(f"q AS (SELECT {_O} FROM orders WHERE o_orderpriority GLOB '[1-3]-*')"),
    "cte_in_between": _counted(f"q AS (SELECT {_O} FROM orders WHERE o_orderstatus IN ('O', 'P') && o_totalprice BETWEEN 20000 AND 250000 AND o_custkey NOT IN ())", oracle=f"q AS (SELECT {_O} FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice BETWEEN 20000 AND 250000)"),
    "cte_arithmetic": _counted("q AS (SELECT user_id AS u, (event_id * 3 + 7) % 4 AS k FROM events WHERE event_id & 1 = 0 AND event_id << 1 > 8)", oracle="q AS (SELECT user_id AS u, (event_id * 3 + 7) % 4 AS k FROM events WHERE (event_id & 1) = 0 AND (event_id << 1) > 8)"),
    "cte_filter_agg": _counted("q AS (SELECT o_custkey AS u, COUNT(o_orderkey) FILTER (WHERE o_totalprice > 150000) AS k FROM orders GROUP BY o_custkey)"),
    "cte_string_funcs": _counted("q AS (SELECT o_custkey AS u, LOWER(SUBSTRING(o_orderpriority, 3, 4)) || '!' AS k FROM orders)"),
    "cte_date_funcs": _counted("q AS (SELECT o_custkey AS u, YEAR(o_orderdate) AS k FROM orders WHERE MONTH(o_orderdate) < 7)"),
    "cte_math_funcs": _counted("q AS (SELECT user_id AS u, FLOOR(SQRT(ABS(value))) AS k FROM events)", oracle="q AS (SELECT user_id AS u, FLOOR(SQRT(ABS(value)))::BIGINT AS k FROM events)"),
    "cte_conditional_funcs": _counted("q AS (SELECT user_id AS u, COALESCE(NULLIF(event_type, 'click'), 'none') AS k FROM events)"),
    "join_inner": _counted("q AS (SELECT o.o_custkey AS u, n.n_name AS k FROM orders AS o JOIN nation AS n ON o.o_orderkey % 25 = n.n_nationkey)"),
    "join_left": _counted("r AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10), q AS (SELECT c.c_custkey AS u, r.n_name AS k FROM customer AS c LEFT JOIN r ON c.c_nationkey = r.n_nationkey)"),
    "join_right": _counted("q AS (SELECT c.c_custkey AS u, n.n_name AS k FROM nation AS n RIGHT JOIN customer AS c ON c.c_nationkey = n.n_nationkey)"),
    "join_full": _counted("q AS (SELECT c.c_custkey AS u, n.n_name AS k FROM customer AS c FULL OUTER JOIN nation AS n ON c.c_nationkey = n.n_nationkey)"),
    "join_using": _counted("r AS (SELECT n_nationkey AS c_nationkey, n_name FROM nation), q AS (SELECT c.c_custkey AS u, r.n_name AS k FROM customer AS c INNER JOIN r USING (c_nationkey))"),
    "join_private_private": _counted("q AS (SELECT o.o_custkey AS u, c.c_mktsegment AS k FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey)"),
    "join_theta_public": _counted("q AS (SELECT c.c_custkey AS u, r.r_name AS k FROM customer AS c JOIN region AS r ON c.c_nationkey >= r.r_regionkey * 5 AND c.c_nationkey < r.r_regionkey * 5 + 3)"),
    "union": _counted(f"q AS (SELECT {_O} FROM orders WHERE o_orderstatus = 'O' UNION SELECT {_O} FROM orders WHERE o_totalprice > 100000)"),
    "union_all": _counted(f"q AS (SELECT {_O} FROM orders UNION ALL SELECT {_O} FROM orders)"),
    "intersect": _counted(f"q AS (SELECT {_O} FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT {_O} FROM orders WHERE o_orderstatus = 'F')"),
    "except": _counted(f"q AS (SELECT {_O} FROM orders EXCEPT SELECT {_O} FROM orders WHERE o_orderstatus = 'F')"),
    "public_explode": _counted("p AS (SELECT n_nationkey, c AS tag FROM nation LATERAL VIEW EXPLODE(ARRAY('a', 'b')) AS c), q AS (SELECT c.c_custkey AS u, p.tag AS k FROM customer AS c JOIN p ON c.c_nationkey = p.n_nationkey)", oracle="p AS (SELECT n_nationkey, unnest(['a', 'b']) AS tag FROM nation), q AS (SELECT c.c_custkey AS u, p.tag AS k FROM customer AS c JOIN p ON c.c_nationkey = p.n_nationkey)"),
    "public_pivot": _counted("s AS (SELECT n_nationkey, n_regionkey FROM nation), p AS (SELECT * FROM s PIVOT (MAX(n_nationkey) FOR n_regionkey IN (0 AS a, 1 AS b))), q AS (SELECT c.c_custkey AS u, c.c_nationkey AS k FROM customer AS c JOIN p ON c.c_nationkey = p.a OR c.c_nationkey = p.b)", oracle="q AS (SELECT c_custkey AS u, c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT max(n_nationkey) FROM nation WHERE n_regionkey < 2 GROUP BY n_regionkey))"),
    "public_unpivot": _counted("p AS (SELECT * FROM nation UNPIVOT (x FOR col IN (n_nationkey, n_regionkey))), q AS (SELECT c.c_custkey AS u, p.col AS k FROM customer AS c JOIN p ON c.c_nationkey = p.x)", oracle="p AS (SELECT n_nationkey AS x, 'n_nationkey' AS col FROM nation UNION ALL SELECT n_regionkey, 'n_regionkey' FROM nation), q AS (SELECT c.c_custkey AS u, p.col AS k FROM customer AS c JOIN p ON c.c_nationkey = p.x)"),
    "order_limit_offset": Case("SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey ASC LIMIT 5 OFFSET 2", "SELECT c_nationkey, count(*)::DOUBLE AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_nationkey LIMIT 5 OFFSET 2"),
    "sql_options_query": Case("SELECT PRIVATE_QUERY OPTIONS (EPSILON = 1e40, DELTA = 0.5, CONTRIBUTION_BOUND = 1000, MIN_FREQUENCY = 1) event_type, SUM(value, 10, 300) AS s FROM events GROUP BY event_type", f"SELECT event_type, round(sum({_V}), 4) AS s FROM events GROUP BY 1", digits=4),
    "bounded_k1_total": Case("SELECT COUNT(*) AS n FROM orders", "SELECT count(DISTINCT o_custkey)::DOUBLE AS n FROM orders", k=1),
    "noisy_debug_count": Case("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type", f"SELECT event_type, round((count(*) + 2.5 * {DEBUG_DEVIATE})::DOUBLE, 6) AS n FROM events GROUP BY 1", sigma=2.5, digits=6),
}
# kinds of expressions
CASES |= {
    "cte_bitwise": _counted("q AS (SELECT user_id AS u, event_id & 6 | 1 << 3 ^ 5 AS k FROM events WHERE event_id % 16 | 2 & 4 > 3)", oracle="q AS (SELECT user_id AS u, (event_id & 6) | xor(1 << 3, 5) AS k FROM events WHERE ((event_id % 16) | (2 & 4)) > 3)"),
    "cte_unary": _counted("q AS (SELECT user_id AS u, CAST(- -value / 100 AS INTEGER) + - -1 AS k FROM events WHERE ! value > 400 AND ~event_id < -2)", oracle="q AS (SELECT user_id AS u, trunc(value / 100)::INTEGER + 1 AS k FROM events WHERE NOT value > 400 AND ~event_id < -2)"),
    "cte_like_escape": _counted(f"q AS (SELECT {_O} FROM orders WHERE o_orderpriority NOT LIKE '%!_%' ESCAPE '!' AND o_orderpriority LIKE '_-%U%' AND o_orderpriority <> 'a\n$')", oracle=f"q AS (SELECT {_O} FROM orders WHERE o_orderpriority NOT LIKE '%!_%' ESCAPE '!' AND o_orderpriority LIKE '_-%U%')"),
    "cte_tuple_in": _counted(f"q AS (SELECT {_O} FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('O', '1-URGENT'), ('F', '5-LOW')))"),
    "cte_array_funcs": _counted("q AS (SELECT user_id AS u, SIZE(SPLIT(event_type, 'c')) + CASE WHEN ARRAY_CONTAINS(ARRAY('click', 'view'), event_type) THEN 10 ELSE 0 END AS k FROM events)", oracle="q AS (SELECT user_id AS u, len(string_split(event_type, 'c')) + CASE WHEN event_type IN ('click', 'view') THEN 10 ELSE 0 END AS k FROM events)"),
    "cte_map_funcs": _counted("q AS (SELECT user_id AS u, ELEMENT_AT(MAP_FROM_ARRAYS(ARRAY('click', 'view'), ARRAY(1, 2)), event_type) AS k FROM events)", oracle="q AS (SELECT user_id AS u, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS k FROM events)"),
    "join_cross": _counted("q AS (SELECT c.c_custkey AS u, r.r_name AS k FROM customer AS c CROSS JOIN region AS r ON c.c_nationkey > r.r_regionkey * 4)", oracle="q AS (SELECT c.c_custkey AS u, r.r_name AS k FROM customer AS c JOIN region AS r ON c.c_nationkey > r.r_regionkey * 4)"),
    "var_stddev_covar_names": Case(f"{_LINES}SELECT l_returnflag, VAR(l_quantity) AS v, STDDEV(l_quantity) AS s, COVAR(l_quantity, l_discount) AS c FROM q GROUP BY l_returnflag", f"SELECT l_returnflag, round(var_samp({_Q}), 4) AS v, round(stddev_samp({_Q}), 4) AS s, round(covar_samp({_Q}, {_D}), 4) AS c FROM lineitem GROUP BY 1", (((5, 40),), ((5, 40),), ((5, 40), (0.0, 0.08))), digits=4),
    # epsilon 4 and delta 1e-4 in two shares: the scales are 1.8152 and 1.8936
    # (delta halved), tau is 5 + 1.8936 * 4.0556, every draw the debug deviate
    "budgeted_debug_count": Case("SELECT PRIVATE_QUERY OPTIONS (EPSILON = 4, DELTA = 0.0001, CONTRIBUTION_BOUND = 1, MIN_FREQUENCY = 5) c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment", f"SELECT c_mktsegment, round((count(*) + 1.8152111997 * {DEBUG_DEVIATE})::DOUBLE, 4) AS n FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) >= 5 AND count(DISTINCT c_custkey) + 1.8936173002 * {DEBUG_DEVIATE} >= 12.6798054145", digits=4, budget=(5.0, 1e-3)),
}
CASES["cte_window_rank"] = _counted("p AS (SELECT o_custkey, COUNT(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), q AS (SELECT o_custkey AS u, r AS k FROM p WHERE r <= 3)")
CASES["cte_window_frame"] = Case("WITH q AS (SELECT user_id, event_type, SUM(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS x FROM events) SELECT event_type, SUM(x) AS s FROM q GROUP BY event_type", f"WITH q AS (SELECT event_type, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS x FROM events) SELECT event_type, round(sum({_clip('x', 0, 400)}), 3) AS s FROM q GROUP BY 1", (((0, 400),),), digits=3)
CASES["cte_json_func"] = _counted("q AS (SELECT user_id AS u, GET_JSON_OBJECT(props, '$.k') AS k FROM events)", oracle="q AS (SELECT user_id AS u, json_extract_string(props, '$.k') AS k FROM events)")
for _kind in ("var_pop", "var_samp", "stddev_pop", "stddev_samp"):
    CASES[f"{_kind}_clipped"] = _grouped(f"{_kind.upper()}(l_quantity)", f"{_kind}({_Q})", ((5, 40),))
for _kind in ("covar_pop", "covar_samp"):
    CASES[f"{_kind}_clipped"] = _grouped(f"{_kind.upper()}(l_quantity, l_discount)", f"{_kind}({_Q}, {_D})", ((5, 40), (0.0, 0.08)))


def temp_view_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release stored as a view serves as a public table of a later query."""
    own = engine(spark, sf_dir)
    spark.catalog.dropTempView("released_types")
    own.execute_query("SELECT PRIVATE_QUERY OPTIONS (EPSILON = 1e40, DELTA = 0.5, CONTRIBUTION_BOUND = 1000) event_type, COUNT(*) AS n FROM events GROUP BY event_type", None, "temp.released_types")
    sql = "WITH q AS (SELECT e.user_id AS u, t.n AS k FROM events AS e JOIN released_types AS t ON e.event_type = t.event_type) SELECT PRIVATE_QUERY OPTIONS (EPSILON = 1e40, DELTA = 0.5, CONTRIBUTION_BOUND = 1000) k, COUNT(u) AS m FROM q GROUP BY k"
    out = own.execute_query(sql)
    spark.catalog.dropTempView("released_types")
    return out.select(F.round("k", 4).alias("k"), F.round("m", 4).alias("m"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run(case) for name, case in CASES.items()} | {"temp_view_roundtrip": temp_view_roundtrip}
ORACLE_SQL: dict[str, str] = {name: case.oracle for name, case in CASES.items()} | {"temp_view_roundtrip": "SELECT n::DOUBLE AS k, sum(n)::DOUBLE AS m FROM (SELECT count(*) AS n FROM events GROUP BY event_type) GROUP BY n"}
