"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison; ``+ 0.0`` turns a negative zero into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, with other digits for the named ones."""
    out = []
    for field in df.schema:
        if field.dataType.typeName() == "double":
            out.append(r(field.name, special.get(field.name, digits)).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


# --- SQL building blocks -------------------------------------------------------------------------

HOUR = "datediff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts))"

# rolled-up events: one row per (area, t_index)
OBS = f"obs AS (SELECT user_id + 1 AS area, {HOUR} AS t_index, sum(value) AS value, count(*) AS n_rows FROM events GROUP BY 1, 2)"
AREAS = "areas AS (SELECT unnest(range(1, (SELECT max(user_id) + 2 FROM events))) AS area)"
STEPS = "steps AS (SELECT unnest(range(0, 720)) AS t_index)"
PANEL = (
    f"{OBS}, {AREAS}, {STEPS}, "
    "panel AS (SELECT a.area, s.t_index, TIMESTAMP '2024-01-01' + to_hours(s.t_index) AS utc, "
    "TIMESTAMP '2024-01-01' + to_hours(s.t_index) AS local, coalesce(o.value, 0.0) AS value, coalesce(o.n_rows, 0) AS n_rows "
    "FROM areas a CROSS JOIN steps s LEFT JOIN obs o ON o.area = a.area AND o.t_index = s.t_index)"
)
SPLIT = (
    "CASE WHEN CAST(local AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-16' THEN 'train' "
    "WHEN CAST(local AS DATE) BETWEEN DATE '2024-01-17' AND DATE '2024-01-20' THEN 'validation' "
    "WHEN CAST(local AS DATE) BETWEEN DATE '2024-01-21' AND DATE '2024-01-25' THEN 'test' "
    "WHEN CAST(local AS DATE) BETWEEN DATE '2024-01-26' AND DATE '2024-01-30' THEN 'stress' END"
)
TOTALS = f"{PANEL}, totals AS (SELECT area, sum(value) AS total, sum(value) / count(*) AS mean FROM panel GROUP BY area)"
CUSTOMERS = "cells AS (SELECT o_custkey AS area, sum(o_totalprice) AS total FROM orders GROUP BY 1)"

# events per 10 minutes, all users together; steps without events are absent
TEN = (
    "ten AS (SELECT CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 600) AS BIGINT) AS t_index, "
    "sum(value) AS value FROM events GROUP BY 1)"
)
# the users dealt over ten cells; every 97th step of cell 3 is taken out, as a loss in one cell only
TENS = (
    "obs AS (SELECT user_id % 10 + 1 AS area, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 600) AS BIGINT) AS t_index, sum(value) AS value FROM events GROUP BY 1, 2), "
    "seen AS (SELECT DISTINCT t_index FROM obs), "
    "grid AS (SELECT a.area, t.t_index, s.t_index IS NOT NULL AS seen, CASE WHEN s.t_index IS NOT NULL AND NOT (a.area = 3 AND t.t_index % 97 = 5) THEN coalesce(o.value, 0.0) END AS value "
    "FROM (SELECT unnest(range(1, 11)) AS area) a CROSS JOIN (SELECT unnest(range(0, 4320)) AS t_index) t LEFT JOIN seen s ON s.t_index = t.t_index LEFT JOIN obs o ON o.area = a.area AND o.t_index = t.t_index), "
    "miss AS (SELECT DISTINCT t_index FROM grid WHERE NOT seen), "
    "runs AS (SELECT min(t_index) AS start, count(*) AS length FROM (SELECT t_index, t_index - row_number() OVER (ORDER BY t_index) AS g FROM miss) GROUP BY g), "
    "fills AS (SELECT g.area, g.t_index, CASE WHEN r.length <= 3 THEN b.value * (1.0 - (g.t_index - r.start + 1)::DOUBLE / (r.length + 1)) + e.value * ((g.t_index - r.start + 1)::DOUBLE / (r.length + 1)) END AS line "
    "FROM grid g JOIN runs r ON g.t_index BETWEEN r.start AND r.start + r.length - 1 "
    "LEFT JOIN grid b ON b.area = g.area AND b.t_index = r.start - 1 LEFT JOIN grid e ON e.area = g.area AND e.t_index = r.start + r.length)"
)
SUPPLIERS = (
    "obs AS (SELECT l_suppkey + 1 AS area, datediff('day', TIMESTAMP '1995-01-02', l_shipdate) AS t_index, "
    "sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem GROUP BY 1, 2), "
    "areas AS (SELECT unnest(range(1, (SELECT max(l_suppkey) + 2 FROM lineitem))) AS area), "
    "steps AS (SELECT unnest(range(0, 2499)) AS t_index), "
    "panel AS (SELECT a.area, s.t_index, coalesce(o.value, 0.0) AS value "
    "FROM areas a CROSS JOIN steps s LEFT JOIN obs o ON o.area = a.area AND o.t_index = s.t_index)"
)

LABELLED = f"{PANEL}, lab AS (SELECT *, {SPLIT} AS split FROM panel)"
PREDICTIONS = (
    f"{LABELLED}, pp AS (SELECT area, t_index, local, split, value AS observed, lag(value, 1) OVER w AS persistence, lag(value, 24) OVER w AS seasonal "
    "FROM lab WINDOW w AS (PARTITION BY area ORDER BY t_index)), "
    "pred AS (SELECT area, split, t_index, local, observed, persistence, m.model, m.seed, "
    "CASE m.model WHEN 'persistence' THEN persistence WHEN 'seasonal_naive' THEN seasonal ELSE persistence * m.w + seasonal * (1 - m.w) END AS predicted "
    "FROM pp CROSS JOIN (SELECT model, seed, w::DOUBLE AS w FROM (VALUES ('persistence', 0, NULL), ('seasonal_naive', 0, NULL), ('blend', 0, 0.4), ('blend', 1, 0.5), ('blend', 2, 0.6)) v(model, seed, w)) m "
    "WHERE split IN ('test', 'stress'))"
)
SCALE = (
    "sc AS (SELECT area, avg(abs(d)) AS mase_scale FROM (SELECT area, value - lag(value, 24) OVER (PARTITION BY area ORDER BY t_index) AS d FROM lab WHERE split = 'train') GROUP BY area)"
)
# one forecast per (area, split, model): the two baselines and their even blend
FORECASTS = f"{PREDICTIONS}, fc AS (SELECT area, split, t_index, local, observed, persistence, model, predicted FROM pred WHERE model <> 'blend' OR seed = 1)"
SCORES_SQL = (
    "count(*) AS n, avg(abs(predicted - observed)) AS mae, sqrt(avg(power(predicted - observed, 2))) AS rmse, avg(predicted - observed) AS bias, "
    "100 * avg(abs(predicted - observed) / nullif(abs(observed), 0)) AS mape, "
    "100 * avg(abs(predicted - observed) / nullif(abs(observed), 0)) FILTER (WHERE abs(observed) >= 1) AS mape_excl_small, "
    "count(*) FILTER (WHERE abs(observed) < 1) AS n_small, "
    "100 * avg(coalesce(2 * abs(predicted - observed) / nullif(abs(observed) + abs(predicted), 0), 0)) AS smape, "
    "100 * sum(abs(predicted - observed)) / nullif(sum(abs(observed)), 0) AS wape, "
    "1 - sum(power(predicted - observed, 2)) / nullif(var_pop(observed) * count(*), 0) AS r2"
)
