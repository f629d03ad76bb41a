"""The registered queries: each applies an operator to the views on the synthetic tables; the SQL states the same result."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
AS_OF = "2024-01-20 12:00:00"
#: Added before rounding, in both languages: means of decimals often lie exactly between two roundings, and the last bits of a sum depend on its order.
NUDGE = 1e-9

EVENTS_SQL = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN value BETWEEN 0.01 AND 200 THEN value ELSE 0.0 END AS flow FROM events),
u AS (SELECT event_id AS id, event_type AS circuit, ts AS start_ts, ts + to_seconds(k) AS end_ts, CAST(k AS DOUBLE) AS duration_seconds, flow AS avg_flow_lpm,
 value AS peak_flow_lpm, flow * k / 60 AS volume_litres, (user_id % 50) / 10e0 AS pressure_delta_psi, user_id % 2 = 1 AS has_pressure_transient,
 (user_id % 40) + 30e0 AS pre_event_pressure_psi, (user_id % 40) + 25e0 AS min_pressure_psi,
 CASE WHEN user_id % 12 <> 0 THEN 'f' || (user_id % 12) END AS fixture_id, CASE WHEN k % 10 <> 9 THEN k % 10 END AS cluster_id, k % 7 = 0 AS excluded,
 k / 100e0 AS anomaly_score, k >= 60 AS triggered_alert, (user_id % 3) / 3e0 AS flow_variability, user_id FROM raw),
r AS (SELECT event_type AS circuit, event_id AS id, ts, CAST(value AS VARCHAR) AS state, value, user_id % 8 AS sensor FROM events),
clusters AS (SELECT circuit, cluster_id, count(*) AS member_count, CASE WHEN cluster_id % 2 = 0 THEN 'f' || cluster_id END AS fixture_id,
 CASE WHEN cluster_id % 3 = 1 THEN 'toilet' WHEN cluster_id % 3 = 2 THEN 'shower' END AS suggested_type, cluster_id / 10e0 AS suggested_confidence FROM u WHERE cluster_id IS NOT NULL GROUP BY circuit, cluster_id),
fixtures AS (SELECT 'f' || n AS fixture_id, CASE WHEN n % 4 <> 0 THEN 'Fixture ' || n END AS fixture_name, CASE WHEN n % 4 = 2 THEN 'toilet' WHEN n % 4 = 0 THEN 'shower' END AS fixture_type, n % 3 <> 0 AS confirmed FROM range(0, 12) t(n))"""


def settled(value, digits: int):
    """The rounded column, ties upwards whatever the last bits."""
    from pyspark.sql import functions as F

    return F.round((F.col(value) if isinstance(value, str) else value) + NUDGE, digits)


def query(sql: str | None = None, recursive: bool = False) -> Callable:
    """Registers a function under its name; the SQL may use the views u, r, clusters and fixtures, and with recursive itself."""
    begin = "WITH RECURSIVE" if recursive else "WITH"

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"{begin} {EVENTS_SQL}{sql}" if sql.lstrip().startswith(",") else f"{begin} {EVENTS_SQL}\n{sql}"
        return f

    return add
