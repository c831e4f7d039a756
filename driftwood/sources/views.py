"""Series over the event and order tables: (series_id, pos, value) with an explicit 0-based position."""

from __future__ import annotations

from driftwood.plans.dialect import Spark


def by_type(d: Spark) -> str:
    return f"SELECT event_type AS series_id, cast(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS bigint) AS pos, value FROM {d.table('events')} WHERE value IS NOT NULL"


def by_user(d: Spark) -> str:
    return f"SELECT cast(user_id AS string) AS series_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS bigint) AS pos, value FROM {d.table('events')} WHERE value IS NOT NULL"


def hourly(d: Spark) -> str:
    hours = f"SELECT {d.timestamp_hour('ts')} AS h, avg(value) AS value FROM {d.table('events')} WHERE value IS NOT NULL GROUP BY 1"
    return f"SELECT 'hours' AS series_id, cast(row_number() OVER (PARTITION BY 1 ORDER BY h) - 1 AS bigint) AS pos, value FROM ({hours}) x"


def daily(d: Spark) -> str:
    days = f"SELECT date_trunc('day', l_shipdate) AS t, sum(l_extendedprice) / 1000 AS value FROM {d.table('lineitem')} GROUP BY 1"
    return f"SELECT 'days' AS series_id, cast(row_number() OVER (PARTITION BY 1 ORDER BY t) - 1 AS bigint) AS pos, value FROM ({days}) x"


def whole(d: Spark) -> str:
    """Values in hundredths, as whole numbers."""
    return f"SELECT series_id, pos, round(value * 100) AS value FROM ({by_type(d)}) x"


def categories(d: Spark) -> str:
    return f"SELECT series_id, pos, floor(value / 50) AS value FROM ({by_type(d)}) x"


def pairs(d: Spark) -> str:
    """Two event types' series, paired by position as far as both go."""
    return f"""SELECT 'first/last type' AS series_id, a.pos, a.value AS x, b.value AS y FROM (SELECT * FROM ({by_type(d)}) s WHERE series_id = (SELECT min(event_type) FROM {d.table('events')})) a
JOIN (SELECT * FROM ({by_type(d)}) s WHERE series_id = (SELECT max(event_type) FROM {d.table('events')})) b ON a.pos = b.pos"""


def pairs_long(d: Spark) -> str:
    """Each value of the hourly series with the one a day before: long enough for segments at every scale."""
    return f"SELECT a.series_id, a.pos - 24 AS pos, a.value AS x, b.value AS y FROM ({hourly(d)}) a JOIN ({hourly(d)}) b ON b.pos = a.pos - 24"


def draws(d: Spark) -> str:
    """Orders of five lines as draws of five numbers from 1 to 50: (draw, pos, number), numbers ascending within a draw."""
    lines = f"SELECT l_orderkey, count(*) AS n FROM {d.table('lineitem')} GROUP BY l_orderkey"
    dated = f"SELECT o_orderkey AS draw, cast(row_number() OVER (PARTITION BY 1 ORDER BY o_orderdate, o_orderkey) - 1 AS bigint) AS pos FROM {d.table('orders')} JOIN ({lines}) c ON l_orderkey = o_orderkey WHERE n = 5"
    return f"SELECT 'orders' AS series_id, pos, cast(l_quantity AS int) AS number FROM ({dated}) x JOIN {d.table('lineitem')} ON l_orderkey = draw"


#: The tables that each view reads.
TABLES = {by_type: ["events"], by_user: ["events"], hourly: ["events"], daily: ["lineitem"], whole: ["events"], categories: ["events"], pairs: ["events"], pairs_long: ["events"], draws: ["orders", "lineitem"]}
