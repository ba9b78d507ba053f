"""Panel and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators.features import FEATURE_SQL, NAMES, features
from panelforge.sources.panel import TICKERS, events_panel, events_sql, lineitem_panel, lineitem_sql, orders_panel, orders_sql, with_returns

PANEL_SQL = lineitem_sql()


def _panel(build):
    return lambda spark, d: with_returns(build(spark, d)).select("dt", "asset", "asset_ord", "px", "rn", F.round("ret", 6).alias("ret"), F.round("lret", 6).alias("lret"))


def _panel_sql(sql: str) -> str:
    return f"WITH {sql} SELECT dt, asset, asset_ord, px, rn::INT AS rn, round(ret, 6) AS ret, round(lret, 6) AS lret FROM p"


def _feature(name: str):
    return lambda spark, d: features(lineitem_panel(spark, d), [name], TICKERS).select("dt", "asset", F.round(name, 6).alias("value"))


QUERIES = {
    "panel_weekly": _panel(lineitem_panel),
    "panel_daily": _panel(lambda s, d: lineitem_panel(s, d, "day")),
    "panel_orders": _panel(orders_panel),
    "panel_events": _panel(events_panel),
} | {f"feature_{n}": _feature(n) for n in NAMES}
ORACLE = {"panel_weekly": _panel_sql(PANEL_SQL), "panel_daily": _panel_sql(lineitem_sql("day")), "panel_orders": _panel_sql(orders_sql()), "panel_events": _panel_sql(events_sql())}
ORACLE |= {f"feature_{n}": f"WITH {PANEL_SQL}, {FEATURE_SQL} SELECT dt, asset, round({n}, 6) AS value FROM f" for n in NAMES}
