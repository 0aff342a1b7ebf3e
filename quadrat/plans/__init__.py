"""Registered queries, one module for each part of the operator inventory.

Each module has ``QUERIES``: name -> (function of (spark, sf_dir), SQL or None).
"""

from __future__ import annotations

from quadrat.plans import agg_plan, files_plan, graph_plan, joins_plan, keys_plan, models_plan, pipelines_plan, prediction_plan, stats_plan, windows_plan

MODULES: list = [keys_plan, joins_plan, agg_plan, windows_plan, stats_plan, graph_plan, models_plan, pipelines_plan, files_plan, prediction_plan]


def queries() -> dict:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
