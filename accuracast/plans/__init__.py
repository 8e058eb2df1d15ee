"""Named queries over the driver tables."""

import importlib

MODULES = ["panels_q", "features_q", "forecast_q", "arima_q", "space_q", "ranking_q", "report_q"]


def load_all():
    """(queries, oracles) of every section."""
    from accuracast.plans import catalog

    for name in MODULES:
        importlib.import_module(f"accuracast.plans.{name}")
    return catalog.QUERIES, catalog.ORACLES
