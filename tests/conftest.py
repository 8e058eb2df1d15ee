import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from accuracast.session import build_session

    return build_session(8, "tests", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def make(spark):
    """{series: values} → panel with weekly stamps."""
    import datetime as dt

    def build(series: dict):
        rows = [
            (name, i, dt.datetime(2020, 1, 6) + dt.timedelta(weeks=i), None if v is None else float(v))
            for name, values in series.items() for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, "series_id string, pos bigint, ts timestamp_ntz, y double")

    return build
