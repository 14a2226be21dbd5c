import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tracewright.session import build_session
    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                                    "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *cols):
    """Sorted list of tuples of a DataFrame."""
    got = [tuple(r[c] for c in (cols or df.columns)) for r in df.collect()]
    return sorted(got, key=lambda r: tuple((v is None, v) for v in r))
