import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.session import build_session


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="millrace-tests-")
    session = build_session(
        "millrace-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": f"{scratch}/checkpoints",
            "spark.sql.warehouse.dir": f"{scratch}/warehouse",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples, NULLs first."""

    def collect(df, *columns):
        found = [tuple(r[c] for c in (columns or df.columns)) for r in df.collect()]
        return sorted(found, key=lambda r: [(v is not None, str(v)) for v in r])

    return collect
