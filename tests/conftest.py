import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logstream.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def log(spark):
    """Makes log records from keyword arguments, with plain values for the rest."""
    from datetime import datetime, timezone

    from logstream import model

    plain = {
        "timestamp": datetime(2024, 1, 3, 12, 0, tzinfo=timezone.utc),
        "level": "INFO",
        "message": "all well",
        "service": "user-service",
        "host": "host-1",
        "environment": "production",
        "metadata": None,
        "trace_id": "t1",
        "span_id": "s1",
    }

    def make(*records):
        rows = [tuple({**plain, **record}[c] for c in model.LOG_FIELDS) for record in records]
        return spark.createDataFrame(rows, model.FULL)

    return make
