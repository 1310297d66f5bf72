import datetime as dt
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.schema import BAR  # noqa: E402
from tickloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def walk(ticker, n, seed=0, start=dt.datetime(2024, 1, 2, 9, 25), minutes=5, per_day=71):
    """A random walk of bars on a session grid, as rows of the bar schema."""
    rng = random.Random(f"{ticker}{seed}")
    rows, close, at = [], 100.0 + rng.random() * 50, start
    for i in range(n):
        open_ = close
        close = round(open_ * (1 + rng.gauss(0, 0.004)), 2)
        high = round(max(open_, close) * (1 + rng.random() * 0.002), 2)
        low = round(min(open_, close) * (1 - rng.random() * 0.002), 2)
        rows.append((ticker, at, open_, high, low, close, rng.randrange(0, 5000)))
        at += dt.timedelta(minutes=minutes)
        if (i + 1) % per_day == 0:
            at = (at + dt.timedelta(days=1)).replace(hour=9, minute=25)
            while at.weekday() >= 5:
                at += dt.timedelta(days=1)
    return rows


@pytest.fixture(scope="session")
def bars(spark):
    """Uneven series: one holds most rows, one is too short for indicators."""
    rows = walk("NSE:HOT", 1500) + walk("NSE:B", 260) + walk("NSE:C", 45) + walk("NSE:SHORT", 10)
    return spark.createDataFrame(rows, BAR).repartition(5).cache()
