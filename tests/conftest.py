import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.enabled=false --conf spark.ui.showConsoleProgress=false --conf spark.driver.memory=8g pyspark-shell")


@pytest.fixture(scope="session")
def spark():
    from voltide.session import get_session

    s = get_session("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield s


@pytest.fixture
def fresh():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


def skewed(spark, n=400, hot=0.4):
    """One series with a large share of all rows, the rest short."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows, k = [], 0
    for s, m in [(0, int(n * hot))] + [(j, 20) for j in range(1, int(n * (1 - hot) / 20) + 1)]:
        for t in range(m):
            rows.append((s, t, k, float(rng.normal())))
            k += 1
    rng.shuffle(rows)
    return spark.createDataFrame([(int(a), int(b), int(c), float(d)) for a, b, c, d in rows], "series_id long, t long, tie long, y double")
