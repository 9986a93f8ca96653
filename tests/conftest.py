import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark():
    from riskloom.session import local_session

    return local_session(8, 8)


@pytest.fixture(scope="session")
def walk(spark):
    """Random-walk bars of three symbols of different length, one of them a single row."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    rows = []
    for name, n in (("A", 700), ("B", 320), ("ONE", 1)):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i, d in enumerate(pd.date_range("2020-01-01", periods=n)):
            rows.append((name, d.date(), float(price[i] * 1.01), float(price[i] * 0.98), float(price[i]), float(rng.integers(100, 900))))
    pdf = pd.DataFrame(rows, columns=["Symbol", "Date", "High", "Low", "Close", "Volume"])
    return pdf, spark.createDataFrame(pdf).repartition(5)
