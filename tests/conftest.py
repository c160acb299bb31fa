import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from terrane.session import local_session, ship

    s = local_session("4", 4, "6g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use inside, filled with nonsense."""
    from pyspark.sql import functions as F

    names = "key part at rank items block cands n grp side value entries digest chunk since until edge_id end_name w score kind_ utc_us tok a1 span bucket".split()

    def add(df):
        return df.withColumns({x: F.lit(f"clash-{x}") for x in names if x not in df.columns})

    return add


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
