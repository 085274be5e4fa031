import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from trackloom.session import local_session

    s = local_session(4, 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(small):
    """DuckDB with the small tables as views."""
    import duckdb

    c = duckdb.connect()
    for name in sorted(os.listdir(small)):
        c.sql(f"create view {name[:-8]} as select * from '{small}/{name}'")
    return c
