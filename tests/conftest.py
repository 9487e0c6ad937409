import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from castwork.session import local_session
    s = local_session("*", shuffle_partitions=8, app="castwork-tests")
    yield s


@pytest.fixture(scope="session")
def bound(spark):
    from castwork.sources.binding import bind
    return bind(spark, SF_SMALL)


@pytest.fixture(scope="session")
def make_tables(spark, bound):
    """Tables from small literal rows; unnamed tables are empty. Column
    order and types come from the bound model, so fixtures stay in step."""
    from castwork.sources.tables import TABLE_NAMES, Tables

    schemas = {n: getattr(bound, n).schema for n in TABLE_NAMES}

    def make(**rows):
        dfs = {}
        for n in TABLE_NAMES:
            data = rows.get(n, [])
            cols = [f.name for f in schemas[n].fields]
            tuples = [tuple(r.get(c) for c in cols) if isinstance(r, dict) else r for r in data]
            dfs[n] = spark.createDataFrame(tuples, schemas[n])
        return Tables(**dfs)

    return make
