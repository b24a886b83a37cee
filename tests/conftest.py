import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tabsmith.session import get_spark
    s = get_spark("local[4]", app="tabsmith-tests", shuffle_partitions=4,
                  extra={"spark.driver.memory": "8g"})
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tabsmith-test-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture
def collected_plans():
    """A context that lists the physical plans of all frames collected within."""
    from contextlib import contextmanager

    @contextmanager
    def watch(df):
        kind, seen = type(df), []
        inner = kind.collect

        def collect(self):
            seen.append(self._jdf.queryExecution().executedPlan().toString())
            return inner(self)

        kind.collect = collect
        try:
            yield seen
        finally:
            kind.collect = inner

    return watch


@pytest.fixture(scope="session")
def duck_small():
    from tests.oracle_harness import duck
    return duck(SF_SMALL)
