import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stowcheck.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from stowcheck.sources.fixtures import Fixtures

    return Fixtures(spark, SF)


@pytest.fixture(scope="session")
def plan_of():
    def final_plan(df):
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        return text.split("== Initial Plan ==")[0]

    return final_plan
