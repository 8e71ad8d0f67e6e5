import os

import pytest

from quillmere.session import local_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4, **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def sf():
    return SF
