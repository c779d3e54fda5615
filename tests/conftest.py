import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from claimflow.session import get_spark
    s = get_spark("local[4]", app_name="claimflow-tests", shuffle_partitions=8,
                  extra_conf={"spark.driver.memory": "8g"})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="claimflow-test-")
