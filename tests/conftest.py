import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from paylake.session import get_session
    ckpt = tempfile.mkdtemp(prefix="paylake-test-ckpt-")
    warehouse = tempfile.mkdtemp(prefix="paylake-test-wh-")
    s = get_session("local[4]", app="paylake-tests", shuffle_partitions=4,
                    extra={"spark.checkpoint.dir": ckpt, "spark.sql.warehouse.dir": warehouse})
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="paylake-test-")
