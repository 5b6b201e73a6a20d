import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from labelspark.session import checkpoint_dir, local_session

    s = local_session(4, shuffle_partitions=4, app_name="labelspark-tests")
    # tests run where spark.checkpoint.dir is unset: give them their own folder
    checkpoint_dir(s, tempfile.mkdtemp(prefix="labelspark-test-ckpt-"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="labelspark-test-")
