import os
import signal
import sys
from pathlib import Path

os.environ.setdefault("OMP_NUM_THREADS", "1")  # before numpy is loaded: small matrices gain nothing from threads

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
# Python processes that Spark starts for streams find the library and the tests' own classes here.
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def limit(request):
    """A test that hangs fails after ten minutes instead of taking the others with it."""

    def ring(*_):
        raise TimeoutError(request.node.nodeid)

    before = signal.signal(signal.SIGALRM, ring)
    signal.alarm(600)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)
