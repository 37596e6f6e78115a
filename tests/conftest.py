import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tools"), os.path.dirname(os.path.abspath(__file__))):
    sys.path.insert(0, path)


@pytest.fixture(scope="session")
def spark():
    from tallywing import spark_session

    session = spark_session("tests", master="local[4]", spark__sql__shuffle__partitions="4",
                            spark__ui__enabled="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def derived(spark):
    """The warehouse derived from the smallest data set."""
    from tallywing.plans.registry import Inputs

    return Inputs(spark, "/root/testdata/sf0.001").wh
