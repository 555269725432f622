import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corvina.runtime import session

    s = session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def scratch(spark):
    from corvina.runtime import Scratch

    return Scratch(spark, "test")
