import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("spark-checkpoints")),
                                            "spark.sql.codegen.wholeStage": "true"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
