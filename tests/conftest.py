import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from retort.session import checkpoint_dir, get_spark
    s = get_spark("local[*]", app="retort-tests", conf={"spark.sql.shuffle.partitions": "8",
                                                       "spark.driver.memory": "8g"})
    checkpoint_dir(s)
    yield s
    s.stop()
