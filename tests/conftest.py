import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
# Python workers start elsewhere and find the package by this.
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[1], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from sendledger.session import builder, use_local_folder

    session = (
        builder("tests", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
        .master("local[8]")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    use_local_folder(session)
    yield session
    session.stop()
