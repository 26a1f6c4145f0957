import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from tidemill.session import local_session

    session = local_session(8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def crates(spark):
    """15 rows of fruit crates: 2 missing cells, 3 repeated rows, one far too heavy crate."""
    rows = [
        (12.5, 310, 7, "plum", "Oslo", True),
        (14.0, 275, 5, "pear", "Bergen", False),
        (None, 420, 8, "plum", "Oslo", True),
        (15.5, 365, 6, "fig", None, False),
        (11.0, 290, 9, "pear", "Tromso", True),
        (18.0, 510, 4, "plum", "Oslo", False),
        (13.5, 335, 7, "fig", "Bergen", True),
        (16.0, 455, 8, "plum", "Oslo", True),
        (12.0, 300, 5, "pear", "Bergen", False),
        (17.5, 480, 6, "fig", "Oslo", True),
        (14.5, 350, 9, "pear", "Tromso", False),
        (90.0, 395, 3, "plum", "Bergen", False),
    ]
    schema = "weight double, price long, rating long, kind string, market string, organic boolean"
    return spark.createDataFrame(rows + rows[4:7], schema)
