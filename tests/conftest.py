import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairlog.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, app="tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("work"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def log(spark):
    """Two runs, four people, three trials: a missing answer, an unpaired person, a dominance
    tie, and an answer which repeats both own and partner's previous one."""
    rows = [
        # run, trial, id, answer, pair
        ("a", 1, 1, "x", 0), ("a", 1, 2, "x", 0), ("a", 1, 3, "y", 1), ("a", 1, 4, "z", 1),
        ("a", 2, 1, "x", 0), ("a", 2, 3, "x", 0), ("a", 2, 2, "y", 1), ("a", 2, 4, "y", 1),
        ("a", 3, 1, "y", 0), ("a", 3, 4, None, 0), ("a", 3, 2, "x", -1), ("a", 3, 3, "y", -1),
        ("b", 1, 1, "p", 0), ("b", 1, 2, "q", 0), ("b", 1, 3, "q", 1), ("b", 1, 4, "q", 1),
        ("b", 2, 1, "q", 0), ("b", 2, 2, "q", 0), ("b", 2, 3, "r", 1), ("b", 2, 4, "p", 1),
        ("b", 3, 1, "q", 0), ("b", 3, 3, "r", 0), ("b", 3, 2, "p", 1), ("b", 3, 4, "q", 1),
    ]
    schema = "Identifier string, TrialNumber int, id int, Response string, grp int, Structure string, Content string"
    return spark.createDataFrame(
        [(*r, "Homogeneous" if r[0] == "a" else "Spatial", "Face" if r[0] == "a" else "Hashtag") for r in rows], schema)
