import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from topicflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def papers(spark):
    """Nine small papers over three years."""
    rows = [
        ("p1", "Graph mining", "graph networks for graph data. Deep ideas here.", None, 2022),
        ("p2", "AI in the main", "main stream graph methods. Networks again.", "", 2022),
        ("p3", "Sparse models", "sparse networks and graph networks! Third line.", "graph", 2023),
        ("p4", "Vision", "image networks with sparse codes. Image work.", None, 2023),
        ("p5", "Vision again", "image networks. graph image image.", None, 2023),
        ("p6", "Speech", "speech image networks", "speech", 2024),
        ("p7", "Speech and text", "speech text image. speech speech.", None, 2024),
        ("p8", "Blank", "", None, 2024),
        ("p9", "Null", None, "a summary", 2024),
    ]
    schema = "paper_id STRING, title STRING, abstract STRING, summary STRING, year INT"
    return spark.createDataFrame(rows, schema)
