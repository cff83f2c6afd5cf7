import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from waypost.schema import CARD  # noqa: E402
from waypost.session import local_session  # noqa: E402

OUTCOME = "request_id string, text string, model string, acceptable boolean, split string, cost_usd double, `group` string"
HELDOUT = (
    "request_id string, text string, model string, acceptable boolean, cost_usd double, `group` string, "
    "input_tokens bigint, output_tokens bigint"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g", shuffle_partitions=4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="session")
def cards(spark):
    return spark.createDataFrame(
        [
            ("cheap", "local", 0.01, None, None, 4000, ["text"], {}),
            ("strong", "remote", 0.20, None, None, 16000, ["text", "tools"], {}),
        ],
        CARD,
    )


@pytest.fixture(scope="session")
def outcomes(spark):
    """Greetings any model answers, theorems only the strong one proves."""
    rows = []
    for split, count in (("train", 12), ("calibration", 8)):
        for i in range(count):
            easy = i % 2 == 0
            text = "simple greeting" if easy else "prove a hard theorem"
            rows.append((f"{split}-{i}", text, "cheap", easy, split, 0.01, ""))
            rows.append((f"{split}-{i}", text, "strong", True, split, 0.20, ""))
    return spark.createDataFrame(rows, OUTCOME).persist()


@pytest.fixture(scope="session")
def heldout(spark):
    rows = [
        ("test-1", "simple greeting", "cheap", True, 0.01, "easy", 100, 50),
        ("test-1", "simple greeting", "strong", True, 0.20, "easy", 100, 50),
        ("test-2", "prove a hard theorem", "cheap", False, 0.01, "hard", 100, 50),
        ("test-2", "prove a hard theorem", "strong", True, 0.20, "hard", 100, 50),
    ]
    return spark.createDataFrame(rows, HELDOUT).persist()


@pytest.fixture(scope="session")
def model(outcomes, cards):
    from waypost import train_router

    return train_router(outcomes, cards, dimension=128, backend="gradient", gradient_epochs=60)
