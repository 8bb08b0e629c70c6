from __future__ import annotations

import sys
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillroll.config import ONLINE_RETAIL  # noqa: E402
from tillroll.session import configure  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def retail():
    return ONLINE_RETAIL


@pytest.fixture
def quick():
    """Settings for model tests: the same code, small searches."""
    return replace(
        ONLINE_RETAIL, tune_candidates=2, tune_folds=2, forest_trees=5, cv_slices=2,
        forest_tree_range=(2, 6), boost_round_range=(2, 5), committee_range=(1, 2),
    )
