import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.plans.session import apply_defaults

    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]").appName("tests")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return apply_defaults(session)


@pytest.fixture(scope="session")
def students(spark):
    """Five hundred made-up students: two scores, and whether they did research."""
    import numpy as np

    rng = np.random.default_rng(11)
    skill = rng.normal(0, 1, 500)
    score = np.round(316 + 11 * skill + rng.normal(0, 4, 500)).astype(int)
    grade = np.round(8.6 + 0.5 * skill + rng.normal(0, 0.25, 500), 2)
    essay = np.round(np.clip(3.4 + 0.8 * skill + rng.normal(0, 0.6, 500), 1, 5) * 2) / 2
    research = (rng.random(500) < 1 / (1 + np.exp(-2.2 * skill))).astype(int)
    rows = [(i + 1, int(a), float(b), float(e), int(r)) for i, (a, b, e, r) in enumerate(zip(score, grade, essay, research))]
    return spark.createDataFrame(rows, "student long, score long, grade double, essay double, research long").cache()
