import os
import random
import sys

import pytest
from steps import SCHEMA, make_steps

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from faultline.session import configure

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield configure(s)
    s.stop()


@pytest.fixture(scope="session")
def steps(spark):
    return spark.createDataFrame(make_steps(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def labels(spark, steps):
    rng = random.Random(3)
    sizes = {}
    for s, f, i, *_ in make_steps():
        sizes[(s, f)] = max(sizes.get((s, f), 0), i + 1)
    rows = [(s, f, n, rng.randrange(n + 1), rng.choice(["Boss", "Web", "Code"]), [])
            for (s, f), n in sorted(sizes.items())]
    return spark.createDataFrame(
        rows, "subset string, file_id string, n_steps int, mistake_step int, mistake_agent string, "
        "flags array<string>").cache()


@pytest.fixture(scope="session")
def score_rows(spark):
    """(p sequence, agents, types) -> a one-file score table."""
    def build(ps, agents=None, types=None):
        rows = [("hc", "f", i, (agents or ["A"] * len(ps))[i], (types or ["execute"] * len(ps))[i], float(p))
                for i, p in enumerate(ps)]
        return spark.createDataFrame(
            rows, "subset string, file_id string, step_idx int, agent string, type_norm string, p_raw double")

    return build
