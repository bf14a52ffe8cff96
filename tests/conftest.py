import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    ckpt = tempfile.mkdtemp(prefix="wardflow-test-ckpt-")
    s = (
        SparkSession.builder.master("local[4]")
        .appName("wardflow-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", ckpt)
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from wardflow.session import checkpoint_dir

    checkpoint_dir(s)
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


def readings_df(spark, rows):
    """rows: (record_id, t, parameter, value)."""
    return spark.createDataFrame(rows, "record_id long, t int, parameter string, value double")


def features_of(df, record_id=None):
    out = {}
    for r in df.collect():
        if record_id is None or r["record_id"] == record_id:
            out[(r["record_id"], r["feature"])] = r["value"]
    return out


def rows_in_one_partition(plan):
    """Exchanges into one partition that carry rows of the data, not sums or sketches of an aggregate below."""
    lines = plan.splitlines()
    return [x for x, below in zip(lines, lines[1:]) if "SinglePartition" in x and "Aggregate(" not in below]
