import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from docspark.session import configure

    builder = (
        SparkSession.builder.master("local[8]")
        .appName("docspark-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="docspark-"))
    )
    session = configure(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tx(spark):
    """Transaction rows from dicts; pages and positions may be given."""
    from docspark.schema import TRANSACTION_FIELDS, TRANSACTION_ROW

    def make(*rows, issuer=None):
        from pyspark.sql import functions as F

        full = [
            (r.get("job_id", "job_1"), r.get("page", 1), r.get("pos", i))
            + tuple(r.get(f, "") for f in TRANSACTION_FIELDS)
            for i, r in enumerate(rows)
        ]
        df = spark.createDataFrame(full, TRANSACTION_ROW)
        return df if issuer is None else df.withColumn("issuer", F.lit(issuer))

    return make
