import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tenure.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=4,
                    extra={"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        d = tempfile.mkdtemp(prefix="tenure-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s


def tx(spark, rows):
    """Canonical transactions frame from (tx_id, driver_id, 'YYYY-MM-DD HH:MM:SS', amount, kind)."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "tx_id long, driver_id long, ts string, amount double, kind string")
    return df.select("tx_id", "driver_id", F.to_timestamp_ntz("ts").alias("transaction_date"), "amount", "kind")
