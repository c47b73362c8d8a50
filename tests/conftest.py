import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from rtq.session import DEFAULT_CONF
    b = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rtq-test-ckpt-"))
    b = b.config("spark.driver.memory", "8g")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    from rtq.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s
