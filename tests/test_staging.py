"""The folder of written tables."""

import os

import pytest
from pyspark.sql import functions as F

from textloom.sources import staging as common


class Master:
    """A session that says it runs somewhere else."""

    def __init__(self, spark, master, given=None):
        self.conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d), "set": staticmethod(lambda k, v: None)})
        option = type("Option", (), {"isDefined": staticmethod(lambda: given is not None), "get": staticmethod(lambda: given)})
        sc = type("Sc", (), {"getCheckpointDir": staticmethod(lambda: option)})
        self.sparkContext = type("Context", (), {"master": master, "_jsc": type("Jsc", (), {"sc": staticmethod(lambda: sc)})})


def test_no_local_folder_on_a_cluster(spark):
    for master in ("yarn", "spark://a:7077", "k8s://https://a", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            common.shared_dir(Master(spark, master))
        assert common.shared_dir(Master(spark, master, "hdfs://a/b/")) == "hdfs://a/b"
    for master in ("local", "local[4]", "local[*]", "local[2,3]"):
        assert common.shared_dir(Master(spark, master)).startswith("file:///")


def test_scratch_deletes(spark):
    with common.scratch():
        ws = common.Workspace(spark, "t")
        df = ws.write(spark.range(3))
        path = ws.path.removeprefix("file://")
        assert df.count() == 3 and os.path.isdir(path)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    assert not os.path.exists(path)
    ws = common.Workspace(spark, "t")
    ws.drop(ws.write(spark.range(3)))
    assert os.listdir(ws.path.removeprefix("file://")) == []


def test_large_rows_end_row_groups(spark):
    pq = pytest.importorskip("pyarrow.parquet")
    rows = spark.range(0, 40, 1, 1).withColumn("x", F.unhex(F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(1 << 15))))  # 1 MB each
    with common.scratch():
        df = common.Workspace(spark, "t").write(rows, compression="uncompressed")
        sizes = [m.row_group(i).total_byte_size for f in df.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for i in range(m.num_row_groups)]
        assert sum(sizes) > 40 << 20 and max(sizes) < 20 << 20
        assert df.agg(F.sum(F.length("x"))).first()[0] == 40 << 20
