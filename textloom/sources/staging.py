"""Written tables and files of one run, in a folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables: ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.

    Without either, a folder of our own is set on a local master (tests); on a cluster that is an error, since a folder of
    the driver would not be seen by the executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = given.get() if given.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


CLEANUP, BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
# Parquet looks at the size of pages and row groups after 100 rows only, which may be 100 blocks of megabytes; and readers
# take up to 4,096 rows of a row group at once.
PARQUET = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1}
OPEN: list[list[Workspace]] = []


class Workspace:
    """A folder for the written tables of one operator run.  Written tables cut the lineage and outlive executors.

    It is deleted when the JVM ends, or by ``scratch`` as soon as what was made from it is written elsewhere.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex[:12]}", 0
        fs, path = self._at(self.path)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        if OPEN:
            OPEN[-1].append(self)

    def _at(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def write(self, df: DataFrame, compression: str = "zstd", batch_rows: int = 2000) -> DataFrame:
        """Writes df as Parquet and reads it back.

        Meanwhile shuffle files go as soon as they were read, and Python tasks take ``batch_rows`` rows at once: few where
        rows are large.  A row group ends at 16 MB or its first row beyond, which bounds what writers and readers hold,
        however many large rows a task writes.
        """
        self.n += 1
        path = f"{self.path}/{self.n}"
        conf = {CLEANUP: "true", BATCH: str(batch_rows)}
        was = {k: self.spark.conf.get(k, None) for k in conf}
        try:
            for k, v in conf.items():
                self.spark.conf.set(k, v)
            df.write.options(compression=compression, **PARQUET).parquet(path)
        finally:
            for k, v in was.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._textloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of write() that nothing lazy refers to any more."""
        self.delete(df._textloom_path)

    def delete(self, path: str | None = None) -> None:
        fs, path = self._at(path or self.path)
        fs.delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end the workspaces opened inside: for callers that write an operator's result themselves."""
    OPEN.append([])
    try:
        yield
    finally:
        for ws in OPEN.pop():
            ws.delete()
