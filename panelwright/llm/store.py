"""Tables between two jobs of one operator, kept in the folder that every machine of the cluster sees."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session without that setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="panelwright-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """Writes tables under one fresh folder and reads them back.

    A table that has been written no longer depends on executors: losing one costs a re-read, and all
    readers see the same rows. ``drop`` removes a table that no later plan reads; the rest goes when
    the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
        self._tables = 0
        atexit.register(self._remove, self.root)

    def table(self, df: DataFrame) -> DataFrame:
        self._tables += 1
        path = f"{self.root}/{self._tables}"
        df.write.parquet(path, compression="zstd")
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._remove(table._workspace_path)

    def _remove(self, path: str) -> None:
        with contextlib.suppress(Exception):
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def words_of(text: Column) -> Column:
    """Maximal runs without ASCII white space; NULL counts as no text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_BREAK))
