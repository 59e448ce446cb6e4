"""An append-only log of states as a table: batches in order, folded by key, compacted now and then.

Each batch is a folder of its own whose name holds its number. A number is taken by creating its folder, so
of two writers that want the same one only one gets it. A batch counts once it is committed whole.
Compaction writes the folded states up to a batch beside the batches; readers then start from there. What an
earlier reader may still be reading stays until the compaction after the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from panelwright.session import committed_folders, delete_path


def fold_events(events: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """The newest event of each key; one partial and one final aggregation."""
    newest = events.groupBy(*keys).agg(F.max_by(F.struct(*events.columns), order).alias("_newest"))
    return newest.select("_newest.*")


class EventLog:
    """Events with the columns of ``schema`` and a number ``seq``, the same for all rows of a batch."""

    BATCH, STATE = "batch-", "state-"

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], compact_after: int = 32):
        self.spark, self.path, self.keys, self.compact_after = spark, path.rstrip("/"), list(keys), compact_after
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.full = StructType([*self.schema.fields]).add("seq", LongType())

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(name.removeprefix(kind)) for name in committed_folders(self.spark, self.path) if name.startswith(kind))

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}{number:012d}"

    def _parts(self) -> tuple[int, list[int]]:
        """The newest compacted batch, 0 if there is none, and the batches after it."""
        start = max(self._numbers(self.STATE), default=0)
        return start, [n for n in self._numbers(self.BATCH) if n > start]

    def exists(self) -> bool:
        start, after = self._parts()
        return bool(start or after)

    def append(self, rows: DataFrame) -> int:
        """Write a batch; returns its number. Columns that ``rows`` lacks are NULL."""
        start, after = self._parts()
        number = max([start, *after]) + 1
        columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        batch = rows.select(*columns, F.lit(number).cast("long").alias("seq"))
        for _ in range(100):
            try:
                batch.write.mode("errorifexists").parquet(self._folder(self.BATCH, number))
                break
            except AnalysisException as error:
                if error.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
                number += 1  # taken by another writer, or by one that died before it committed
                batch = batch.withColumn("seq", F.lit(number).cast("long"))
        else:
            raise RuntimeError(f"no free number in {self.path}")
        if len(after) + 1 >= self.compact_after:
            self.compact()
        return number

    def events(self) -> DataFrame:
        """The states that have been compacted and all batches since."""
        start, after = self._parts()
        folders = [self._folder(self.STATE, start)] * bool(start) + [self._folder(self.BATCH, n) for n in after]
        if not folders:
            return self.spark.createDataFrame([], self.full)
        return self.spark.read.schema(self.full).parquet(*folders)

    def state(self) -> DataFrame:
        return fold_events(self.events(), self.keys)

    def compact(self) -> None:
        start, after = self._parts()
        if not after:
            return
        self.state().write.mode("overwrite").parquet(self._folder(self.STATE, after[-1]))
        for kind in (self.BATCH, self.STATE):
            for number in self._numbers(kind):
                if number < start or kind == self.BATCH and number <= start:
                    delete_path(self.spark, self._folder(kind, number))
