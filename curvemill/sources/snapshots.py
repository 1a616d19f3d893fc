"""Tables that grow by numbered batches and survive a run that breaks off anywhere.

A batch's rows are a folder of their own. What the table consists of is said by a log with a file for each batch, which
lists the folders that count; it is written beside and moved into place, so that a reader sees a batch whole or not at
all. A batch whose number is in the log already is not added again, so a repeated run changes nothing. Files are reached
by Hadoop's interfaces: a folder can be wherever Spark writes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.operators.tables import chunks, not_yet_done, upsert
from curvemill.staging import settled


class Snapshots:
    """The table in a folder. Its rows have schema (as text)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = hadoop.FileContext.getFileContext(self._files.getUri(), spark._jsc.hadoopConfiguration())
        self._rename = hadoop.Options.Rename

    def _entries(self) -> list[int]:
        log = self._path(f"{self.folder}/_log")
        if not self._files.exists(log):
            return []
        return sorted(int(s.getPath().getName()) for s in self._files.listStatus(log) if s.getPath().getName().isdigit())

    def _parts(self, batch: int) -> list[str]:
        stream = self._files.open(self._path(f"{self.folder}/_log/{batch:020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["parts"]
        finally:
            stream.close()

    def batch(self) -> int:
        """Number of the last batch; 0 if there is none."""
        return max(self._entries(), default=0)

    def read(self) -> DataFrame:
        """The rows as of the last batch."""
        last = self.batch()
        if not last:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{p}" for p in self._parts(last)))

    def _told(self, batch: int, parts: list[str]) -> bool:
        """Enter a batch into the log; False if another run was first."""
        draft = self._path(f"{self.folder}/_log/.draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        stream.write(json.dumps({"parts": parts}).encode())
        stream.close()
        never_over = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        never_over[0] = self._rename.NONE
        try:
            self._context.rename(draft, self._path(f"{self.folder}/_log/{batch:020d}"), never_over)
        except Py4JJavaError as e:
            self._files.delete(draft, False)
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            return False
        return True

    def commit(self, batch: int, rows: DataFrame, replace: bool = False) -> bool:
        """Add rows as the batch of this number, or make them all of the table (replace). False if that number was there."""
        last = self.batch()
        if batch <= last:
            return False
        part = f"rows-{batch:020d}-{uuid.uuid4().hex}"
        kinds = self.spark.createDataFrame([], self.schema).schema
        rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds)).write.parquet(f"{self.folder}/{part}")
        done = self._told(batch, [part] if replace or not last else [*self._parts(last), part])
        if not done:
            self._files.delete(self._path(f"{self.folder}/{part}"), True)
        return done

    def upsert(self, batch: int, rows: DataFrame, keys: list[str]) -> bool:
        """Put rows in place of those with the same keys; the table is written anew."""
        return self.commit(batch, upsert(self.read(), rows, keys), replace=True)

    def cleared(self) -> int:
        """Delete what no run needs any more: rows that the last batch doesn't list, drafts, and log files before it. How many went. Nobody may be reading an older state or writing."""
        last = self.batch()
        keep = {*self._parts(last), "_log"} if last else {"_log"}
        gone = [s.getPath() for s in self._files.listStatus(self._path(self.folder)) if s.getPath().getName() not in keep] if self._files.exists(self._path(self.folder)) else []
        if self._files.exists(log := self._path(f"{self.folder}/_log")):
            gone += [s.getPath() for s in self._files.listStatus(log) if s.getPath().getName() != f"{last:020d}"]
        for path in gone:
            self._files.delete(path, True)
        return len(gone)


def run_in_batches(todo: DataFrame, key: str, size: int, work: Callable[[DataFrame], DataFrame], table: Snapshots) -> DataFrame:
    """The table after work was done on all of todo, size keys at a time, each batch entered before the next begins.

    Rows whose key the table has are not worked on again, so a run that broke off goes on where it stopped.
    """
    left = settled(chunks(not_yet_done(todo, table.read(), [key]), key, size))
    last = left.agg(F.max("batch")).first()[0]
    for number in range(0 if last is None else last + 1):
        table.commit(table.batch() + 1, work(left.where(F.col("batch") == number).drop("batch")))
    return table.read()
