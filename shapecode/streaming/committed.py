"""Tables that micro-batches append to exactly once (K1, K2, K8).

A batch is written as a segment folder of its own and becomes part of the
table when one small ledger file, named by the batch id, is renamed into
place.  Readers take the segments that the ledger names, so the files of a
failed, repeated or running attempt are never seen; a batch whose id stands in
the ledger is not written again.

``compact`` merges small segments: a ledger file that names the merged segment
and those it replaces is renamed into place, which switches readers from one
to the other at once.  ``vacuum`` deletes segments that no entry names.  One
job appends and one compacts at a time (a streaming query is the only writer
of its batches).  The ledger can be read as a stream of committed segments.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = "batch_id bigint, segment string, rows bigint, files int, last_batch bigint, replaces array<string>"


class CommittedTable:
    """``schema`` (DDL, partition columns last) of the rows; ``partition_by`` are folders within a segment."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.partition_by = spark, path.rstrip("/"), schema, partition_by
        self.ledger, self.data = f"{self.path}/ledger", f"{self.path}/data"

    # -------------------------------------------------------------- files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _commit(self, name: str, entry: dict) -> bool:
        """Rename a ledger file into place; False if it stands there already."""
        final = f"{self.ledger}/{name}.json"
        if self._exists(final):
            return False
        fs, hidden = self._fs(f"{self.ledger}/.{name}-{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
        out.close()
        return fs.rename(hidden, self._fs(final)[1])

    # -------------------------------------------------------------- entries

    def entries(self) -> list[dict]:
        """Ledger entries whose segment no other entry replaces (as many as live segments; ``compact`` bounds them)."""
        if not self._exists(self.ledger):
            return []
        all_ = [r.asDict() for r in self.spark.read.schema(LEDGER_SCHEMA).json(self.ledger).collect()]
        gone = {s for e in all_ for s in e["replaces"] or ()}
        return sorted((e for e in all_ if e["segment"] not in gone), key=lambda e: (e["last_batch"], e["segment"]))

    def last_merged(self) -> int:
        return max((e["last_batch"] for e in self.entries() if e["replaces"]), default=-1)

    def committed(self, batch_id: int) -> bool:
        return self._exists(f"{self.ledger}/{_name(batch_id)}.json") or batch_id <= self.last_merged()

    # -------------------------------------------------------------- rows

    def _write(self, df: DataFrame) -> tuple[str, int, int]:
        segment = uuid.uuid4().hex
        path = f"{self.data}/segment={segment}"
        seen = df.observe(o := _observation(), F.count(F.lit(1)).alias("n"))
        w = seen.write.mode("errorifexists")
        (w.partitionBy(*self.partition_by) if self.partition_by else w).parquet(path)
        fs, p = self._fs(path)
        files, found = 0, fs.listFiles(p, True)
        while found.hasNext():
            files += found.next().getPath().getName().startswith("part-")
        return segment, int(o.get["n"]), files

    def append(self, df: DataFrame, batch_id: int) -> bool:
        """Add a micro-batch; False (and nothing written) if it is part of the table already."""
        if self.committed(batch_id):
            return False
        segment, rows, files = self._write(df)
        return self._commit(_name(batch_id), {"batch_id": batch_id, "segment": segment, "rows": rows, "files": files, "last_batch": batch_id})

    def segments(self, names: list[str]) -> DataFrame:
        """The rows of some segments."""
        if not names:
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(self.schema).option("basePath", self.data)
        return read.parquet(*[f"{self.data}/segment={s}" for s in names]).drop("segment")

    def read(self) -> DataFrame:
        return self.segments([e["segment"] for e in self.entries() if e["rows"]])

    def stream_of_commits(self) -> DataFrame:
        """Committed batches as a stream of ledger rows (merges are rows with ``replaces``)."""
        fs, p = self._fs(self.ledger)
        fs.mkdirs(p)
        return self.spark.readStream.schema(LEDGER_SCHEMA).json(self.ledger)

    # -------------------------------------------------------------- maintenance

    def compact(self, files: int = 1, least: int = 2, fold_ledger: bool = True) -> bool:
        """Merge all segments of more than ``files`` files in total into ``files``; readers see the old or the new ones.

        ``fold_ledger`` drops the ledger files of the merged batches (not for a
        ledger that is read as a stream).
        """
        live = self.entries()
        if len(live) < least:
            return False
        names = [e["segment"] for e in live]
        merged = self.segments(names)
        merged = merged.repartitionByRange(files, *self.partition_by) if self.partition_by else merged.coalesce(files)
        segment, rows, n = self._write(merged)
        if rows != sum(e["rows"] for e in live):
            raise RuntimeError("a merged segment must hold the rows of those it replaces")
        last = max(e["last_batch"] for e in live)
        done = self._commit(f"merge-{time.time_ns()}-{uuid.uuid4().hex}", {"batch_id": None, "segment": segment, "rows": rows, "files": n,
                                                                           "last_batch": last, "replaces": names})
        if done and fold_ledger:
            for e in live:
                if not e["replaces"]:
                    fs, p = self._fs(f"{self.ledger}/{_name(e['batch_id'])}.json")
                    fs.delete(p, False)
        return done

    def vacuum(self) -> int:
        """Delete the segments that no entry names: replaced ones and those of failed attempts (no writer may be running)."""
        if not self._exists(self.data):
            return 0
        live = {e["segment"] for e in self.entries()}
        fs, p = self._fs(self.data)
        old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().removeprefix("segment=") not in live]
        for x in old:
            fs.delete(x, True)
        return len(old)


def _name(batch_id: int) -> str:
    return f"batch-{batch_id:020d}"


def _observation():
    from pyspark.sql import Observation
    return Observation()
