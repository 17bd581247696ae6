"""Tables that streams replace as a whole, each version named by the batch that made it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

START = -1


class Versioned:
    """A table as immutable versions ``v=<batch>`` and a log of commits, one empty file for each committed batch.

    A version counts once its commit file is there; the newest commit is the table.
    The file is made under another name and renamed, so it is there or it is not.
    State is read from the log at each batch, never held by the driver: a stream may
    stop anywhere and go on from its checkpoint.  A batch whose commit is there has
    been done; one whose version was written without a commit is written again.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _log(self) -> list[int]:
        folder = self._path("commits")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.lstrip("-").isdigit())

    def last(self) -> int | None:
        """The newest committed batch."""
        return max(self._log(), default=None)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={self.last()}")

    def commit(self, rows: DataFrame, batch: int) -> None:
        """Make ``rows`` the table as of ``batch``."""
        rows.write.mode("overwrite").parquet(f"{self.root}/v={batch}")
        self._mark(batch)
        # A reader of the last versions may still be at work; older ones go.
        for old in self._log()[: -self.keep]:
            self.fs.delete(self._path(f"commits/{old}"), False)
            self.fs.delete(self._path(f"v={old}"), True)

    def _mark(self, batch: int) -> None:
        """Write the commit file of a batch."""
        made, name = self._path(f"commits/.{batch}.new"), self._path(f"commits/{batch}")
        self.fs.create(made, True).close()
        if not self.fs.rename(made, name):
            raise RuntimeError(f"cannot commit batch {batch} below {self.root}")

    def start(self, rows: DataFrame) -> None:
        """The table before any batch, unless there is one."""
        if self.last() is None:
            self.commit(rows, START)

    def step(self, change: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each batch once makes the next version of ``change(table, rows)``."""

        def put(rows: DataFrame, batch: int) -> None:
            last = self.last()
            if last is None or last < batch:
                self.commit(change(self.read(), rows), batch)

        return put


class Layered(Versioned):
    """A table of sets of rows by ``key``: a batch writes the sets that it puts as a layer, and of a key the newest layer's set counts.

    Below the layers ``v=<batch>`` lies ``base/v=<batch>``, the whole table as of a
    batch.  What is written so grows with what is put, not with table and batches.
    Layers that have more than ``MERGED`` times the rows of the base become the next
    base; they and the base before stay until then for those that still read them.
    """

    MERGED = 2

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str):
        super().__init__(spark, root)
        self.key, self.schema = key, schema

    def _bases(self) -> list[int]:
        """Committed batches as of which the whole table is there."""
        return [n for n in self._log() if self.fs.exists(self._path(f"base/v={n}"))]

    def _whole(self, base: int, layers: list[int]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/base/v={base}")
        if not layers:
            return rows
        put = self.spark.read.schema(f"{self.schema}, v int").option("basePath", self.root).parquet(*[f"{self.root}/v={n}" for n in layers])
        kept = put
        if len(layers) > 1:
            # Few as a rule, and written, so that the rows need not be shuffled to leave them out.
            places = put.groupBy(self.key).agg(F.array_sort(F.collect_set("v")).alias("v"))
            older = materialise(places.select(self.key, F.explode(F.slice("v", F.lit(1), F.size("v") - 1)).alias("v")), "older-sets")
            kept = put.join(older, [self.key, "v"], "left_anti")
        return rows.join(put.select(self.key).distinct(), self.key, "left_anti").select(rows.columns).unionByName(kept.select(rows.columns))

    def read(self) -> DataFrame:
        base = self._bases()[-1]
        return self._whole(base, [n for n in self._log() if n > base])

    def commit(self, rows: DataFrame, batch: int) -> None:
        """Put the sets of ``rows``; before all batches ``rows`` are the table."""
        if batch == START:
            rows.write.mode("overwrite").parquet(f"{self.root}/base/v={batch}")
            self._mark(batch)
            return
        rows.write.mode("overwrite").parquet(f"{self.root}/v={batch}")
        base = self._bases()[-1]
        layers = [*(n for n in self._log() if base < n < batch), batch]
        size = lambda *paths: self.spark.read.schema(self.schema).parquet(*paths).count()
        merged = size(*[f"{self.root}/v={n}" for n in layers]) > self.MERGED * size(f"{self.root}/base/v={base}")
        # What a batch left that did not come to its commit is not taken for a base.
        self.fs.delete(self._path(f"base/v={batch}"), True)
        if merged:
            self._whole(base, layers).write.parquet(f"{self.root}/base/v={batch}")
        self._mark(batch)
        for old in [n for n in self._log() if n < base] if merged else []:
            for name in (f"commits/{old}", f"v={old}", f"base/v={old}"):
                self.fs.delete(self._path(name), True)
