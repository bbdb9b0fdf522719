"""Tables in the cluster's shared checkpoint folder, to cut lineage in loops."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Writes a table to spark.checkpoint.dir and reads it again.

    Only where that setting is absent and the session is a local one, as in tests, a folder
    below /tmp is used; on a cluster each machine would write to a disk of its own. `drop`
    deletes what no later step reads; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str, codec: str = "snappy"):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        self.codec, self.spark, self.root, self.n = codec, spark, f"{(base or 'file:/tmp/checkpoints').rstrip('/')}/flowloom/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self._end)

    def save(self, df: DataFrame) -> DataFrame:
        return self.counted(df, F.lit(True))[0]

    def counted(self, df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
        """The table, and how many of its rows met a condition while it was written."""
        self.n += 1
        path, seen = f"{self.root}/{self.n:04d}", Observation()
        df.observe(seen, F.count_if(condition).alias("n")).write.option("compression", self.codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]

    def drop(self, *names: str) -> None:
        """Deletes tables below the root; without names all of them."""
        jvm = self.spark.sparkContext._jvm
        for name in names or ("",):
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _end(self) -> None:
        try:
            self.drop()
        except Exception:  # noqa: BLE001  the session has ended before: its folder goes with it
            pass
