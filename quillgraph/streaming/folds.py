"""Incremental components and spanning forests: each micro-batch of edges is folded into a carried forest.

The state has at most V - 1 edges. It is written under the batch's number in the shared folder, and the state of batch b is read from
that of the latest batch before b, so a batch that is replayed gives the same state again. Edges can be added, not removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.components import star_edges
from quillgraph.operators.msf import minimum_spanning_forest


class Fold:
    """A `foreachBatch` function and its state."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """Numbers of the batches whose state is complete."""
        if not self.fs.exists(self.path):
            return []
        names = [s.getPath() for s in self.fs.listStatus(self.path)]
        return sorted(int(p.getName()[6:]) for p in names if p.getName().startswith("batch=") and self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def state(self, before: int | None = None) -> DataFrame | None:
        known = [b for b in self.batches() if before is None or b < before]
        return self.spark.read.parquet(f"{self.folder}/batch={known[-1]}") if known else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        old = self.state(number)
        edges = self.edges(batch)
        self.step(edges if old is None else old.unionByName(edges)).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")

    def edges(self, batch: DataFrame) -> DataFrame:
        raise NotImplementedError

    def step(self, edges: DataFrame) -> DataFrame:
        raise NotImplementedError


class ComponentsFold(Fold):
    """Carries (u, v), v the least vertex of u's component."""

    def edges(self, batch: DataFrame) -> DataFrame:
        return batch.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v"))

    def step(self, edges: DataFrame) -> DataFrame:
        return star_edges(edges, "u", "v")


class ForestFold(Fold):
    """Carries the minimum spanning forest (eid, u, v, w); `eid` is to be the same when an edge is replayed."""

    def edges(self, batch: DataFrame) -> DataFrame:
        return batch.select("eid", "u", "v", "w")

    def step(self, edges: DataFrame) -> DataFrame:
        return minimum_spanning_forest(edges.dropDuplicates(["eid"]))
