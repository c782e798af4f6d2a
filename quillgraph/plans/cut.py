"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Bits of an estimated size in bytes beyond which it is no estimate.
SIZE_BITS = 62


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; where that is unset, a temporary one, in local mode alone.

    On a cluster a missing setting is an error: executors would not see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    if found := sc.getCheckpointDir():
        return found
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillgraph-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder: later steps read it there, also after executors are lost.

    What is kept takes over the planner's estimate of its size, in which every join multiplies. In rounds of joins the estimate would get so many digits that
    planning never ends, so one beyond any real size is left behind with the old plan.
    """
    shared_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    run = kept._jdf.queryExecution()
    if run.analyzed().stats().sizeInBytes().bit_length() <= SIZE_BITS:
        return kept
    spark = kept.sparkSession
    return type(kept)(spark._jsparkSession.internalCreateDataFrame(run.toRdd(), kept._jdf.schema(), False), spark)
