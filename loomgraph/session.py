"""Session settings the engine is written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input files to a partition of rows that are to be collected into lists: some 100 MB unpacked.
SPREAD_BYTES = 8 << 20

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.maxPlanStringLength": "20000",
}


def session(app: str = "loomgraph", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a local session (tests) gets a temporary one."""
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    if option.isDefined():
        return option.get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: one job, and lost executors cost no recomputation beyond it."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/loomgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` as plain rows, into partitions that an aggregation to lists can sort in memory.

    From some size on their number follows from the input, as partitions of the size that adaptive execution aims at
    grow to many times that when unpacked. It never goes under what the session sets.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 50)
    if known < 4 * SPREAD_BYTES:
        return df.repartition(*keys)
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // SPREAD_BYTES), *keys)
