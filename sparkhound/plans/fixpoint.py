"""Tables that cut lineage, and semi-naive iteration: each round joins only what the last one found."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The application's part of the folder in spark.checkpoint.dir; it goes when the application ends.

    Only a session on one machine may go without naming that folder: it gets a folder of its own there.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkhound-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    own = f"{found.rstrip('/')}/tables/{sc.applicationId}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(own)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return own


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and what a lost executor takes along is read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: it is sorted and merged, never sent whole through the driver.

    Planned by the size of a compressed file, or of a few of its columns, millions of rows look small enough to broadcast.
    """
    return df.hint("merge")


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """All rows reachable from ``seed`` by ``step(delta)``; the first row of a key wins. One look a round tells whether there are new rows.

    Keys must be finitely many, so the rounds end by themselves. Rounds are durable, so plans stay short and a lost executor costs one round.
    """
    seen = delta = durable(seed.dropDuplicates(keys))
    while True:
        delta = durable(step(delta).dropDuplicates(keys).join(large(seen.select(keys)), keys, "left_anti").select(seed.columns))
        if delta.isEmpty():
            return seen
        seen = seen.unionByName(delta)
