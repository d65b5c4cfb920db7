"""Findings kept up to date from a stream of changes: each batch recomputes the files that its changes touch, and nothing else.

What is kept is a folder with one part for each batch: the files that it replaced and the findings that they have since. A
batch that is repeated writes the same part again, so it changes nothing; what counts for a file is the last batch that replaced it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import affected


def _part(path: str, batch: int) -> str:
    return f"{path}/batch={batch}"


def keeper(path: str, analyse: Callable[[DataFrame], DataFrame], imports: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch over changes(path, change).

    ``analyse`` gives findings (with a column ``file``) of files(file); ``imports`` gives imports(file, imported_file) as they are now.
    Files that are gone have no findings; files that import a changed one are looked at again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        changes = batch.select("path", "change").distinct()
        gone = changes.groupBy("path").agg(F.max_by("change", F.when(F.col("change") == "removed", 0).otherwise(1)).alias("change")).where("change = 'removed'").select(F.col("path").alias("file"))
        touched = affected(changes, imports())
        found = analyse(touched.join(gone, "file", "left_anti")).join(touched, "file", "left_semi")
        kept = touched.select("file", F.lit(True).alias("_replaced")).unionByName(found.withColumn("_replaced", F.lit(False)), allowMissingColumns=True)
        kept.write.mode("overwrite").parquet(_part(path, batch_id))

    return apply


def current(spark: SparkSession, path: str) -> DataFrame:
    """The findings that hold now: of each file, those of the last batch that replaced it."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    last = rows.where("_replaced").groupBy("file").agg(F.max("batch").alias("batch"))
    return rows.where("NOT _replaced").join(last, ["file", "batch"]).drop("_replaced", "batch")


def compact(spark: SparkSession, path: str, upto: int, to: str) -> None:
    """What batches up to ``upto`` keep, as the one part ``upto`` of another folder; later batches go on there."""
    rows = spark.read.option("mergeSchema", "true").parquet(path).where(F.col("batch") <= upto)
    last = rows.where("_replaced").groupBy("file").agg(F.max("batch").alias("batch"))
    rows.join(last, ["file", "batch"]).drop("batch").write.mode("overwrite").parquet(_part(to, upto))
