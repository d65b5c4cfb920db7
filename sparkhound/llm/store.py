"""Shared storage and global order, used by the operators of this subpackage.

Intermediate tables are written as Parquet to the folder in ``spark.checkpoint.dir``, which every executor can read, so a
lost executor costs a re-read and never a recomputation of the lineage before it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session on one machine may go without naming it: it gets a folder of its own there."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkhound-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def own_dir(spark: SparkSession) -> str:
    """The application's part of the shared folder; it goes when the application ends."""
    own = f"{shared_dir(spark)}/kept/{spark.sparkContext.applicationId}"
    system, folder = _files(spark, own)
    system.deleteOnExit(folder)
    return own


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by keep() that nothing reads any more."""
    for df in tables:
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/kept/" in root:
                system, path = _files(df.sparkSession, root)
                system.delete(path, True)


#: Bits of a row bit map, a fixed size whatever the input.
BITS = 1 << 23


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``_marked``: true for every ``_row`` of ``ids`` and, the map being of fixed size, for some others.

    The map's words are joined to the rows, so texts pass by without going to Python, and a task that sends them there
    afterwards needs no second worker.
    """
    place, bit = F.pmod(F.xxhash64("_row"), F.lit(BITS)), lambda p: (p % 64).cast("int")
    words = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("_bits"))
    found = rows.withColumn("_place", place).withColumn("_word", F.floor(F.col("_place") / 64)).join(F.broadcast(words), "_word", "left")
    set_ = F.getbit(F.coalesce("_bits", F.lit(0)), bit(F.col("_place"))) == 1
    return found.withColumn("_marked", set_).select(*rows.columns, "_marked")


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``_row`` is not in ``ids(_row)``. Only rows that a bit map leaves open are shuffled to the anti-join."""
    marked = _marked(rows, ids)
    clear = marked.where("NOT _marked").drop("_marked")
    return clear.unionByName(marked.where("_marked").drop("_marked").join(ids, "_row", "left_anti"))


def likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose ``_row`` is in ``ids(_row)`` and, as the map is of fixed size, some others: for an inner join to decide."""
    return _marked(rows, ids).where("_marked").drop("_marked")


REST = "__rest"


def packed(docs: DataFrame, used: list[str]) -> DataFrame:
    """``docs`` as the used columns and one struct of all others, so that no working column can clash with theirs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*others) if others else F.struct(F.lit(0).alias("none"))).alias(REST))


def numbered(docs: DataFrame, used: list[str], name: str) -> DataFrame:
    """packed() with ``_row``, a number for each row that stays the same whenever the result is computed.

    Rows of Parquet files, read as they are, are numbered by file and place in it, and are not copied; the driver gets the
    paths, which it holds anyway. Any other table is written once with its numbers.
    """
    spark, plan = docs.sparkSession, docs._jdf.queryExecution().analyzed()
    files = plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
    if not files or plan.relation().fileFormat().toString() != "Parquet" or "_metadata" in docs.columns:
        return keep(packed(docs, used).withColumn("_row", F.monotonically_increasing_id()), name)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    known = F.broadcast(spark.createDataFrame([(p, k << 40) for k, p in enumerate(paths)], "_path string, _first long"))
    rows = docs.select(*used, rest.alias(REST), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
    return rows.join(known, "_path").withColumn("_row", F.col("_first") + F.col("_at")).drop("_path", "_first", "_at")


def unpacked(df: DataFrame, columns: list[str], used: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in used else F.col(REST)[c].alias(c) for c in columns])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """What is computed inside crosses to Python so many rows, or some 4 MB, at a time; the session's own settings hold again afterwards."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def sliced(batches, rows: int = 500):
    """Batches of at most ``rows`` rows: what Python holds at once stays small. Spark itself bounds a batch's bytes."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _running(column: str):
    def run(batches):
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.num_rows
            size = b.column(b.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = total + np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n, dtype=np.int64)), pa.array(upto)],
                [*b.schema.names, "_part", "_row", "_upto"],
            )
            rows, total = rows + n, int(upto[-1]) if n else total

    return run


def positions(df: DataFrame, keys: list, size: str, name: str) -> DataFrame:
    """Global order without one task seeing all rows.

    Rows are range-partitioned by ``keys``, summed inside each partition and written; only one total per partition (their
    number is ``spark.sql.shuffle.partitions``, whatever the input) is added up across partitions and broadcast back.
    Adds ``row`` (0-based rank) and ``upto`` (inclusive running sum of ``size``).
    """
    spark = df.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    laid = keep(
        df.repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*keys).mapInArrow(_running(size), f"{schema}, _part int, _row long, _upto long"),
        name,
    )
    totals = sorted(laid.groupBy("_part").agg(F.count("*").alias("n"), F.sum(size).alias("s")).collect())
    starts, rows, total = [], 0, 0
    for t in totals:
        starts.append((t["_part"], rows, total))
        rows, total = rows + t["n"], total + t["s"]
    at = spark.createDataFrame(starts, "_part int, _rows long, _total long")
    return laid.join(F.broadcast(at), "_part").select(*df.columns, (F.col("_row") + F.col("_rows")).alias("row"), (F.col("_upto") + F.col("_total")).alias("upto"))
