"""Row numbers, bit maps and settings that operators leave behind."""

import pytest
from pyspark.sql import functions as F

from sparkhound.llm import similar, store

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "a b%20c.parquet")
    rows = [(k if k % 7 else None, f"one two three four five six {k // 2}" if k % 5 else None, "p", 1, "m") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, _path string, _row int, __rest string").repartition(4).write.parquet(path)
    return path


def test_rows_of_files_keep_their_numbers(spark, table):
    docs = spark.read.parquet(table)
    got = store.numbered(docs, ["doc_id", "text"], "x")
    assert "kept" not in "".join(got.inputFiles()) and got.select("_row").distinct().count() == 60
    seen = {r["_row"]: (r["doc_id"], r["text"]) for r in got.collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # other splits, same numbers
    try:
        again = {r["_row"]: (r["doc_id"], r["text"]) for r in store.numbered(spark.read.parquet(table), ["doc_id", "text"], "x").repartition(5).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert again == seen
    assert store.unpacked(got, docs.columns, ["doc_id", "text"]).columns == docs.columns


def test_other_tables_are_written_once(spark, table):
    docs = spark.read.parquet(table)
    for other in (docs.where("doc_id > 3"), docs.withColumn("_metadata", F.lit(1)), docs.repartition(3)):
        got = store.numbered(other, ["doc_id", "text"], "x")
        assert "kept" in "".join(got.inputFiles()) and got.select("_row").distinct().count() == other.count()


def test_rows_without_and_likely(spark):
    rows = spark.range(3000).select(F.col("id").alias("_row"), (F.col("id") % 3).alias("x"))
    ids = rows.where("_row % 10 = 1").select("_row")
    assert sorted(r["_row"] for r in store.without(rows, ids).collect()) == [k for k in range(3000) if k % 10 != 1]
    likely = {r["_row"] for r in store.likely(rows, ids).collect()}
    assert {k for k in range(3000) if k % 10 == 1} <= likely and len(likely) < 400
    none = ids.limit(0)
    assert store.without(rows, none).count() == 3000 and store.likely(rows, none).count() == 0


def test_marking_sends_nothing_to_python(spark):
    rows = spark.range(3000).select(F.col("id").alias("_row"), F.col("id").cast("string").alias("text"))
    ids = rows.where("_row % 10 = 1").select("_row")
    for got in (store.without(rows, ids), store.likely(rows, ids)):
        assert got.columns == rows.columns and "Python" not in got._jdf.queryExecution().toString()
    # a task that goes on to Python with the texts holds one worker, not two
    plan = store.without(rows, ids).select(similar._set("text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") + plan.count(":- ArrowEvalPython") <= 2  # the branches of the union


def test_near_duplicates_with_clashing_names(spark, table):
    docs = spark.read.parquet(table)
    before = spark.conf.get(KEY)
    got = similar.one_of_each(docs)
    assert got.columns == docs.columns and spark.conf.get(KEY) == before
    texts = {r["text"] or "" for r in docs.collect()}
    kept = [r["text"] or "" for r in got.collect()]
    assert len(kept) == len(texts) and set(kept) == texts


def test_settings_come_back_after_an_error(spark):
    before = spark.conf.get(KEY)
    with pytest.raises(ValueError), store.small_batches(spark, 7):
        assert spark.conf.get(KEY) == "7"
        raise ValueError
    assert spark.conf.get(KEY) == before
