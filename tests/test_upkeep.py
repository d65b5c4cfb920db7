"""Findings kept by a stream equal a full run after random edits."""

import random

from pyspark.sql import functions as F

from sparkhound.operators import changes
from sparkhound.streaming import upkeep


class Project:
    """Files with a text each; a file's findings are its words in capitals and those of the files that it imports directly."""

    def __init__(self, spark, seed):
        self.spark, self.r, self.files = spark, random.Random(seed), {}

    def edit(self):
        before = dict(self.files)
        for _ in range(self.r.randint(1, 3)):
            name = f"f{self.r.randrange(8)}"
            if name in self.files and self.r.random() < 0.3:
                del self.files[name]
            else:
                self.files[name] = (tuple(self.r.sample("ABCdef", 2)), tuple(f"f{self.r.randrange(8)}" for _ in range(self.r.randrange(3))))
        table = lambda files: self.spark.createDataFrame([(n, str(v)) for n, v in files.items()], "path string, cksum string")
        return changes.change_set(table(before), table(self.files))

    def imports(self):
        return self.spark.createDataFrame([(n, i) for n, (_, others) in self.files.items() for i in others], "file string, imported_file string")

    def findings(self):
        words = lambda n: [w for w in self.files.get(n, ((), ()))[0] if w.isupper()]
        return sorted({(n, w) for n, (_, others) in self.files.items() for x in (n, *others) for w in words(x)})

    def analyse(self, files):
        rows = self.spark.createDataFrame([(n, w) for n, w in self.findings()], "file string, rule string")
        return rows.join(files, "file", "left_semi")


def test_kept_findings_equal_a_full_run(spark, tmp_path):
    for seed in (1, 2):
        p, path = Project(spark, seed), str(tmp_path / f"kept{seed}")
        keep = upkeep.keeper(path, p.analyse, p.imports)
        for batch in range(6):
            edits = p.edit()
            keep(edits, batch)
            assert sorted(map(tuple, upkeep.current(spark, path).select("file", "rule").collect())) == p.findings()
        keep(edits, batch)  # a repeated batch changes nothing
        assert sorted(map(tuple, upkeep.current(spark, path).select("file", "rule").collect())) == p.findings()
        upkeep.compact(spark, path, batch, f"{path}-compact")
        assert sorted(map(tuple, upkeep.current(spark, f"{path}-compact").select("file", "rule").collect())) == p.findings()


def test_a_stream_drives_it(spark, tmp_path):
    source, path = str(tmp_path / "changes"), str(tmp_path / "kept")
    none = lambda: spark.createDataFrame([], "file string, imported_file string")
    keep = upkeep.keeper(path, lambda files: files.withColumn("rule", F.concat(F.lit("R-"), "file")), none)

    def drain():
        q = spark.readStream.schema("path string, change string").json(source).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    spark.createDataFrame([("a", "added"), ("b", "added")], "path string, change string").write.json(source)
    drain()
    spark.createDataFrame([("a", "removed"), ("c", "added")], "path string, change string").write.mode("append").json(source)
    drain()
    assert sorted(map(tuple, upkeep.current(spark, path).select("file", "rule").collect())) == [("b", "R-b"), ("c", "R-c")]
