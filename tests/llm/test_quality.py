"""The classifier against its rules evaluated one by one in Python."""

import math
import random
import re
import zlib

import pytest

from sparkhound.llm import quality

SF = "/root/testdata/sf0.001"


def _statistics(text):
    t = text or ""
    words = [w for w in re.split(r"[\x09-\x0D\x20]+", t) if w]
    n, count = max(len(t), 1), max(len(words), 1)
    times = lambda chars: sum(c in chars for c in t)
    return {
        "symbol_share": times("!$%&*#@|<>{}[]\\/=+~^_") / n, "digit_share": times("0123456789") / n, "upper_share": times("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
        "bars_a_word": times("|") / count, "bangs_a_word": times("!?") / count, "marks_a_word": times("#$%&*") / count, "stops_a_word": times(".") / count,
        "repeated_neighbours": sum(a == b for a, b in zip(words, words[1:])) / count,
        "richness": math.log1p(len(set(words))) / math.log1p(len(words)) if words else 1.0,
    }


def _score(model, text):
    x = _statistics(text)
    total = model.bias
    for rule, weight in model.rules:
        if all(x[model.names[k]] > cut if above else x[model.names[k]] <= cut for k, above, cut in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_scores_equal_the_rules_one_by_one(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    assert model.rules
    odd = [(None, None), (10**6, ""), (10**6 + 1, "  \n\t "), (10**6 + 2, "word " * 30_000), (10**6 + 3, "|#$ é😀 a a a a!?"), (10**6 + 3, "|#$ é😀 a a a a!?")]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = [(r["doc_id"], r["text"]) for r in more.collect()]
    got = sorted((str(r["doc_id"]), r["score"], r["predicted"], r["held_out"]) for r in quality.quality(more, labels).collect())
    assert len(got) == len(texts)
    want = sorted((str(d), _score(model, t), d) for d, t in texts)
    for (i, score, predicted, held), (j, mine, d) in zip(got, want, strict=True):
        assert i == j and abs(score - mine) < 1e-9 and predicted == (score >= 0.3)
        assert held == (zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0)


def test_held_out_labels_have_no_say(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, turned)


def test_accepted_keeps_rows_as_they_are(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    rng = random.Random(2)
    texts = [r["text"] for r in docs.limit(60).collect()] + [None, "", "   "]
    rows = [(k % 50, t, rng.choice(["a", None]), "clash", 5, None) for k, t in enumerate(texts + texts[:5])]
    schema = "doc_id long, text string, source string, _score string, _words int, _stat_richness string"
    got = quality.accepted(spark.createDataFrame(rows, schema).repartition(3), model).collect()
    want = [r for r in rows if _score(model, r[1]) >= 0.3]
    key = lambda r: tuple((x is None, x or "") if not isinstance(x, int) else (False, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert quality.accepted(spark.createDataFrame([], schema), model).count() == 0
