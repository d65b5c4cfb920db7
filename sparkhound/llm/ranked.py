"""Ranked lexical search: a blocked sparse product of item terms with term impacts in documents.

Items are cut into blocks of bounded size. For each block of items the corpus is read once: a document becomes the places and
counts of the block's terms in it, and its number of terms. From those rows come the corpus counts (documents with terms, all
terms, documents of each term), then whole-number impacts. A task holds a block of documents as a sparse matrix with a row for
each term; the rows of an item's terms are merged into one accumulator (Gustavson), whose best entries stay. What tasks have
kept is reduced in two steps, so no task sees more than a share of it.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import forget, keep, positions, sliced

TOP = 50
#: Items and item-term entries in a block of items, at most (but for one item's own).
ITEMS, ENTRIES = 4096, 1 << 17
#: Documents and entries in a block of documents, about.
BLOCK, BLOCK_ENTRIES = 16384, 1 << 21
#: Groups in which an item's rows are first reduced.
SALT = 256
#: Any other ASCII character than a digit or a letter ends a term; capitals become small.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """All terms with repeats. Null: none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split(b" ")


def counted(text: str | None) -> Counter:
    found = Counter(terms(text))
    del found[b""]
    return found


def _item_terms(batches):
    for b in sliced(batches):
        ids, found = b.column(0), [list(counted(t).items()) for t in b.column(1).to_pylist()]
        at = np.repeat(np.arange(b.num_rows), [len(f) for f in found])
        flat = [x for f in found for x in f]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([t for t, _ in flat], pa.binary()), pa.array([n for _, n in flat], pa.int64())], ["item_id", "term", "times"])


def _found(words: dict[bytes, int]):
    """Documents as the block's terms in them (places and counts), with the number of all their terms."""

    def run(batches):
        for b in sliced(batches):
            sizes, places, times, ends = [], [], [], [0]
            for text in b.column(1).to_pylist():
                found = counted(text)
                sizes.append(found.total())
                for t in words.keys() & found.keys() if len(words) < len(found) else [t for t in found if t in words]:
                    places.append(words[t])
                    times.append(found[t])
                ends.append(len(places))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (places, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "places", "times"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _best(score: np.ndarray, doc: np.ndarray, none: np.ndarray, top: int) -> np.ndarray:
    """Places of the best: highest score, then smallest doc_id, null last."""
    if len(score) > top:  # what is below the last place's score goes before anything is sorted
        at = np.flatnonzero(score >= np.partition(score, len(score) - top)[len(score) - top])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((doc[at], none[at], -score[at]))][:top]


class _Product:
    """A task's product: best documents of each item so far, block of documents by block."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, all_terms: int, top: int):
        self.items, self.weights, self.n_docs, self.all_terms, self.top = items, weights, n_docs, all_terms, top
        none = np.zeros(0, np.int64)
        self.best = [(none, none, none.astype(bool))] * len(items)

    def add(self, doc: np.ndarray, none: np.ndarray, n: np.ndarray, lengths: np.ndarray, places: np.ndarray, times: np.ndarray) -> None:
        m = 50 + 50 * n * self.n_docs // self.all_terms
        row = np.repeat(np.arange(len(doc)), lengths)
        impact = self.weights[places] * (1_000_000_000 * times // (1000 * times + 20 * m[row]))
        order = np.argsort(places, kind="stable")
        row, impact = row[order], impact[order]
        start = np.searchsorted(places[order], np.arange(len(self.weights) + 1))
        total = np.zeros(len(doc), np.int64)
        for k, (own, times_in_item) in enumerate(self.items):
            total[:] = 0
            for t, q in zip(own.tolist(), times_in_item.tolist(), strict=True):
                a, b = start[t], start[t + 1]
                if a < b:
                    total[row[a:b]] += q * impact[a:b]  # a document stands once in a term's row
            score, best_doc, best_none = self.best[k]
            least = max(1, score[-1]) if len(score) == self.top else 1
            at = np.flatnonzero(total >= least)
            if len(at):
                score, best_doc, best_none = np.append(score, total[at]), np.append(best_doc, doc[at]), np.append(best_none, none[at])
                chosen = _best(score, best_doc, best_none, self.top)
                self.best[k] = score[chosen], best_doc[chosen], best_none[chosen]


def _multiplied(held):
    def run(batches):
        items, *rest = held.value
        product, part = _Product(items, *rest), TaskContext.get().partitionId()
        waiting, docs, entries = [], 0, 0

        def take():
            if waiting:
                product.add(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                waiting.clear()

        for b in batches:
            places, times = b.column(2), b.column(3)
            waiting.append((b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(0).is_null().to_numpy(zero_copy_only=False), b.column(1).to_numpy(), places.value_lengths().to_numpy(), places.flatten().to_numpy(), times.flatten().to_numpy()))
            docs, entries = docs + b.num_rows, entries + len(waiting[-1][4])
            if docs >= BLOCK or entries >= BLOCK_ENTRIES:
                take()
                docs = entries = 0
        take()
        for k, (score, doc, none) in enumerate(product.best):
            if len(score):
                fill = lambda x: pa.array(np.full(len(score), x, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([fill(k), fill(part), pa.array(doc, mask=none), pa.array(score)], ["item", "part", "doc_id", "score"])

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): each distinct term of an item; rows of one item_id are one item, null being one too."""
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, term binary, times bigint").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, repeats: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    A term counts once for an item or, with ``repeats``, as often as the item has it. Equal scores go by ascending doc_id, null last; rows of one doc_id are documents
    of their own. Null and empty texts have no terms: such documents count for nothing, such items have no rows. Any table may be empty. Scores are exact 64-bit
    integers. Other columns are left out.
    """
    spark = docs.sparkSession
    entries = keep(item_terms(items), "item-terms")
    sizes = positions(entries.groupBy("item_id").agg(F.count("*").alias("n")), ["item_id"], "n", "items")
    placed = keep(sizes.select(F.col("item_id").alias("id"), "row", (F.floor(F.col("row") / ITEMS) + F.floor(F.col("upto") / ENTRIES)).cast("long").alias("block")), "item-blocks")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = []
    for block in [r["block"] for r in placed.select("block").distinct().orderBy("block").toLocalIterator()]:
        # bounded by ITEMS and ENTRIES, whatever the number of items
        own = entries.join(placed.where(F.col("block") == block), F.col("item_id").eqNullSafe(F.col("id"))).select("row", "term", "times").orderBy("row", "term").collect()
        words = {t: k for k, t in enumerate(sorted({bytes(r["term"]) for r in own}))}
        numbers, by_item = sorted({r["row"] for r in own}), {}
        for r in own:
            by_item.setdefault(r["row"], []).append((words[bytes(r["term"])], r["times"] if repeats else 1))
        rows = keep(docs.select("doc_id", "text").mapInArrow(_found(words), f"doc_id {kind}, n bigint, places array<bigint>, times array<bigint>"), "term-counts")
        counts = rows.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if counts["docs"]:
            df = {r["t"]: r["df"] for r in rows.select(F.explode("places").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
            weights = np.array([weight(counts["docs"], df.get(k, 0)) for k in range(len(words))], np.int64)
            matrix = [tuple(np.array(x, np.int64) for x in zip(*by_item[k], strict=True)) for k in numbers]
            held = spark.sparkContext.broadcast((matrix, weights, counts["docs"], counts["terms"], top))
            best = keep(rows.where("size(places) > 0").mapInArrow(_multiplied(held), f"item bigint, part bigint, doc_id {kind}, score bigint"), "best")
            parts.append(best.select((F.lit(numbers[0]) + F.col("item")).alias("row"), "part", "doc_id", "score"))
        forget(rows)
    if not parts:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {kind}, score bigint")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("salt", F.pmod("part", F.lit(SALT)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("row", "salt").orderBy(*first))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*first))).where(F.col("rank") <= top)
    return ranked.join(placed.select("row", F.col("id").alias("item_id")), "row").select("item_id", "rank", "doc_id", "score")


ORACLE = """
    WITH lower_ AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    found AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(t, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM lower_),
    sized AS (SELECT d, doc_id, ts, len(ts) AS n FROM found WHERE len(ts) > 0),
    total AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM sized),
    asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
    ),
    tfs AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tfs, total GROUP BY term),
    scores AS (
        SELECT a.item_id, s.d, s.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // l)))) AS BIGINT) AS score
        FROM asked a JOIN tfs USING (term) JOIN weights USING (term) JOIN sized s USING (d), total GROUP BY ALL
    )
    SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
    WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 50
"""
