"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

A document's failures are five bits. A table made once says for each of the 32 sets of failures and each of the 120 orders
which step removes such a document first. Tasks index it with their documents' bits, count removals by part, order, step and
label with np.bincount, and send on one array for each part and order; the arrays are summed.
"""

from __future__ import annotations

import string
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep, sliced

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Filter at each step of each order.
AT_STEP = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
FAILS = (np.arange(32)[:, None] >> np.arange(5) & 1).astype(bool)
#: Step (from 0) that removes a document with these failures under this order; 5: none does.
FIRST = np.where(FAILS.any(1)[:, None], FAILS[:, AT_STEP].argmax(2), 5).astype(np.int64)
#: A document with many parts is no matter; a task sends on what it has counted when it holds so many parts.
HELD_PARTS = 512
UPPER, SYMBOLS = string.ascii_uppercase.encode(), b"#$%&*|"
WORDS, DISTINCT, CAPITALS = 100, 80, 10
_CELLS = ["total", *(f"{k}{i}" for k in ("removed", "good", "toxic", "fails", "unique", "shapley") for i in range(5))]


def own_failures(text: str | None) -> int:
    """Bits A to D of a text: few words, few distinct words, many capitals, a symbol. A null text counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at ASCII white space only
    capitals = len(raw) - len(raw.translate(None, UPPER))
    symbols = len(raw.translate(None, SYMBOLS)) < len(raw)
    return (len(words) < WORDS) | (100 * len(set(words)) < DISTINCT * len(words)) << 1 | (100 * capitals > CAPITALS * len(text)) << 2 | symbols << 3


def _bits(batches):
    for b in sliced(batches):
        texts = [t or "" for t in b.column(2).to_pylist()]
        digests = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([own_failures(t) for t in texts], pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "bits", "digest"])


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, bits) for each row of ``docs``: bits 1, 2, 4, 8, 16 for A to E.

    E holds if a row with a smaller doc_id has the same text, anywhere in the table; texts are the same if their 128-bit digests
    are. Rows of one doc_id are no copies of each other, and a null doc_id is neither smaller nor larger than any. A null text
    counts as the empty text, a null part as the empty string. Other columns are left out.
    """
    chosen = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    rows = keep(chosen.mapInArrow(_bits, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, part string, bits int, digest binary"), "failures")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("most > least").select("digest", "least")
    late = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * 16
    return rows.join(copies, "digest", "left").select("doc_id", "part", (F.col("bits") + late).alias("bits"))


def _counted(parts: int, part: np.ndarray, bits: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """[parts, 120, 31]: the cells of _CELLS."""
    out = np.zeros((parts, len(ORDERS), len(_CELLS)), np.int64)
    key = (part[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * 6 + FIRST[bits]
    steps = [np.bincount(key[chosen].ravel(), minlength=parts * len(ORDERS) * 6).reshape(parts, len(ORDERS), 6)[:, :, :5] for chosen in (slice(None), good, toxic)]
    sets = np.bincount(part * 32 + bits, minlength=parts * 32).reshape(parts, 32)
    out[:, :, 0] = sets.sum(1)[:, None]
    for k, s in enumerate(steps):
        out[:, :, 1 + 5 * k : 6 + 5 * k] = s
    fails, unique = sets @ FAILS, sets[:, 1 << np.arange(5)]
    removed = np.zeros((parts, len(ORDERS), 5), np.int64)
    np.put_along_axis(removed, np.broadcast_to(AT_STEP, removed.shape), steps[0], 2)
    for k, f in enumerate((fails, unique, removed.sum(1))):
        out[:, :, 16 + 5 * k : 21 + 5 * k] = f[:, AT_STEP]
    return out


def _tallied(batches):
    """(part, order, cells): what this task's rows count, for each part and order; rows are (part, bits, good, toxic)."""
    held: dict[str, np.ndarray] = {}

    def sent():
        names = list(held)
        cells = np.concatenate(list(held.values())).reshape(-1)
        ends = pa.array(np.arange(0, len(cells) + 1, len(_CELLS)), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(cells))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, object), len(ORDERS)), pa.string()), pa.array(np.tile(np.arange(len(ORDERS), dtype=np.int32), len(names))), lists], ["part", "order", "cells"])

    for b in sliced(batches, 8192):
        coded = pc.dictionary_encode(b.column(0))
        names = coded.dictionary.to_pylist()
        part, bits = coded.indices.to_numpy().astype(np.int64), b.column(1).to_numpy().astype(np.int64)
        good, toxic = (b.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (2, 3))
        at_once = max(1, HELD_PARTS)
        for low in range(0, len(names), at_once):  # a batch may bring as many parts as rows
            own = (part >= low) & (part < low + at_once)
            some = names[low : low + at_once]
            for name, cells in zip(some, _counted(len(some), part[own] - low, bits[own], good[own], toxic[own]), strict=True):
                held[name] = held[name] + cells if name in held else cells
            if len(held) >= HELD_PARTS:
                yield sent()
    if held:
        yield sent()


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step (from 1), zeros included.

    kept, removed, redundant (fails this step's filter, was removed before), unique_fails (fails this filter only), good_lost and
    toxic_lost (removed here, with such a label), shapley (removed by this step's filter, summed over all orders). Of several label rows of
    a doc_id one that says 1 is enough; documents without label, or without doc_id, count as neither. An empty table has no parts.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = failures(docs, part).join(marks, "doc_id", "left")
    said = marked.select("part", "bits", (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))
    arrays = said.mapInArrow(_tallied, "part string, `order` int, cells array<bigint>")
    sums = arrays.groupBy("part", "order").agg(*[F.sum(F.col("cells")[k]).alias(name) for k, name in enumerate(_CELLS)])
    names = F.array(*[F.lit(o) for o in ORDERS])
    before = lambda k: sum((F.col(f"removed{j}") for j in range(k + 1)), F.lit(0).cast("long"))
    steps = F.array(
        *[
            F.struct(
                F.lit(k + 1).alias("step"), (F.col("total") - before(k)).alias("kept"), F.col(f"removed{k}").alias("removed"), (F.col(f"fails{k}") - F.col(f"removed{k}")).alias("redundant"),
                F.col(f"unique{k}").alias("unique_fails"), F.col(f"good{k}").alias("good_lost"), F.col(f"toxic{k}").alias("toxic_lost"), F.col(f"shapley{k}").alias("shapley"),
            )
            for k in range(5)
        ]
    )
    return sums.select("part", F.get(names, F.col("order")).alias("filter_order"), F.explode(steps).alias("s")).select("part", "filter_order", "s.*")


ORACLE = """
    WITH RECURSIVE w AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
    ), copies AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
    marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    d AS (
        SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            concat(CASE WHEN len(words) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * (length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g'))) > 10 * length(w.text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS fails
        FROM w JOIN copies USING (text) LEFT JOIN marks USING (doc_id)
    ), counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
    orders(o) AS (SELECT '' UNION ALL SELECT concat(o, f) FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE length(o) < 5 AND NOT contains(o, f)),
    steps AS (SELECT o, CAST(s AS INTEGER) AS step, o[s:s] AS f, o[1:s-1] AS before FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
    cells AS (
        SELECT part, o AS filter_order, step, f,
            sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
        FROM (SELECT *, contains(fails, f) AS here, length(translate(fails, before, '')) < length(fails) AS gone FROM counts, steps) GROUP BY ALL
    )
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM cells
"""
