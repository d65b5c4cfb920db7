"""SimHash near-duplicates: byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes at eight positions. Fingerprints that differ in at most ``bits`` bits differ in at most
``bits`` bytes, so they share at least ``8 - bits`` positional bytes: the guaranteed minimum count. The index holds postings of
positional byte pairs: of the four pairs of neighbouring bytes at least ``4 - bits`` are equal, so a posting stands for each
choice of so many pairs and the bytes there. Postings of single bytes would hold 1/256 of all rows each; these hold what agrees
in four bytes. Inside a posting the equal positional bytes of pairs are tallied, pairs that reach the guaranteed minimum are
retained and verified bit by bit, and what is verified is joined into a forest of at most (members - 1) links, never all pairs.
A posting of more than ``LARGE`` members is dealt anew by two more equal bytes; only two bytes are then free, so it holds at most
65,536 fingerprints, whatever the input.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import keep, numbered, small_batches, unpacked, without

SEED = 42
BITS = 2
SHINGLE = 3
#: Members of a posting above which it is dealt by more bytes.
LARGE = 4096


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``shingle`` words (of all words, if there are fewer), repeats included. No words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is set if over half the shingles' hashes have it. No words: 0."""
    return from_hashes(hashes(text, shingle))


def from_hashes(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):  # bounded memory for long texts
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def as_signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` and ``_fp`` (the fingerprint as a signed 64-bit number), without a shuffle."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([as_signed(fingerprint(t, shingle)) for t in texts], dtype="int64")

    return docs.withColumn("_fp", udf("text"))


def tallied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal positional bytes of each fingerprint of ``a`` (rows) and ``b`` (columns)."""
    x, y = a.view(np.uint8).reshape(-1, 8), b.view(np.uint8).reshape(-1, 8)
    count = np.zeros((len(a), len(b)), np.uint8)
    for position in range(8):
        count += x[:, position, None] == y[None, :, position]
    return count


def forest(members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of a forest over ``members`` (64-bit, distinct) that connects all pairs within ``bits`` bits."""
    fps = np.sort(members).view(np.uint64)
    out_a, out_b = [], []
    left, front = np.arange(1, len(fps)), np.arange(min(1, len(fps)))  # not yet reached; trees grow breadth first
    while len(left):
        hit = np.full(len(left), -1)
        for at in range(0, len(front), 64):
            some = fps[front[at : at + 64]]
            kept = tallied(some, fps[left]) >= 8 - bits
            near = kept.any(axis=0) & (hit < 0)
            verified = kept[:, near] & (np.bitwise_count(some[:, None] ^ fps[left[near]][None, :]) <= bits)
            hit[np.flatnonzero(near)[verified.any(axis=0)]] = at + verified[:, verified.any(axis=0)].argmax(axis=0)
        new = hit >= 0
        out_a.append(fps[left[new]])
        out_b.append(fps[front[hit[new]]])
        front, left = left[new], left[~new]
        if not len(front):
            front, left = left[:1], left[1:]
    joined = lambda x: np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64)
    return joined(out_a), joined(out_b)


def _forests(bits: int):
    def run(batches):
        for b in batches:
            lists = b.column(0)
            values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy()).tolist()
            found = [forest(values[at:end], bits) for at, end in zip([0, *ends], ends, strict=False)]
            a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _mask(places) -> int:
    return as_signed(sum(0xFF << 8 * p for p in places))


def links(fps: DataFrame, bits: int = BITS, large: int = LARGE) -> DataFrame:
    """(a, b): links that connect what lies within ``bits`` bits, from ``fps(_fp)``; distinct fingerprints only."""
    if not 1 <= bits <= 2:
        raise ValueError("a posting is bounded for 1 or 2 bits")
    pairs = [[2 * p + k for p in c for k in (0, 1)] for c in combinations(range(4), 4 - bits)]
    posted = F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias("k"), F.col("_fp").bitwiseAND(F.lit(_mask(c))).alias("bytes")) for k, c in enumerate(pairs)]))
    posts = fps.select("_fp").distinct().select("_fp", posted.alias("p")).select("_fp", "p.k", "p.bytes")
    sizes = keep(posts.groupBy("k", "bytes").agg(F.count("*").alias("n")).where(F.col("n") > 1), "posting-sizes")
    several = posts.join(sizes, ["k", "bytes"])
    if bits == 2 and not sizes.where(F.col("n") > large).isEmpty():
        # the pairs' tally takes two more equal bytes of the four that are left
        finer = [F.array(*[F.struct(F.lit(k * 6 + j).cast("byte").alias("k"), F.col("_fp").bitwiseAND(F.lit(_mask([*c, *more]))).alias("bytes")) for j, more in enumerate(combinations([p for p in range(8) if p not in c], 2))]) for k, c in enumerate(pairs)]
        by_k = F.get(F.array(*finer), F.col("k").cast("int"))
        dealt = several.where(F.col("n") > large).select("_fp", F.explode(by_k).alias("p")).select("_fp", (F.col("p.k") + 16).cast("byte").alias("k"), "p.bytes")
        several = several.where(F.col("n") <= large).select("_fp", "k", "bytes").unionByName(dealt)
    members = several.groupBy("k", "bytes").agg(F.collect_list("_fp").alias("members")).where(F.size("members") > 1).select("members")
    return members.mapInArrow(_forests(bits), "a long, b long").distinct()


def classes(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(_fp, component_id) for each distinct fingerprint of ``rows(doc_id, _fp)``; component_id is the smallest doc_id."""
    least = rows.groupBy("_fp").agg(F.min("doc_id").alias("least"))
    tree = components(links(rows, bits)).withColumnsRenamed({"node": "_fp"})
    rooted = least.join(tree, "_fp", "left").select("_fp", "least", F.coalesce("root", "_fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("_fp", "component_id")


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, _fp, component_id) for each row of ``docs``: the smallest doc_id reachable over links.

    Null texts count as empty: fingerprint 0, linked like any other. Rows with equal fingerprints are one class and are
    never expanded into pairs. A null doc_id is never a component's id unless all its rows have none. An empty table gives
    an empty result; columns besides doc_id and text are left out.
    """
    with small_batches(docs.sparkSession):
        rows = keep(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "_fp"), "fingerprints")
    return rows.join(classes(rows, bits), "_fp").select("doc_id", "_fp", "component_id")


def one_of_each(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the smallest doc_id, null last; of repeated rows the first.

    Rows without words are one class. Other columns,
    whatever their names, come through unchanged.
    """
    used = ["doc_id", "text"]
    all_ = numbered(docs, used, "rows")
    with small_batches(docs.sparkSession):
        rows = keep(fingerprints(all_, shingle).select("doc_id", "_row", "_fp"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    least = rows.groupBy("_fp").agg(first.alias("least"))
    tree = components(links(rows, bits)).withColumnsRenamed({"node": "_fp"})
    chosen = least.join(tree, "_fp", "left").groupBy(F.coalesce("root", "_fp").alias("root")).agg(F.min("least").alias("least"))
    dropped = keep(rows.select("_row").join(chosen.select(F.col("least._row").alias("_row")), "_row", "left_anti"), "dropped")
    return unpacked(without(all_, dropped), docs.columns, used)


def as_hex(column: str = "_fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
