"""Sharding by minimax contiguous partition: near-equal bytes, equal texts together.

Documents are ordered by a digest of their text, so equal texts are neighbours and form atomic groups. The smallest
capacity for which greedy filling needs at most ``shards`` shards is found by search over capacities: each round tries
``WIDTH`` capacities at once, and a greedy step of all of them is one aggregation over the sorted table of group ends, of
which Parquet statistics leave only the row groups near the wanted places. The cuts are then laid under that capacity, each
as near to an equal share as the capacity allows. Once few ends lie where cuts can still
fall (at most ``HELD``), the driver holds those and looks there first; ends elsewhere are always looked up by Spark, so the
result never depends on it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, keep, positions, shuffle_parts

SHARDS = 24
OVERHEAD = 8
#: Capacities tried in one round.
WIDTH = 64
#: Ends that the driver holds at most.
HELD = 200_000


class GroupEnds:
    """Running ends of the ordered atomic groups, looked up in batches."""

    def __init__(self, ends: DataFrame, total: int, largest: int):
        self.ends, self.total, self.largest = ends, total, largest
        self.held: list[tuple[int, int, np.ndarray]] = []

    def hold(self, low: int, high: int, shards: int) -> None:
        """Hold the ends where cuts of capacities from low to high can fall, if they are few."""
        if self.held or not self.total:
            return
        least, most = self.filled([low, high], shards)
        spans = []
        for k in range(1, shards):
            of = [c[min(k, len(c) - 1)] for c in (least, most)]
            a, b = min(of[0], self.total - high * (shards - k)) - self.largest, max(of[1], self.total * k // shards) + self.largest
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        here = F.lit(False)
        for a, b in spans:
            here |= F.col("end").between(a, b)
        found = self.ends.where(here).select("end")
        if found.count() <= HELD:
            ends = np.array(sorted(r[0] for r in found.collect()), np.int64)
            self.held = [(a, b, ends[(ends >= a) & (ends <= b)]) for a, b in spans]

    def _held(self, value: int, above: bool) -> int | None:
        for a, b, ends in self.held:
            if a <= value <= b:
                k = int(np.searchsorted(ends, value, "left" if above else "right")) - (not above)
                return int(ends[k]) if 0 <= k < len(ends) else None
        return None

    def at_or_below(self, values: list[int]) -> list[int]:
        """For each value the largest end at or below it (0: none)."""
        out = [self.total if v >= self.total else self._held(v, False) for v in values]
        ask = [v for v, x in zip(values, out, strict=True) if x is None]
        if ask:
            near = self.ends.where(F.col("end").between(min(ask) - self.largest, max(ask)))
            row = iter(near.agg(*[F.max(F.when(F.col("end") <= v, F.col("end"))).alias(f"v{k}") for k, v in enumerate(ask)]).first())
            out = [next(row) or 0 if x is None else x for x in out]
        return out

    def at_or_above(self, value: int) -> int:
        """The smallest end at or above a value (0 for values up to 0)."""
        if value <= 0:
            return 0
        found = self._held(value, True)
        if found is None:
            found = self.ends.where(F.col("end").between(value, value + self.largest)).agg(F.min("end")).first()[0]
        return self.total if found is None else found

    def filled(self, capacities: list[int], shards: int) -> list[list[int]]:
        """Greedy cuts for each capacity, at most ``shards`` of them."""
        cuts: list[list[int]] = [[0] for _ in capacities]
        for _ in range(shards):
            open_ = [k for k, c in enumerate(cuts) if c[-1] < self.total]
            if not open_:
                break
            for k, e in zip(open_, self.at_or_below([cuts[k][-1] + capacities[k] for k in open_]), strict=True):
                cuts[k].append(e)
        return cuts

    def capacity(self, shards: int) -> int:
        """The smallest capacity that ``shards`` contiguous shards can keep to."""
        low = max(self.largest, -(-self.total // shards))  # nothing smaller can do
        high = -(-self.total // shards) + self.largest  # always does
        while low < high:
            step = max(1, (high - low) // WIDTH)
            tried = list(range(low, high, step))[:WIDTH]
            good = [k for k, c in enumerate(self.filled(tried, shards)) if c[-1] == self.total]
            if good:
                high = tried[good[0]]
                low = tried[good[0] - 1] + 1 if good[0] else low
            else:
                low = tried[-1] + 1
            self.hold(low, high, shards)
        return high

    def cuts(self, shards: int) -> tuple[int, list[int]]:
        """(capacity, ends of the shards but the last)."""
        if not self.total:
            return 0, []
        cap = self.capacity(shards)
        self.hold(cap, cap, shards)
        least = [self.total]  # from the back: the first end from which the remaining shards suffice
        for _ in range(shards - 1):
            least.append(self.at_or_above(least[-1] - cap))
        out = [0]
        for k, floor in enumerate(reversed(least)):
            if k + 1 == shards:
                break
            most = out[-1] + cap
            want = min(max(self.total * (k + 1) // shards, floor), most)
            below, above = self.at_or_below([want])[0], self.at_or_above(want)
            fits = [e for e in (below, above) if max(out[-1], floor) <= e <= most]
            out.append(min(fits, key=lambda e: abs(e - want)))
        return cap, out[1:]


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    Size: UTF-8 bytes of the text (null: none) and ``overhead``. Law "bytes": the largest shard is as small as contiguous
    groups of equal texts allow. Slots count from 0 inside a shard, in text-digest and doc_id order (null first). Null texts
    form one group of their own. A group above an equal share gets a shard as large as itself. With fewer groups than shards
    some shards stay empty. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("_key"),
    )
    laid = positions(rows, ["_key", "doc_id"], "size", "shard-rows")
    groups = laid.groupBy("_key").agg(F.max("upto").alias("end"), F.sum("size").alias("bytes"))
    ends = keep(groups.select("end", "bytes").repartitionByRange(shuffle_parts(spark), "end").sortWithinPartitions("end"), "group-ends")
    total, largest = (x or 0 for x in ends.agg(F.max("end"), F.max("bytes")).first())
    _, cuts = GroupEnds(ends, total, largest).cuts(shards)
    forget(ends)
    number = sum((F.when(F.col("upto") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    numbered = laid.withColumn("shard", number.cast("int"))
    first = F.broadcast(numbered.groupBy("shard").agg(F.min("row").alias("_first")))  # a row for each shard
    return numbered.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
