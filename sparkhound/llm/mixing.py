"""Mixing sources to target weights.

Each source is one stream of words, its documents in doc_id order; the stream is packed into blocks of a fixed length (the
last one may be short). Blocks have 64 words; where a source's words or its target are fewer than 64 such blocks, a block
has a 64th of them, at least one word, so that the taken words can come near the target. The mix is a sequence of slots. Its output shards draw their source counts one after the other from
a multinomial over the slots that each source still has to give, so that the draws add up to the targets. The i-th slot of a
source takes block perm(i mod blocks) of pass i div blocks, where perm is a pseudorandom permutation of the block numbers
(a Feistel network that walks until it is inside), and slots are joined to blocks by source and block number. Where a document
goes, and how often its words are taken, is read off that join: its places are pairs of output shard and slot.

The driver holds one row for each source and the drawn counts (output shards x sources), nothing that grows with documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import numbered, positions, shuffle_parts, unpacked

BLOCK = 64
OUTPUT_SHARDS = 64
MOST = 3
SEED = 20240611
WORD = r"[^\x20\x09-\x0D]+"
#: A word and the white space before it.
SPACED = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def targets(sizes: list[int], most: float = MOST, weights: list[float] | None = None) -> list[float]:
    """Shares of the sum of sizes by weight 1, 2, 3, 1, ...; none above ``most`` times its size, the excess shared anew."""
    weights = weights or [1 + k % 3 for k in range(len(sizes))]
    left, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(most * sizes[k])
            left -= out[k]
        full = set(over)
        open_ = [k for k in open_ if k not in full]
    return out


def block_length(size: int, target: float, block: int | None) -> int:
    """Words in a block of a source with ``size`` words that should give ``target``; a given length holds for all sources."""
    return block or min(BLOCK, max(1, int(min(size, target)) // BLOCK))


def drawn(slots: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Counts (shards x sources): multinomial draws over what is left of each source; the columns add up to ``slots``."""
    rng, left = np.random.default_rng(seed), np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for s in range(shards):
        want = int(left.sum()) // (shards - s)
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[s] += got
            left -= got
            want -= int(got.sum())
    return out


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..n-1 for each key: four Feistel rounds over the next even power of two, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = i.astype(np.uint64), np.ones(len(i), bool)
    while todo.any():
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            z = right * np.uint64(0x9E3779B97F4A7C15) + key[todo].astype(np.uint64) + np.uint64((r + 1) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)
            z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (z ^ z >> np.uint64(31)) & mask[todo]
        x[todo] = left << half[todo] | right
        todo = x >= n.astype(np.uint64)
    return x.astype(np.int64)


class Mix:
    """A mix of ``docs(doc_id, text, source)``, other columns aside.

    Null texts and texts without words have size 0 and give no words. Null sources are one source, last in order. Repeated
    rows are documents of their own. Sizes, targets and draws depend on the rows alone, so reruns agree. ``block`` sets one
    length for the blocks of all sources; without it the length follows the source (``block_length``).
    """

    def __init__(self, docs: DataFrame, block: int | None = None, shards: int = OUTPUT_SHARDS, most: int = MOST, seed: int = SEED, carry: tuple[str, ...] = ()):
        self.spark, self.seed, self.most = docs.sparkSession, seed, most
        rows = docs.select(*carry, "doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_tie"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        laid = positions(rows, [F.col("source").asc_nulls_last(), "doc_id", "_tie"], "size", "mix-rows")
        found = [(r["source"], r["n"]) for r in laid.groupBy("source").agg(F.sum("size").alias("n")).collect()]
        self.sources = sorted(found, key=lambda x: (x[0] is None, x[0] or ""))
        self.sizes = [n for _, n in self.sources]
        self.targets = targets(self.sizes, most)
        self.lengths = [block_length(n, t, block) for n, t in zip(self.sizes, self.targets, strict=True)]
        self.blocks = [-(-n // k) for n, k in zip(self.sizes, self.lengths, strict=True)]
        #: slots of a source: the whole number whose words come nearest its target, at most ``most`` passes
        self.slots = [min(most * b, max(0, round(t / n * b))) if n else 0 for t, n, b in zip(self.targets, self.sizes, self.blocks, strict=True)]
        self.counts = drawn(self.slots, shards, seed)
        starts = np.concatenate(([0], np.cumsum(self.sizes))).tolist()
        known = [(s, k, n, t, starts[k], self.lengths[k]) for k, ((s, n), t) in enumerate(zip(self.sources, self.targets, strict=True))]
        of = F.broadcast(self.spark.createDataFrame(known, f"source {dict(docs.dtypes)['source']}, _s int, source_size long, target double, _start long, _length long"))
        #: documents with their place in their source's stream: [begin, end)
        self.docs = (
            laid.alias("d")
            .join(of.alias("o"), F.expr("d.source <=> o.source"))
            .select(*[f"d.{c}" for c in carry], "d.doc_id", "d.source", "d.size", "d.row", "_tie", "_s", "_length", "source_size", "target", (F.col("upto") - F.col("_start")).alias("end"))
            .withColumn("begin", F.col("end") - F.col("size"))
        )

    def slot_table(self) -> DataFrame:
        """(shard, slot, _s, pass, block): what each place of the mix takes."""
        per_shard = self.counts.sum(axis=1)
        bounds = np.concatenate(([0], np.cumsum(self.counts.reshape(-1))))  # cells in shard order, then source order
        before = (np.cumsum(self.counts, axis=0) - self.counts).reshape(-1)
        firsts = np.concatenate(([0], np.cumsum(per_shard)[:-1]))
        n_sources, seed = max(1, len(self.sources)), self.seed
        blocks = np.array(self.blocks, np.int64)

        def run(batches):
            for b in batches:
                k = b.column(0).to_numpy()
                cell = np.searchsorted(bounds, k, side="right") - 1
                shard, s = cell // n_sources, cell % n_sources
                i = before[cell] + k - bounds[cell]
                passes = i // blocks[s]
                block = permuted(i % blocks[s], blocks[s], (s * 1_000_003 + passes) * 7919 + seed)
                # places inside an output shard are shuffled the same way, or its sources would stand in runs
                slot = permuted(k - firsts[shard], per_shard[shard], shard * 104_729 + seed)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, slot, s.astype(np.int32), passes, block)], ["shard", "slot", "_s", "pass", "block"])

        return self.spark.range(int(self.counts.sum())).mapInArrow(run, "shard long, slot long, _s int, pass long, block long")

    def segments(self) -> DataFrame:
        """(row, _s, block, words, from): the words of a document that lie in a block, counted from the document's start."""
        n = F.col("_length")
        cut = self.docs.where("size > 0").select("row", "_s", "_length", "begin", "end", F.explode(F.sequence(F.floor(F.col("begin") / n), F.floor((F.col("end") - 1) / n))).alias("block"))
        low, high = F.greatest("begin", F.col("block") * n), F.least("end", (F.col("block") + 1) * n)
        return cut.select("row", "_s", "block", (high - low).alias("words"), (low - F.col("begin")).alias("from"))

    def placed(self) -> DataFrame:
        """(shard, slot, row, from, words): the mix itself, slots joined to blocks by index."""
        return self.slot_table().join(self.segments(), ["_s", "block"]).select("shard", "slot", "row", "from", "words")

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken, n_places, first_shard, first_slot, places_xxh64) for each row.

        A place is a slot that takes words of the document; ``places_xxh64`` is the exclusive or of the hashes of all its
        places (shard, slot, first word, words). A row that the mix leaves out has no first place and a hash of 0.
        """
        found = self.placed().groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("n_places"), F.min(F.struct("shard", "slot")).alias("first"), F.expr("bit_xor(xxhash64(shard, slot, `from`, words))").alias("places_xxh64"))
        zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("taken", "n_places")]
        return self.docs.join(found, "row", "left").select(
            "doc_id", "size", "source_size", "target", *zero, F.col("first.shard").alias("first_shard"), F.col("first.slot").alias("first_slot"), F.coalesce("places_xxh64", F.lit(0).cast("long")).alias("places_xxh64")
        )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, block after block in the order of output shards and slots: a row for each document's part of a block.

    A part keeps the white space between its words; a part that is all of a document's words is the text as it is. A long text
    is cut into its parts inside its own row; only the parts go on, so work grows with the text and not with its square. Columns as
    in ``docs``; ``n_chars`` follows the text where there is such a column. Documents without words give no rows.
    """
    used = [c for c in ("doc_id", "text", "source", "n_chars") if c in docs.columns]
    base = numbered(docs, used, "mix-docs").withColumnRenamed("_row", "_id")
    mix = Mix(base.select("_id", "doc_id", "text", "source"), carry=("_id",), **options)
    # a document has at most ``most`` places for each of its blocks
    cuts = mix.placed().join(mix.docs.select("row", "_id", "size"), "row").groupBy("_id", "row", "size").agg(F.collect_list(F.struct("shard", "slot", "from", "words")).alias("cuts"))
    words = F.regexp_extract_all("text", F.lit(SPACED), F.lit(0))
    cut = lambda c: F.regexp_replace(F.array_join(F.slice(F.col("_words"), c["from"].cast("int") + 1, c["words"].cast("int")), ""), r"^[\x20\x09-\x0D]+", "")
    part = lambda c: F.struct(c["shard"].alias("shard"), c["slot"].alias("slot"), F.when(c["words"] < F.col("size"), cut(c)).otherwise(F.col("text")).alias("text"))
    # _words is named twice, or the optimiser would split the text anew for each cut
    parts = F.when(F.size("_words") >= 0, F.transform("cuts", part))
    out = base.join(cuts, "_id").withColumn("_words", F.when(F.exists("cuts", lambda c: c["words"] < F.col("size")), words).otherwise(F.array().cast("array<string>")))
    out = out.select(*[c for c in base.columns if c != "text"], "row", F.explode(parts).alias("_part"))
    out = out.withColumns({"text": F.col("_part.text"), "_shard": F.col("_part.shard"), "_slot": F.col("_part.slot")}).drop("_part")
    if "n_chars" in used:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    laid = out.repartitionByRange(shuffle_parts(docs.sparkSession), "_shard", "_slot").sortWithinPartitions("_shard", "_slot", "row")
    return unpacked(laid, docs.columns, used)
