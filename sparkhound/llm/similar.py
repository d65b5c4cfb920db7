"""Near duplicates by exact similarity: all pairs whose sets of five-word runs have a Jaccard similarity of 0.8 or more.

SimHash links of five-word fingerprints (byte-position index, tally, verified) come first: they join what is almost equal at
little cost. They cannot be all: at a similarity of 0.8 two 64-bit fingerprints differ in about ten bits, so no positional byte
need be equal and the guaranteed minimum is none. What they leave is found by an index on the shingles themselves.
In any one order of all shingles, two sets of similarity t or more meet in the first n - ceil(t n) + 1 shingles of both, so
postings over these prefixes miss no pair. The order puts shingles common in a sample of documents last, by their
frequency, and all others by hash; the sample decides about the length of postings, never about the result.
Each posting has a pivot, the member with the smallest hash, so near copies share few pivots. Members are first compared with
their pivots, which joins most of a group in linear time. Members that are still in another component than a possible partner
in their posting then meet in the pivot's star: its sets are dealt into blocks, blocks of the star's largest component never
meet each other, and a task looks at two blocks.
Chance meetings are many and texts long, so pairs are first looked at by sketches, about one bit a shingle: each shingle flips one
bit, so two sketches differ in at most as many bits as their sets in shingles. Only pairs that this bound leaves open get their
texts. Where two blocks leave more than MANY pairs a set open, the texts of the blocks meet instead: their task counts shared
shingles and reports a forest of links, never pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .simhash import as_signed, from_hashes, hashes
from .simhash import links as simhash_links
from .store import forget, keep, likely, numbered, sliced, small_batches, unpacked, without

SHINGLE = 5
#: Similarity 0.8 as a fraction of whole numbers, so that the bound itself is met exactly.
NUM, DEN = 4, 5
SAMPLE = 10_000
#: Sets and shingles in a block of a star, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Bits of a sketch at most; longer sets are only told apart less well by it.
SKETCH = 1 << 17
#: Open pairs of a meeting of blocks for each set, beyond which texts meet in blocks and not in pairs.
MANY = 8
#: Members of a posting up to which possible partners are looked up; beyond it every member counts as having one.
LOOKED_UP = 4096


def shingles(text: str | None) -> np.ndarray:
    """The set of shingle hashes, ascending."""
    return np.unique(hashes(text, SHINGLE))


def prefix(found: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order (count in the sample, hash); ``common`` ascends."""
    n = len(found)
    if not n:
        return found
    size = n - -(-NUM * n // DEN) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.lexsort((found, np.where(common[at] == found, count[at], 0)))]
    return found[:size]


def sketch(found: np.ndarray) -> bytes:
    """Parities of the set's shingles by their low bits, as many bits as shingles, rounded up to a power of two."""
    bits = max(64, min(SKETCH, 1 << max(0, len(found) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded: at most the shingles that only one of the sets has."""
    x, y, p, q = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a), len(b)
    while p != q:
        if p < q:
            x, y, p, q = y, x, q, p
        p //= 2
        x = x >> 8 * p ^ x & (1 << 8 * p) - 1
    return (x ^ y).bit_count()


_DIGEST = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("bits", T.BinaryType())])


@F.pandas_udf(_DIGEST)
def _digest(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        h = hashes(t, SHINGLE)
        s = np.unique(h)
        out.append((as_signed(xxhash.xxh3_64_intdigest(s.tobytes())), len(s), as_signed(from_hashes(h)), sketch(s)))
    return pd.DataFrame({k: np.array([x[j] for x in out], kind) for j, (k, kind) in enumerate((("key", np.int64), ("n", np.int32), ("fp", np.int64), ("bits", object)))})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _set(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).view(np.int64) for t in texts], dtype=object)


def _common(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in over a thousandth of about SAMPLE of ``n`` texts with their counts: at most a thousand times a mean set's size."""
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0)
    seen = drawn.select(F.explode(_set("text")).alias("s")).groupBy("s").count()
    found = sorted((r["s"] % (1 << 64), r["count"]) for r in seen.where(F.col("count") > max(3, min(n, SAMPLE) // 1000)).collect())
    return np.array([s for s, _ in found], np.uint64), np.array([c for _, c in found], np.int64)


def _postings(texts: DataFrame, common: np.ndarray, count: np.ndarray) -> DataFrame:
    """(s, node, n, i): texts by prefix shingle (its low 48 bits) and its place, where at least two meet."""
    held = texts.sparkSession.sparkContext.broadcast((common, count))

    @F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))]))
    def first(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t) for t in texts]
        return pd.DataFrame({"n": [len(x) for x in sets], "s": [(prefix(x, *held.value) & np.uint64((1 << 48) - 1)).view(np.int64) for x in sets]})

    # one shuffle by the shingle; n and i travel as one number
    posts = texts.select(F.col("_row").alias("node"), first("text").alias("f")).select("node", "f.n", F.posexplode("f.s").alias("i", "s")).select("s", "node", (F.shiftleft("n", 32) + F.col("i")).alias("at"))
    met = posts.withColumn("times", F.count("*").over(Window.partitionBy("s"))).where("times > 1")
    return keep(met.select("s", "node", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("i")).distinct(), "met")


def _like(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of sizes n and m can be similar enough whose first common shingle has places i and j.

    All common shingles stand from there on, and a similarity of t takes t / (1 + t) of n + m. A pair meets in its first
    common shingle too, so the bound may be asked in every posting.
    """
    return (NUM + DEN) * F.least(n - i, m - j) >= NUM * (n + m)


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two texts are similar, on whole sets; texts take less room on their way than sets."""
    out, seen, x = [], None, None
    for t, u in zip(a, b, strict=True):
        if x is None or t != seen:  # rows come by the pivot
            seen, x = t, shingles(t)
        y = shingles(u)
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(DEN * both >= NUM * (len(x) + len(y) - both))
    return pd.Series(out, dtype=bool)


@F.pandas_udf(T.BooleanType())
def _open(a: pd.Series, b: pd.Series, both: pd.Series) -> pd.Series:
    """Whether the sketches leave it open that two sets with ``both`` shingles together are similar."""
    return pd.Series([(NUM + DEN) * apart(x, y) <= (2 * DEN - NUM - DEN) * n for x, y, n in zip(a, b, both, strict=True)], dtype=bool)


def _left_open(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` that the sketches of ``nodes(node, n, bits)`` do not rule out."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    sized = F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM
    return pairs.join(side("b"), "b").join(side("a"), "a").where(sized).where(_open("bits_a", "bits_b", F.col("n_a") + F.col("n_b"))).select("a", "b")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The similar ones of ``pairs(a, b)``, from whole texts."""
    pairs = keep(pairs, "pairs")
    asked = keep(pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct(), "asked")
    some = likely(texts, asked).select("_row", "text")
    tested = pairs.join(some.withColumnsRenamed({"_row": "b", "text": "y"}), "b").join(some.withColumnsRenamed({"_row": "a", "text": "x"}), "a")
    found = keep(tested.where(_alike("x", "y")).select("a", "b"), "similar")
    forget(pairs, asked)
    return found


def _almost_equal(nodes: DataFrame) -> DataFrame:
    """(a, b): SimHash links between ``nodes(node, n, fp)`` whose sizes allow the similarity."""
    least = keep(nodes.groupBy("fp").agg(F.min_by(F.struct("node", "n"), "node").alias("p")), "fingerprints")
    equal = nodes.join(least, "fp").where("node <> p.node").select(F.struct("node", "n").alias("x"), F.col("p").alias("y"))
    linked = simhash_links(least.select(F.col("fp").alias("_fp")))
    near = linked.join(least.select(F.col("fp").alias("a"), F.col("p").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("p").alias("y")), "b").select("x", "y")
    sized = F.least("x.n", "y.n") * DEN >= F.greatest("x.n", "y.n") * NUM
    return equal.unionByName(near).where(sized).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _may(n: np.ndarray, i: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Members of a posting with a possible partner (see _like) in another component."""
    out = np.zeros(len(n), bool)
    for at in range(0, len(n), 256):
        part = slice(at, at + 256)
        like = (NUM + DEN) * np.minimum((n - i)[part, None], (n - i)[None]) >= NUM * (n[part, None] + n[None])
        out[part] = (like & (c[part, None] != c[None])).any(1)
    return out


def _partners(batches):
    """(p, node, c, n) of members that may be similar to another one of their posting; rows come by posting."""
    held, size, key = [], 0, None

    def chosen(rows, every):
        node, n, i, c, p = (np.concatenate([r[k] for r in rows]) for k in range(1, 6))
        at = np.ones(len(node), bool) if every else _may(n, i, c)
        return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (p, node, c, n)], ["p", "node", "c", "n"])

    for b in batches:
        columns = [b.column(k).to_numpy().astype(np.int64) for k in range(6)]
        ends = [*np.flatnonzero(np.diff(columns[0])) + 1, b.num_rows]
        for at, end in zip([0, *ends], ends, strict=False):
            if at == end:
                continue
            part = [x[at:end] for x in columns]
            if part[0][0] != key:
                if size:
                    yield chosen(held, size > LOOKED_UP)
                held, size, key = [], 0, part[0][0]
            elif size > LOOKED_UP:  # what a long posting has gathered so far goes on
                yield chosen(held, True)
                held = []
            held.append(part)
            size += end - at
    if held:
        yield chosen(held, size > LOOKED_UP)


def close(sketches: list[bytes], n: np.ndarray, comps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs across components that sizes and sketches leave open."""
    length = np.array([len(x) // 8 for x in sketches])
    out_a, out_b = [], []
    for w in np.unique(length).tolist():
        own, longer = np.flatnonzero(length == w), np.flatnonzero(length == 2 * w)
        load = lambda at, width: np.frombuffer(b"".join([sketches[k] for k in at.tolist()]), np.uint64).reshape(-1, width)
        x, fold = load(own, w), load(longer, 2 * w)
        y, other = np.concatenate([x, fold[:, :w] ^ fold[:, w:]]), np.concatenate([own, longer])
        step = max(1, (1 << 20) // (w * len(other)))
        for at in range(0, len(own), step):
            rows = own[at : at + step, None]
            bits = np.bitwise_count(x[at : at + step, None, :] ^ y[None]).sum(2, dtype=np.int64)
            both, low, high = n[rows] + n[other], np.minimum(n[rows], n[other]), np.maximum(n[rows], n[other])
            good = ((NUM + DEN) * bits <= (2 * DEN - NUM - DEN) * both) & (DEN * low >= NUM * high) & (comps[rows] != comps[other])
            good[:, : len(own)] &= own > rows  # each pair once
            a, b = np.nonzero(good)
            out_a.append(rows[a, 0])
            out_b.append(other[b])
    return np.concatenate([np.zeros(0, np.int64), *out_a]), np.concatenate([np.zeros(0, np.int64), *out_b])


def _closer(many: int):
    """(a, b) left open by sketches inside each meeting of blocks; (p, i, j) of meetings with too many. Rows come by meeting."""

    def run(batches):
        out, key, held = [], None, []

        def look():
            if len(held) > 1 and len({r[1] for r in held}) > 1:
                a, b = close([r[3] for r in held], np.array([r[2] for r in held], np.int64), np.array([r[1] for r in held], np.int64))
                if len(a) > many * len(held):
                    out.append((None, None, *key))
                else:
                    out.extend((min(held[j][0], held[k][0]), max(held[j][0], held[k][0]), None, None, None) for j, k in zip(a.tolist(), b.tolist(), strict=True))

        def gone():
            rows = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], ["a", "b", "p", "i", "j"])
            out.clear()
            return rows

        for batch in sliced(batches, 4096):
            p, i, j, node, comp, n, bits = (batch.column(k).to_pylist() for k in range(7))
            for k, at in enumerate(zip(p, i, j, strict=True)):
                if at != key:
                    look()
                    key, held = at, []
                held.append((node[k], comp[k], n[k], bits[k]))
            if out:
                yield gone()
        look()
        if out:
            yield gone()

    return run


def linked(sets: list[np.ndarray], comps: list[int]) -> list[tuple[int, int]]:
    """Links (places in the list) of a forest that connects all similar sets across components."""
    root = {c: c for c in comps}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    sizes = np.array([len(x) for x in sets])
    all_ = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(all_, kind="stable")
    all_, owner = all_[order], owner[order]
    words, first = np.unique(all_, return_index=True)
    ends = np.append(first[1:], len(all_))
    out = []
    for k, x in enumerate(sets):
        at = np.searchsorted(words, x)
        length = ends[at] - first[at]
        take = np.repeat(first[at] - np.cumsum(length) + length, length) + np.arange(length.sum())
        both = np.bincount(owner[take], minlength=len(sets))[:k]
        for j in np.flatnonzero(DEN * both >= NUM * (sizes[:k] + len(x) - both)).tolist():
            a, b = top(comps[k]), top(comps[j])
            if a != b:
                root[a] = b
                out.append((j, k))
    return out


def _linked(batches):
    """(a, b): links inside each meeting of blocks; rows come by meeting, which holds two blocks at most."""

    def found(rows):
        links_ = linked([r[3] for r in rows], [r[2] for r in rows]) if len({r[2] for r in rows}) > 1 else []
        nodes = [(rows[j][1], rows[k][1]) for j, k in links_]
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in nodes], pa.int64()), pa.array([max(x) for x in nodes], pa.int64())], ["a", "b"])

    held, key = [], None
    for b in sliced(batches, 256):
        keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        node, comp, texts = (b.column(k).to_pylist() for k in (3, 4, 5))
        for k, at in enumerate(keys):
            if at != key:
                if len(held) > 1:
                    yield found(held)
                held, key = [], at
            held.append((at, node[k], comp[k], shingles(texts[k])))
    if len(held) > 1:
        yield found(held)


def _stars(texts: DataFrame, nodes: DataFrame, now: DataFrame, open_: DataFrame) -> DataFrame:
    """(a, b): links across components ``c`` of ``now(s, i, node, n, c)``, found in the stars of the open postings' pivots."""
    rows = now.join(open_, "s").select("s", "node", "n", "i", "c", F.col("p.node").alias("p"))
    rows = rows.repartition("s").sortWithinPartitions("s")
    member = keep(rows.mapInArrow(_partners, "p long, node long, c long, n long").distinct(), "stars")
    sizes = member.groupBy("p", "c").agg(F.count("*").alias("k"), F.sum("n").alias("m"))
    star = sizes.groupBy("p").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("k_main"), F.max_by("m", F.struct("k", "c")).alias("m_main"), F.sum("k").alias("k"), F.sum("m").alias("m"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda k, m: F.greatest(F.ceil(k / F.lit(BLOCK)), F.ceil(m / F.lit(BLOCK_SHINGLES)))
    star = star.select("p", "main", blocks(F.col("k"), F.col("m")).alias("whole"), blocks(F.col("k") - F.col("k_main"), F.col("m") - F.col("m_main")).alias("rest"), blocks(F.col("k_main"), F.col("m_main")).alias("mains"))
    dealt = member.join(star, "p").withColumn("h", F.xxhash64("node"))
    # a star of one block meets itself; in others each block of the rest meets the rest's later ones and all of the main component
    own = F.pmod("h", "rest")
    upto = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    zero, last = F.lit(0).cast("long"), F.col("rest") - 1
    met = F.when(F.col("whole") == 1, F.array(F.struct(zero.alias("i"), zero.alias("j")))).when(
        F.col("c") == F.col("main"), F.transform(upto(zero, last), lambda i: F.struct(i.alias("i"), (-1 - F.pmod("h", "mains")).alias("j")))
    ).otherwise(
        F.concat(
            F.transform(upto(zero, own), lambda i: F.struct(i.alias("i"), own.alias("j"))),
            F.transform(upto(own + 1, last), lambda j: F.struct(own.alias("i"), j.alias("j"))),
            F.transform(F.sequence(F.lit(1).cast("long"), F.col("mains")), lambda j: F.struct(own.alias("i"), (-j).alias("j"))),
        )
    )
    places = dealt.join(nodes.select("node", "bits"), "node").select("p", "node", "c", "n", "bits", F.explode(met).alias("at")).select("p", "at.i", "at.j", "node", "c", "n", "bits")
    laid = places.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")
    looked = keep(laid.mapInArrow(_closer(MANY), "a long, b long, p long, i long, j long"), "looked")
    found = _verified(texts, looked.where("a IS NOT NULL").select("a", "b").distinct())
    dense = looked.where("a IS NULL").select("p", "i", "j").distinct()
    if not dense.isEmpty():
        whole = keep(places.drop("n", "bits").join(dense, ["p", "i", "j"]), "dense")
        asked = keep(whole.select(F.col("node").alias("_row")).distinct(), "asked")
        some = likely(texts, asked).select(F.col("_row").alias("node"), "text")
        rows = whole.join(some, "node").select("p", "i", "j", "node", "c", "text").repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")
        found = found.unionByName(keep(rows.mapInArrow(_linked, "a long, b long").distinct(), "similar"))
        forget(whole, asked)
    forget(member, looked)
    return found


def links(texts: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(a, b): links that connect all similar sets of ``texts(_row, text)``; None if no two meet."""
    met = _postings(texts, *_common(texts, nodes.count()))
    found = None
    for turn in ("fingerprints", "pivots", "stars"):
        if turn == "fingerprints":
            new = _verified(texts, _almost_equal(nodes))
        else:
            now = met.withColumn("c", F.col("node")) if found is None else met.join(components(found), "node", "left").select("s", "i", "node", "n", F.coalesce("root", "node").alias("c"))
            now = keep(now, "met-by-component")
            pivot = F.min_by(F.struct("node", "n", "i", "c"), F.xxhash64("node")).alias("p")
            open_ = now.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), pivot).where("lo < hi").select("s", "p")
            if turn == "pivots":
                pairs = now.join(open_, "s").where("c <> p.c").where(_like(F.col("n"), F.col("i"), F.col("p.n"), F.col("p.i")))
                new = _verified(texts, _left_open(nodes, pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()))
            else:
                new = _stars(texts, nodes, now, open_)
            forget(now)
        if not new.isEmpty():
            found = new if found is None else found.unionByName(new)
    forget(met)
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: the smallest doc_id, null last; of repeated rows the first.

    Texts of fewer than five words are one shingle; rows without words are one class. Texts with equal sets are one class
    by a 64-bit digest of the set and never expanded into pairs. Other columns, whatever their names, come through unchanged.
    """
    used = ["doc_id", "text"]
    all_ = numbered(docs, used, "rows")
    with small_batches(docs.sparkSession):
        dropped = _dropped(all_)
    return unpacked(without(all_, dropped), docs.columns, used)


def _dropped(all_: DataFrame) -> DataFrame:
    """(_row): the rows of ``all_(_row, doc_id, text)`` that are not the first of their class."""
    rows = all_.select("doc_id", "_row", _digest("text").alias("_d"))
    rows = keep(rows.select("doc_id", "_row", F.col("_d.key").alias("_key"), F.col("_d.n").alias("_n"), F.col("_d.fp").alias("_fp"), F.col("_d.bits").alias("_bits")), "digests")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    least = keep(rows.groupBy("_key").agg(first.alias("least"), F.first("_n").alias("n"), F.first("_fp").alias("fp"), F.first("_bits").alias("bits")), "least")
    copies = keep(rows.select("_row", "_key").join(least.select("_key", "least"), "_key").where("_row <> least._row").select("_row"), "copies")
    nodes = least.select(F.col("least._row").alias("node"), "n", "fp", "bits")
    found = links(without(all_.select("_row", "text"), copies), nodes)
    if found is None:
        return copies
    linked = components(found).join(least.select(F.col("least._row").alias("node"), "least"), "node")
    best = linked.groupBy("root").agg(F.min("least").alias("best"))
    return keep(linked.join(best, "root").where("node <> best._row").select(F.col("node").alias("_row")).unionByName(copies), "dropped")
