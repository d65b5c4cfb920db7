"""Exact Jaccard join of word n-grams by prefix filtering, rare n-grams first.

In any one order of all n-grams, two sets of similarity t or more meet in the first n - ceil(t n) + 1 of both, their prefixes.
The order is by document frequency, rarest first, so that few sets meet by chance; the frequency of an n-gram is that of its
cell among CELLS, counted over all rows, in powers of two. Frequencies decide how long postings are, never the result.

Sets are joined on the n-grams of their prefixes. A pair must pass four filters: length (sizes allow the similarity), position
(enough is left behind the first common n-gram), suffix (a lower bound of the Hamming distance from the numbers of n-grams in
parts of the hash space, the same parts for all sets, as many as suit a set's size), and only then are the sets compared, once:
1. Each posting has a pivot, the member in which its n-gram stands first, which is the one with the least of its own. Members
   meet their pivots, which joins most of a group in linear time.
2. Members that are still in another component than a possible partner in their posting meet in their pivots' stars. A star's
   members are dealt into blocks, blocks of its largest component never meet each other, and two blocks are joined in one task. A pair belongs to
   the star of its first common n-gram's pivot, so no other star compares it. Tasks report a forest of links, never pairs.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .store import forget, keep, likely, numbered, sliced, small_batches, without

SHINGLE = 3
#: Similarity 0.9 as a fraction of whole numbers, so that the bound itself is met exactly.
NUM, DEN = 9, 10
#: Cells in which frequencies are counted, a fixed size whatever the input.
CELL_BITS = 18
#: Members and n-grams in a block of a star, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Members of a posting up to which possible partners are looked up; beyond it every member counts as having one.
LOOKED_UP = 4096
#: Parts of the hash space in which sets are compared inside a task, at most.
PARTS = 4096
#: Members of a posting up to which postings are gone through together, and rows that are.
SMALL, TOGETHER = 128, 16384
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of ``size`` words (of all words, if there are fewer), ascending. No words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # of bytes: at ASCII white space only
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    if not k:
        return h
    runs = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        runs = _mixed(runs * _ODD + h[j : j + len(runs)])
    return np.unique(runs)


def ordered(found: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set's n-grams in the order of all n-grams: frequency class in the upper six bits, then the hash."""
    cell = (found >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    return np.unique((classes[cell].astype(np.uint64) << np.uint64(58)) | (found >> np.uint64(6)))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def parts_of(found: np.ndarray) -> np.ndarray:
    """How many n-grams lie in each of 2^k equal parts of the hash space, about eight each; counts stop at 255, which only lowers bounds."""
    k = min((len(found) // 8).bit_length(), 16)
    if not k:
        return np.array([min(len(found), 255)], np.uint8)
    return np.minimum(np.bincount((found >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8)


def folded(parts: np.ndarray, size: int) -> np.ndarray:
    return parts.astype(np.int64).reshape(min(size, len(parts)), -1).sum(1)


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """At least so many n-grams are in one of the two sets only."""
    size = min(len(a), len(b))
    return int(np.abs(folded(a, size) - folded(b, size)).sum())


class Apart:
    """apart() of one set and several, each pair at the parts that both have, PARTS at most."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts, self.size, self.folds = parts, np.minimum([len(p) for p in parts], PARTS), {}

    def least(self, k: int, at: np.ndarray) -> np.ndarray:
        out, sizes = np.zeros(len(at), np.int64), np.minimum(self.size[at], self.size[k])
        for size in np.unique(sizes).tolist():
            if size not in self.folds:
                own = np.flatnonzero(self.size >= size)
                place = np.full(len(self.parts), -1)
                place[own] = np.arange(len(own))
                self.folds[size] = place, np.array([folded(self.parts[j], size) for j in own]).astype(np.int32)
            place, counts = self.folds[size]
            some = sizes == size
            out[some] = np.abs(counts[place[at[some]]] - counts[place[k]]).sum(1)
        return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _most_apart(n, m):
    """Similar sets of these sizes differ in at most so many n-grams: n + m less twice the common ones they need."""
    return (n + m) - 2 * -(-NUM * (n + m) // (NUM + DEN))


_DESCRIBED = "key binary, n int, parts binary, cell int, times bigint"


def _described(size: int):
    def run(batches):
        cells = np.zeros(1 << CELL_BITS, np.int64)
        schema = None
        for b in sliced(batches):
            schema = b.schema
            sets = [shingles(t, size) for t in b.column(2).to_pylist()]
            for s in sets:
                cells += np.bincount((s >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells)) if len(s) > 4096 else 0
                if len(s) <= 4096:
                    np.add.at(cells, (s >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
            none = pa.nulls(b.num_rows, pa.int32())
            columns = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([parts_of(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns, none, none.cast(pa.int64())], ["doc_id", "_row", "key", "n", "parts", "cell", "times"])
        if schema is not None:  # the task's counts follow its rows
            at = np.flatnonzero(cells)
            nulls = [pa.nulls(len(at), t) for t in (schema.field(0).type, schema.field(1).type, pa.binary(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(at.astype(np.int32)), pa.array(cells[at])], ["doc_id", "_row", "key", "n", "parts", "cell", "times"])

    return run


def _classes(described: DataFrame) -> np.ndarray:
    """Bit length of each cell's count: 2^CELL_BITS bytes, whatever the input."""
    found = described.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("times").alias("times")).toPandas()
    out = np.zeros(1 << CELL_BITS, np.uint8)
    out[found["cell"].to_numpy(np.int64)] = np.frexp(found["times"].to_numpy(np.float64))[1]
    return out


def _posted(held, size: int):
    def run(batches):
        for b in sliced(batches):
            found = [ordered(shingles(t, size), held.value) for t in b.column(1).to_pylist()]
            lengths = np.array([prefix_length(len(f)) if len(f) else 0 for f in found])
            at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            s = np.concatenate([np.zeros(0, np.uint64), *(f[:p] for f, p in zip(found, lengths, strict=True))])
            node = np.repeat(b.column(0).to_numpy(), lengths)
            n = np.repeat(np.array([len(f) for f in found]), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(node), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], ["s", "node", "n", "i"])

    return run


def _like(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Length and position: whether sets of sizes n and m whose first common n-gram stands at i and j can be similar enough."""
    length = (F.greatest(n, m) * NUM <= F.least(n, m) * DEN)
    return length & ((NUM + DEN) * F.least(n - i, m - j) >= NUM * (n + m))


@F.pandas_udf(T.BooleanType())
def _close(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    most = _most_apart(n.to_numpy(np.int64), m.to_numpy(np.int64))
    return pd.Series([apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= k for x, y, k in zip(a, b, most, strict=True)], dtype=bool)


def _alike(size: int):
    @F.pandas_udf(T.BooleanType())
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(shingles(x, size), shingles(y, size)) for x, y in zip(a, b, strict=True)], dtype=bool)

    return alike


def _with_pivots(texts: DataFrame, nodes: DataFrame, met: DataFrame, size: int) -> DataFrame:
    """(a, b): members similar to the pivot of one of their postings; pairs that pass the suffix filter are compared, once each."""
    pairs = met.where("node <> p.node").where(_like(F.col("n"), F.col("i"), F.col("p.n"), F.col("p.i"))).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("parts").alias(f"parts_{k}"))
    pairs = keep(pairs.join(side("a"), "a").join(side("b"), "b").where(_close("parts_a", "parts_b", "n_a", "n_b")).select("a", "b"), "pairs")
    asked = keep(pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct(), "asked")
    some = likely(texts, asked).select("_row", "text")
    tested = pairs.join(some.withColumnsRenamed({"_row": "b", "text": "y"}), "b").join(some.withColumnsRenamed({"_row": "a", "text": "x"}), "a")
    found = keep(tested.where(_alike(size)("x", "y")).select("a", "b"), "similar")
    forget(pairs, asked)
    return found


def _may(n: np.ndarray, i: np.ndarray, c: np.ndarray, parts: list[bytes] | None) -> np.ndarray:
    """Members of a posting with a possible partner in another component, by length and position and, where parts are given, by those."""
    out = np.zeros(len(n), bool)
    apart_ = Apart([np.frombuffer(p, np.uint8) for p in parts]) if parts else None
    for k in range(len(n)):
        like = (c != c[k]) & _allowed(n, i, n[k], i[k])
        at = np.flatnonzero(like)
        out[k] = len(at) and (apart_ is None or (apart_.least(k, at) <= _most_apart(n[at], n[k])).any())
    return out


def _allowed(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """_like() on arrays."""
    return (np.maximum(n, m) * NUM <= np.minimum(n, m) * DEN) & ((NUM + DEN) * np.minimum(n - i, m - j) >= NUM * (n + m))


def _may_together(starts: np.ndarray, n: np.ndarray, i: np.ndarray, c: np.ndarray, parts: list[bytes] | None) -> np.ndarray:
    """_may() of many small postings, which begin at ``starts``."""
    size = np.diff(np.append(starts, len(n)))
    out, own = np.zeros(len(n), bool), np.repeat(np.arange(len(starts)), size)
    left = np.repeat(np.arange(len(n)), size[own])
    right = np.arange(len(left)) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + starts[own][left]
    like = (left < right) & (c[left] != c[right])
    left, right = left[like], right[like]
    like = _allowed(n[left], i[left], n[right], i[right])
    if parts is None:
        out[left[like]] = out[right[like]] = True
        return out
    most = _most_apart(n[left[like]], n[right[like]])
    for x, y, k in zip(left[like].tolist(), right[like].tolist(), most.tolist(), strict=True):
        if not (out[x] and out[y]) and apart(np.frombuffer(parts[x], np.uint8), np.frombuffer(parts[y], np.uint8)) <= k:
            out[x] = out[y] = True
    return out


def _partners(batches):
    """Members that may be similar to another one of their posting, of rows (s, node, n, i, c, p) or with parts; rows come by posting."""
    waiting, rows, long_, key = [], 0, False, None  # whole postings; or what a long posting has gathered

    def sent(every: bool):
        s, node, n, i, c, p = (np.concatenate([r[k] for r in waiting]) for k in range(6))
        parts = [x for r in waiting for x in r[6]] if waiting[0][6] is not None else None
        at = np.ones(len(node), bool)
        if not every:
            starts = np.flatnonzero(np.append(True, np.diff(s) != 0))
            size = np.diff(np.append(starts, len(s)))
            small = np.repeat(size <= SMALL, size)
            rank = np.cumsum(small) - 1
            at[small] = _may_together(rank[starts[size <= SMALL]], n[small], i[small], c[small], parts and [x for x, k in zip(parts, small.tolist(), strict=True) if k])
            for a, k in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                at[a : a + k] = _may(n[a : a + k], i[a : a + k], c[a : a + k], parts and parts[a : a + k])
        waiting.clear()
        columns = [pa.array(x[at]) for x in (s, node, n, i, c, p)]
        more = [pa.array([x for x, k in zip(parts, at.tolist(), strict=True) if k], pa.binary())] if parts else []
        return pa.RecordBatch.from_arrays(columns + more, ["s", "node", "n", "i", "c", "p", "parts"][: 6 + len(more)])

    in_posting = 0
    for b in batches:
        columns = [b.column(k).to_numpy().astype(np.int64) for k in range(6)]
        parts = b.column(6).to_pylist() if b.num_columns > 6 else None
        ends = [*np.flatnonzero(np.diff(columns[0])) + 1, b.num_rows]
        for at, end in zip([0, *ends], ends, strict=False):
            if at == end:
                continue
            part = [*(x[at:end] for x in columns), parts and parts[at:end]]
            if part[0][0] != key:
                if waiting and (long_ or rows >= TOGETHER):
                    yield sent(long_)
                    rows = 0
                key, in_posting, long_ = part[0][0], 0, False
            in_posting += end - at
            if in_posting > LOOKED_UP:
                if not long_:  # what came before it is whole; it goes on by itself, as far as it has been read
                    before = [r for r in waiting if r[0][0] != key]
                    own = [r for r in waiting if r[0][0] == key]
                    if before:
                        waiting[:] = before
                        yield sent(False)
                    waiting[:], long_ = own, True
                waiting.append(part)
                yield sent(True)
                rows = 0
                continue
            waiting.append(part)
            rows += end - at
    if waiting:
        yield sent(long_)


def joined(nodes: list[int], comps: list[int], sets: list[np.ndarray], own: list[np.ndarray], classes: np.ndarray) -> list[tuple[int, int]]:
    """Links (places in the lists) of a forest that connects similar sets of different components.

    ``own`` has the n-grams for which a set is here. A pair is compared if its first common prefix n-gram is among those of both;
    it then is not in any other star.
    """
    comp = np.array(comps)
    sizes = np.array([len(x) for x in sets])
    order = [ordered(x, classes) for x in sets]
    prefixes = [x[: prefix_length(len(x))] for x in order]
    here = [np.isin(x, o) for x, o in zip(prefixes, own, strict=True)]
    apart_ = Apart([parts_of(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    words, first = np.unique(flat, return_index=True)
    ends = np.append(first[1:], len(flat))
    index: dict[int, list] = {}
    out = []
    for k, x in enumerate(sets):
        at_k, at_j, mine = np.full(k, -1), np.zeros(k, np.int64), np.zeros(k, bool)
        for i in range(len(prefixes[k]) - 1, -1, -1):  # the first common n-gram is written last
            if (posting := index.get(int(prefixes[k][i]))) is not None:
                ids, places, flags = (np.array(y) for y in posting)
                at_k[ids], at_j[ids], mine[ids] = i, places, flags & here[k][i]
        for i, t in enumerate(prefixes[k].tolist()):
            posting = index.setdefault(t, [[], [], []])
            for to, value in zip(posting, (k, i, bool(here[k][i])), strict=True):
                to.append(value)
        n, m = len(x), sizes[:k]
        ok = mine & (at_k >= 0) & (comp[:k] != comp[k]) & _allowed(n, at_k, m, at_j)
        left = np.flatnonzero(ok)
        left = left[apart_.least(k, left) <= _most_apart(n, m[left])] if len(left) else left
        if not len(left):
            continue
        at = np.searchsorted(words, x)
        length = ends[at] - first[at]
        take = np.repeat(first[at] - np.cumsum(length) + length, length) + np.arange(length.sum())
        both = np.bincount(owner[take], minlength=len(sets))[left]
        for j in left[DEN * both >= NUM * (n + m[left] - both)].tolist():
            if comp[j] != comp[k]:
                comp[comp == comp[j]] = comp[k]
                out.append((j, k))
    return out


def _met(held, size: int):
    """(a, b): links inside each meeting of blocks; rows come by meeting, which holds two blocks at most."""

    def found(rows):
        links_ = joined([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], held.value) if len({r[1] for r in rows}) > 1 else []
        pairs = [(rows[j][0], rows[k][0]) for j, k in links_]
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in pairs], pa.int64()), pa.array([max(x) for x in pairs], pa.int64())], ["a", "b"])

    def run(batches):
        rows, key = [], None
        for b in sliced(batches, 256):
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            node, comp, own, texts = (b.column(k).to_pylist() for k in (3, 4, 5, 6))
            for k, at in enumerate(keys):
                if at != key:
                    if len(rows) > 1:
                        yield found(rows)
                    rows, key = [], at
                rows.append((node[k], comp[k], shingles(texts[k], size), np.array(own[k], np.int64).view(np.uint64)))
        if len(rows) > 1:
            yield found(rows)

    return run


def _in_stars(texts: DataFrame, nodes: DataFrame, met: DataFrame, held, size: int) -> DataFrame:
    """(a, b): links across components ``c`` of ``met(s, node, n, i, p, c)`` between members that are not their posting's pivot."""
    open_ = met.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).where("lo < hi AND k > 2").select("s")
    # a posting's pivot was compared with all of its members
    rows = met.where("node <> p.node").join(open_, "s").select("s", "node", "n", "i", "c", F.col("p.node").alias("p"))
    kinds = "s bigint, node bigint, n bigint, i bigint, c bigint, p bigint"
    rows = keep(rows.repartition("s").sortWithinPartitions("s").mapInArrow(_partners, kinds), "partners")
    rows = rows.join(nodes.select("node", "parts"), "node").select(*rows.columns, "parts").repartition("s").sortWithinPartitions("s")
    member = keep(rows.mapInArrow(_partners, f"{kinds}, parts binary").groupBy("p", "node", "c").agg(F.max("n").alias("n"), F.collect_set("s").alias("own")), "stars")
    sizes = member.groupBy("p", "c").agg(F.count("*").alias("k"), F.sum("n").alias("m"))
    star = sizes.groupBy("p").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.max("k").alias("k_main"), F.max_by("m", F.struct("k", "c")).alias("m_main"), F.sum("k").alias("k"), F.sum("m").alias("m"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda k, m: F.greatest(F.ceil(k / F.lit(BLOCK)), F.ceil(m / F.lit(BLOCK_SHINGLES)))
    star = star.select("p", "main", blocks(F.col("k"), F.col("m")).alias("whole"), blocks(F.col("k") - F.col("k_main"), F.col("m") - F.col("m_main")).alias("rest"), blocks(F.col("k_main"), F.col("m_main")).alias("mains"))
    dealt = member.join(star, "p").withColumn("h", F.xxhash64("node"))
    # a star of one block meets itself; in others each block of the rest meets the rest's later ones and all of the main component
    own = F.pmod("h", "rest")
    upto = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    zero, last = F.lit(0).cast("long"), F.col("rest") - 1
    places = F.when(F.col("whole") == 1, F.array(F.struct(zero.alias("i"), zero.alias("j")))).when(
        F.col("c") == F.col("main"), F.transform(upto(zero, last), lambda i: F.struct(i.alias("i"), (-1 - F.pmod("h", "mains")).alias("j")))
    ).otherwise(
        F.concat(
            F.transform(upto(zero, own), lambda i: F.struct(i.alias("i"), own.alias("j"))),
            F.transform(upto(own + 1, last), lambda j: F.struct(own.alias("i"), j.alias("j"))),
            F.transform(F.sequence(F.lit(1).cast("long"), F.col("mains")), lambda j: F.struct(own.alias("i"), (-j).alias("j"))),
        )
    )
    asked = keep(member.join(star.select("p"), "p").select(F.col("node").alias("_row")).distinct(), "asked")
    some = likely(texts, asked).select(F.col("_row").alias("node"), "text")
    laid = dealt.select("p", "node", "c", "own", F.explode(places).alias("at")).join(some, "node").select("p", "at.i", "at.j", "node", "c", "own", "text")
    laid = laid.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")
    found = keep(laid.mapInArrow(_met(held, size), "a bigint, b bigint").distinct(), "similar")
    forget(member, asked)
    return found


def _links(texts: DataFrame, nodes: DataFrame, classes: np.ndarray, size: int) -> DataFrame | None:
    """(a, b): links that connect all similar sets of ``texts(_row, text)``; None if no two are similar."""
    held = texts.sparkSession.sparkContext.broadcast(classes)
    posts = keep(texts.select("_row", "text").mapInArrow(_posted(held, size), "s bigint, node bigint, n int, i int"), "prefixes")
    shared = posts.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s")
    some = keep(posts.join(shared, "s"), "shared")
    forget(posts)
    pivots = some.groupBy("s").agg(F.min(F.struct("i", "n", "node")).alias("p"))
    met = keep(some.join(pivots, "s"), "met")
    forget(some)
    links = _with_pivots(texts, nodes, met, size)
    none = links.isEmpty()
    tree = None if none else components(links).select("node", F.col("root").alias("c"))
    now = met.withColumn("c", F.col("node")) if none else met.join(tree, "node", "left").withColumn("c", F.coalesce("c", "node"))
    more = _in_stars(texts, nodes, keep(now, "met-by-component"), held, size)
    forget(met)
    if more.isEmpty():
        return None if none else links
    return more if none else links.unionByName(more)


def classes_of(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``: the smallest doc_id reachable over links.

    Two rows link if their sets of word n-grams have a Jaccard similarity of 0.9 or more. Only A-Z are lower-cased, only ASCII white
    space parts words; fewer than ``size`` words are one n-gram. Rows without words, or without text, are linked with nothing, not even
    with each other: their component is their own doc_id. Equal sets (by 128-bit digests) are one class and never expanded into pairs. A null doc_id
    is a component's id only if all its rows have none. N-grams are compared by 64-bit hashes. An empty table gives an empty result;
    columns besides doc_id and text are left out.
    """
    used = ["doc_id", "text"]
    all_ = numbered(docs.select(*used), used, "rows").select("doc_id", "_row", "text")
    with small_batches(docs.sparkSession):
        kind = docs.schema["doc_id"].dataType.simpleString()
        described = keep(all_.mapInArrow(_described(size), f"doc_id {kind}, _row bigint, {_DESCRIBED}"), "described")
        rows = described.where("_row IS NOT NULL")
        some = rows.where("n > 0")
        least = keep(some.groupBy("key").agg(F.min("doc_id").alias("least"), F.min(F.struct("_row", "n", "parts")).alias("first")).select("key", "least", F.col("first._row").alias("node"), "first.n", "first.parts"), "sets")
        nodes = least.select("node", "n", "parts")
        copies = keep(rows.select("_row", "n", "key").join(least.select("key", "node"), "key", "left").where("n = 0 OR _row <> node").select("_row"), "copies")
        links = _links(without(all_.select("_row", "text"), copies), nodes, _classes(described), size)
        rooted = least.select("key", "least", "node") if links is None else least.join(components(links), "node", "left").select("key", "least", F.coalesce("root", "node").alias("node"))
        ids = rooted.groupBy("node").agg(F.min("least").alias("component_id"))
        known = keep(rooted.join(ids, "node").select("key", "component_id"), "components")
    empty = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n", "key").join(known, "key").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(empty)


ORACLE = """
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
    ), sets AS (
        SELECT doc_id, list_distinct(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' ')) END) AS s
        FROM w WHERE len(words) > 0
    ), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
    links AS (
        SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
        GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
    ), reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN links ON x = r.other),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, component_id FROM documents d LEFT JOIN sets USING (doc_id) JOIN least USING (doc_id)
"""
