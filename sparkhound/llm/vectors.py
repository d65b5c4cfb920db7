"""A paged index of vectors and the two rounds of a best-first search over it: shared by the two vector searches.

Rows are dealt to cells by their nearest pivot, cells are cut into pages of about ``ROWS`` rows, and each page is written once
to the shared folder with what the search needs (codes, tree). The directory holds a pivot, a covering radius and a page count
for each of at most ``CELLS`` cells (and one cell for each length of vectors that has no pivot), so it is small whatever the
input. Queries travel to pages in packets; pages are never sent along with queries. In the first round a query meets the pages
of the nearest cell and so gets a bound; in the second it meets the cells whose least possible distance, by the triangle
inequality, is within the bound, and carries the bound with it. Nothing nearer can lie elsewhere, so no cell is cut by number.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import forget, keep, sliced

#: Rows in a page and in a cell of small tables, about; queries in a packet at most.
ROWS, QUERIES = 8192, 1024
CELLS = 1024
#: Packets that meet one copy of a page; a page asked by more is copied, so that no task gets them all.
PACKETS = 64
#: Rounding allowed for in bounds.
SLACK = 1e-6


def usable(table: DataFrame, zero: bool = False) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a vector of finite components; zero vectors only if asked for."""
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    if not zero:
        good &= F.exists(x, lambda v: v != 0)
    return table.select("vec_id", "embedding").where(F.col("vec_id").isNotNull()).where(good)


def far(points: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - p) ** 2).sum(1))


def by_dim(column: pa.Array):
    """(dim, rows, vectors) for each length of vectors in a column of lists."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        at = np.flatnonzero(size == dim)
        yield dim, at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass
class Space:
    """How vectors of one length become points of a metric; both maps take and give rows of float64."""

    point: Callable[[np.ndarray], np.ndarray]
    query: Callable[[np.ndarray], np.ndarray]


class Index:
    """Pages and their directory; ``spaces(dim)`` gives the metric, ``build(x, space)`` what a page keeps beside its vectors."""

    def __init__(self, rows: DataFrame, spaces: Callable[[int], Space], build: Callable, name: str, page_rows: int = ROWS, cells: int = CELLS):
        self.spark, self.spaces, self.name = rows.sparkSession, spaces, name
        self.kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
        self.rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()), f"{name}-vectors")
        n = self.rows.count()
        wanted = max(1, min(cells, n // page_rows + 1))
        #: pivots by length, their numbers following each other
        self.pivots: dict[int, tuple[int, np.ndarray]] = {}
        sample: dict[int, list] = {}
        for r in self.rows.orderBy(F.xxhash64("_row")).limit(wanted).select("embedding").collect():
            sample.setdefault(len(r[0]), []).append(r[0])
        at = 0
        for dim, x in sorted(sample.items()):
            self.pivots[dim] = (at, spaces(dim).point(np.array(x, np.float64)))
            at += len(x)
        self.placed = keep(self._placed(), f"{name}-placed")
        forget(self.rows)
        directory = self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
        self.pages = {r["cell"]: max(1, -(-r["n"] // page_rows)) for r in directory}
        self.radius = {r["cell"]: r["radius"] for r in directory}
        self.table = self._written(build)

    def _placed(self) -> DataFrame:
        """(cell, far, _row, vec_id, vector): each row by its nearest pivot; vectors without a pivot are in cell -dim."""
        pivots, spaces, kind = self.pivots, self.spaces, self.kind

        def run(batches):
            for b in sliced(batches, 2048):
                cell, dist, raw = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), [b""] * b.num_rows
                for dim, at, x in by_dim(b.column(1)):
                    point = spaces(dim).point(x.astype(np.float64))
                    if dim in pivots:
                        first, p = pivots[dim]
                        square = (point**2).sum(1)[:, None] - 2 * point @ p.T + (p**2).sum(1)
                        near = square.argmin(1)
                        cell[at], dist[at] = first + near, np.sqrt(((point - p[near]) ** 2).sum(1))
                    else:
                        cell[at] = -dim
                    for k, v in zip(at.tolist(), x.astype(kind), strict=True):
                        raw[k] = v.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(dist), b.column(2), b.column(0), pa.array(raw, pa.binary())], ["cell", "far", "_row", "vec_id", "vector"])

        return self.rows.select(F.col("vec_id").cast("long"), "embedding", "_row").mapInArrow(run, "cell long, far double, _row long, vec_id long, vector binary")

    def _lookup(self, values: dict[int, int], name: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(int(k), int(v)) for k, v in values.items()], f"cell long, {name} long"))

    def _written(self, build: Callable) -> DataFrame:
        """(cell, page, dim, n, rows, ids, vectors, extra): pages with rows by ascending id."""
        spaces, kind = self.spaces, self.kind

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["vec_id", "_row"], kind="stable")
            dim = len(pdf.vector.iloc[0]) // np.dtype(kind).itemsize
            x = np.frombuffer(b"".join(pdf.vector), kind).reshape(-1, dim)
            extra = pickle.dumps(build(x.astype(np.float64), spaces(dim)))
            row = (int(pdf.cell.iloc[0]), int(pdf.page.iloc[0]), dim, len(pdf), pdf._row.to_numpy("<i8").tobytes(), pdf.vec_id.to_numpy("<i8").tobytes(), x.tobytes(), extra)
            return pd.DataFrame([row], columns=["cell", "page", "dim", "n", "rows", "ids", "vectors", "extra"])

        dealt = self.placed.join(self._lookup(self.pages, "pages"), "cell").withColumn("page", F.pmod(F.xxhash64("_row"), F.col("pages")))
        return keep(dealt.groupBy("cell", "page").applyInPandas(pack, "cell long, page long, dim int, n int, rows binary, ids binary, vectors binary, extra binary"), f"{self.name}-pages")

    def queries(self, every: int) -> DataFrame:
        """(cell, _row, vec_id, vector) of rows whose id is divisible by ``every``."""
        return self.placed.where(F.col("vec_id") % every == 0).select("cell", "_row", "vec_id", "vector")

    def _packets(self, queries: DataFrame, own_cell: bool) -> DataFrame:
        """(cell, dim, n, rows, ids, vectors, bounds): queries in packets by the cell that they go to."""
        pivots, spaces, kind, radius = self.pivots, self.spaces, self.kind, self.radius
        number = np.array(sorted(radius), np.int64)

        def packets(cell, dim, rows, ids, raw, bound):
            for at in range(0, len(rows), QUERIES):
                part = slice(at, at + QUERIES)
                yield cell, dim, len(rows[part]), rows[part].tobytes(), ids[part].tobytes(), raw[part].tobytes(), bound[part].tobytes()

        def run(batches):
            for b in batches:
                home, rows, ids = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2))
                bound = b.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
                raws = b.column(3).to_pylist()
                size = np.array([len(r) for r in raws], np.int64) // np.dtype(kind).itemsize
                out = []
                for dim in np.unique(size).tolist():
                    at = np.flatnonzero(size == dim)
                    x = np.frombuffer(b"".join(raws[k] for k in at), kind).reshape(-1, dim)
                    q = spaces(dim).query(x.astype(np.float64))
                    margin = SLACK * (1 + 1e-3 * np.sqrt((q * q).sum(1)))
                    first, p = pivots.get(dim, (0, np.zeros((0, 0))))
                    for cell in number[((number >= first) & (number < first + len(p))) | (number == -dim)].tolist():
                        if own_cell:
                            goes = home[at] == cell
                        elif cell < 0:
                            goes = home[at] != cell
                        else:
                            goes = (home[at] != cell) & (far(q, p[cell - first]) - radius[cell] <= bound[at] * (1 + SLACK) + margin)
                        if goes.any():
                            out += packets(cell, dim, rows[at[goes]], ids[at[goes]], x[goes], bound[at[goes]])
                columns = list(zip(*out, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cell", "dim", "n", "rows", "ids", "vectors", "bounds"])

        return queries.select("cell", "_row", "vec_id", "vector", "bound").mapInArrow(run, "cell long, dim int, n int, rows binary, ids binary, vectors binary, bounds binary")

    def _met(self, queries: DataFrame, own_cell: bool, search: Callable) -> DataFrame:
        """(query, query_id, vec_id, distance, score): what packets find on the pages of their cells."""
        spaces, kind = self.spaces, self.kind
        packets = keep(self._packets(queries, own_cell).withColumn("packet", F.monotonically_increasing_id()), f"{self.name}-packets")
        asked = {r["cell"]: -(-r["n"] // PACKETS) for r in packets.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        if not asked:
            return None
        sent = packets.join(self._lookup(self.pages, "pages"), "cell").join(self._lookup(asked, "copies"), "cell")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        sent = sent.withColumn("copy", F.pmod(F.xxhash64("packet"), F.col("copies"))).withColumn("page", each("pages"))
        sent = sent.select("cell", "page", "copy", F.lit(1).alias("kind"), "dim", "rows", "ids", "vectors", F.col("bounds").alias("extra"))
        pages = self.table.join(self._lookup(asked, "copies"), "cell").withColumn("copy", each("copies"))
        pages = pages.select("cell", "page", "copy", F.lit(0).alias("kind"), "dim", "rows", "ids", "vectors", "extra")

        def run(batches):
            page = None
            for b in sliced(batches, 1):
                kind_, dim = b.column(3)[0].as_py(), b.column(4)[0].as_py()
                rows, ids, raw, extra = (b.column(k)[0].as_py() for k in (5, 6, 7, 8))
                rows, ids, x = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(raw, kind).reshape(-1, dim)
                if kind_ == 0:  # a page comes before its packets
                    page = (rows, ids, x, pickle.loads(extra))
                    continue
                found = search(*page, spaces(dim), rows, x, np.frombuffer(extra, "<f8"))
                at = [f[0] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[at]), pa.array(ids[at]), *[pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()))]],
                    ["query", "query_id", "vec_id", "distance", "score"],
                )

        laid = pages.unionByName(sent).repartition("cell", "page", "copy").sortWithinPartitions("cell", "page", "copy", "kind")
        found = keep(laid.mapInArrow(run, "query long, query_id long, vec_id long, distance double, score long"), f"{self.name}-found")
        forget(packets)
        return found

    def nearest(self, every: int, top: int, search: Callable, order: list) -> DataFrame:
        """(query, query_id, rank, vec_id, distance, score): the ``top`` rows of each query in ``order``."""
        queries = self.queries(every)
        none = queries.withColumn("bound", F.lit(float("inf")))
        found = self._met(none, True, search)
        if found is not None:
            kept = found.groupBy("query").agg(F.sort_array(F.collect_list("distance")).alias("d"))
            bound = kept.select(F.col("query").alias("_row"), F.coalesce(F.try_element_at("d", F.lit(top)), F.lit(float("inf"))).alias("bound"))
            bounded = queries.join(bound, "_row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
            more = self._met(bounded, False, search)
            found = found if more is None else found.unionByName(more)
        else:
            found = self.spark.createDataFrame([], "query long, query_id long, vec_id long, distance double, score long")
        w = Window.partitionBy("query").orderBy(*order, "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
