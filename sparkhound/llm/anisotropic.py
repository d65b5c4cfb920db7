"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Nearness |q - x| falls as q.x - |x|^2 / 2 grows, an inner product of (q, -1/2) and (x, |x|^2); the last component is kept
exact and x is quantised for maximum inner product. The space is cut into subspaces of two components with 16 codewords
each. Codewords are fitted on a sample of at most ``TRAIN`` vectors to the anisotropic loss
    eta * |parallel part of the residual|^2 + |orthogonal part|^2,
whose parallel part (along x) matters most where the score is high; codes are chosen by coordinate descent on that loss over
all subspaces, and codewords by solving its normal equations. Codes are written once, with the pages of `vectors`; two of them
share a byte. A query's table of 256 sums for each byte scores all rows of a page by lookups, and the best ``RERANK`` rows of
the page are measured exactly. So is every further row that could still be among the nearest: by its codes' distance to the
query less its own quantisation error it may lie no farther than the last of the nearest so far, on this page or those that the
query has met before. Tight groups of any size are thus searched whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

SUB = 2
WORDS = 16
ETA = 4.0
TRAIN = 4096
RERANK = 200
TOP = 10


class Quantiser:
    """Codebooks of shape (subspaces, 16, 2)."""

    def __init__(self, books: np.ndarray, dim: int):
        self.books, self.dim = books, dim

    @staticmethod
    def padded(x: np.ndarray) -> np.ndarray:
        return np.pad(x.astype(np.float64), ((0, 0), (0, -x.shape[1] % (2 * SUB))))

    @classmethod
    def fit(cls, sample: np.ndarray, rounds: int = 6, seed: int = 7) -> Quantiser:
        x = cls.padded(sample)
        n, d = x.shape
        parts = x.reshape(n, d // SUB, SUB)
        rng = np.random.default_rng(seed)
        books = np.stack([parts[rng.choice(n, WORDS, replace=n < WORDS), m] for m in range(d // SUB)])
        q = cls(books, sample.shape[1])
        for _ in range(rounds):
            codes = q.encode(sample)
            q._refit(parts, codes)
        return q

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, subspaces): nearest codewords first, then coordinate descent on the anisotropic loss."""
        x = self.padded(x)
        n, d = x.shape
        parts = x.reshape(n, d // SUB, SUB)
        norm = np.sqrt((x * x).sum(1))
        unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0).reshape(parts.shape)
        err = parts[:, :, None, :] - self.books[None]  # rows, subspaces, words, SUB
        sq, along = (err * err).sum(3), np.einsum("nmks,nms->nmk", err, unit)
        codes = sq.argmin(2)
        total = np.take_along_axis(along, codes[:, :, None], 2).sum((1, 2))
        for _ in range(sweeps):
            for m in range(parts.shape[1]):
                rest = total - along[np.arange(n), m, codes[:, m]]
                loss = sq[:, m] + (ETA - 1) * (rest[:, None] + along[:, m]) ** 2
                codes[:, m] = loss.argmin(1)
                total = rest + along[np.arange(n), m, codes[:, m]]
        return codes.astype(np.uint8)

    def _refit(self, parts: np.ndarray, codes: np.ndarray) -> None:
        n, subs, _ = parts.shape
        norm = np.sqrt((parts * parts).sum((1, 2)))
        unit = np.divide(parts, norm[:, None, None], out=np.zeros_like(parts), where=norm[:, None, None] > 0)
        got = self.books[np.arange(subs)[None], codes]
        along = ((parts - got) * unit).sum(2)
        total = along.sum(1)
        for m in range(subs):
            rest = total - along[:, m]
            for w in range(WORDS):
                has = codes[:, m] == w
                if not has.any():
                    continue
                u, x = unit[has, m], parts[has, m]
                # minimise sum |x - c|^2 + (eta - 1) (rest + u.(x - c))^2
                a = has.sum() * np.eye(SUB) + (ETA - 1) * u.T @ u
                b = x.sum(0) + (ETA - 1) * (u * (rest[has] + (u * x).sum(1))[:, None]).sum(0)
                self.books[m, w] = np.linalg.solve(a, b)
            along[:, m] = ((parts[:, m] - self.books[m, codes[:, m]]) * unit[:, m]).sum(1)
            total = rest + along[:, m]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): sums of two codewords' inner products with each query; in single precision where it can hold them."""
        parts = self.padded(q).reshape(len(q), -1, SUB)
        one = np.einsum("qms,mks->qmk", parts, self.books)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), -1, WORDS * WORDS).astype(np.float32 if np.abs(one).max(initial=0) < 1e30 else np.float64)


def encoded(x: np.ndarray, quantiser: Quantiser) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, two a byte, by byte and row; squared norms; squared norms of the codes; quantisation errors)."""
    codes = quantiser.encode(x)
    coded = quantiser.books[np.arange(codes.shape[1])[None], codes].reshape(len(x), -1)
    error = np.sqrt(((quantiser.padded(x) - coded) ** 2).sum(1))
    return np.ascontiguousarray((codes[:, 0::2] << 4 | codes[:, 1::2]).T), (x * x).sum(1), (coded * coded).sum(1), error


def search_page(rows, ids, x, codes, metric, q_rows, q, bounds, quantiser: Quantiser, top: int, rerank: int):
    """(query, vec_id, distance, None) on one page; ties of a distance go to the smaller id."""
    packed, square, coded, error = codes
    exact, asked = x.astype(np.float64), q.astype(np.float64)
    tables = quantiser.tables(asked)
    out = []
    for k, (row, bound) in enumerate(zip(q_rows.tolist(), bounds.tolist(), strict=True)):
        query = asked[k]
        product = np.zeros(len(ids), tables.dtype)
        for m in range(len(packed)):
            product += tables[k, m][packed[m]]
        open_ = rows != row  # its own row takes no part; further rows with its id do
        score = np.where(open_, product - 0.5 * square, -np.inf)
        want = min(rerank, int(open_.sum()))
        if not want:
            continue
        size = query @ query + coded
        slack = 4e-7 * (len(packed) + 2) * size  # single-precision sums
        least = size - 2.0 * product - slack  # squared distance to the codes, at least
        if bound < np.inf:  # met before: what the codes leave open within the bound, best first
            near = np.flatnonzero(open_ & (least <= (bound + error) ** 2))
            near = near[np.argsort(-score[near], kind="stable")]
        else:
            near = np.argpartition(-score, want - 1)[:want]
        head, rest = near[:want], near[want:]
        dist = np.sqrt(((exact[head] - query) ** 2).sum(1))
        limit = min(bound, np.partition(dist, top - 1)[top - 1]) if len(dist) >= top else bound
        if bound == np.inf:
            more = open_ & (least <= (limit + error) ** 2) if limit < np.inf else open_.copy()
            more[head] = False
            rest = np.flatnonzero(more)
        else:
            rest = rest[least[rest] <= (limit + error[rest]) ** 2]
        near = np.concatenate([head, rest])
        dist = np.concatenate([dist, np.sqrt(((exact[rest] - query) ** 2).sum(1))])
        for j in np.lexsort((ids[near], dist))[:top]:
            out.append((k, int(ids[near[j]]), float(dist[j]), None))
    return out


def nearest(table: DataFrame, every: int = 100, top: int = TOP, rerank: int = RERANK, train: int = TRAIN, page_rows: int = vectors.ROWS, cells: int = vectors.CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the ``top`` nearest rows found.

    Euclidean distance in double precision on the original vectors; a query's own row is left out. Null ids, null or empty
    vectors, zero vectors and vectors with null or non-finite components take no part; vectors of unlike length never meet.
    Codebooks are fitted on at most ``train`` vectors (the smallest id hashes), for lengths not among them on at most as many of
    a page; every row is indexed. An empty table, or one without queries, gives an empty result. Equal distances keep the
    smaller ids, so copies of a vector are not lost to ties.
    """
    rows = vectors.usable(table)
    sample = rows.select("embedding").orderBy(F.xxhash64("vec_id")).limit(train).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r[0]), []).append(r[0])
    books = {d: Quantiser.fit(np.array(v, np.float64)) for d, v in by_dim.items()}

    def build(x, metric):
        quantiser = books.get(x.shape[1]) or Quantiser.fit(x[:train])
        return None if x.shape[1] in books else quantiser, encoded(x, quantiser)

    def search(ids_, ids, x, extra, metric, q_rows, q, bounds):
        return search_page(ids_, ids, x, extra[1], metric, q_rows, q, bounds, extra[0] or books[x.shape[1]], top, rerank)

    same = lambda x: x
    index = vectors.Index(rows, lambda dim: vectors.Space(same, same), build, "ann", page_rows, cells)
    found = index.nearest(every, top, search, [F.col("distance")])
    return found.select("query_id", "rank", "vec_id", F.col("distance").alias("score"))
