"""Exact nearest vectors of many queries: both sides in cells, dense products where a cell of queries meets one of vectors.

A product in single precision only says which pairs are too far from a query's present best; the others are scored in double precision,
component by component in their order, as the Column expression of ``search.cosine`` does, so scores are equal to the last bit."""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

PLACES, ROWS, SLACK = 6, 2048, 2e-5  # of a score; vectors of a product; how far a product in single precision may be off, with the rounding


def rounded(scores: np.ndarray) -> np.ndarray:
    """To PLACES, halves away from zero by the shortest decimal form, as Spark rounds."""
    scaled = np.abs(scores) * 10.0**PLACES
    out = np.copysign(np.floor(scaled + 0.5) / 10.0**PLACES, scores)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(decimal.Decimal(repr(float(scores[i]))).quantize(decimal.Decimal(1).scaleb(-PLACES), decimal.ROUND_HALF_UP))
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of two matrices of one shape, summed in the order of their columns."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


class Cell:
    """The queries of a cell, and the k best of the vectors that have passed it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k, self.vectors = ids, k, vectors
        self.norms, self.unit, self.odd = self._units(vectors)
        self.order = np.argsort(ids, kind="stable")
        self.least = np.full(len(ids), -np.inf)  # what a query's k-th best has
        self.held = (np.empty(0, np.int64), np.empty(0, ids.dtype), np.empty(0))  # place of the query, id, score

    @staticmethod
    def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lengths, vectors of length 1 in single precision, which have none as their length is no common number)."""
        with np.errstate(all="ignore"):
            norms = np.sqrt(dots(v, v))
            odd = ~((norms > 1e-100) & (norms < 1e100))
            return norms, np.where(odd[:, None], 0, v / norms[:, None]).astype(np.float32), odd

    def take(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms, unit, odd = self._units(vectors)
        near = unit @ self.unit.T
        near[odd], near[:, self.odd] = -np.inf, -np.inf
        own = self.ids[self.order]
        first, last = np.searchsorted(own, ids, "left"), np.searchsorted(own, ids, "right")
        for i in np.flatnonzero(last > first):
            near[i, self.order[first[i] : last[i]]] = -np.inf
        least = self.least
        if len(near) >= self.k and (fresh := np.flatnonzero(least == -np.inf)).size:
            least = least.copy()
            least[fresh] = np.partition(near[:, fresh], len(near) - self.k, axis=0)[len(near) - self.k]
        may = (near >= (least - SLACK).astype(np.float32)) & (near > -np.inf)
        may[odd], may[:, self.odd] = True, True
        at, q = np.nonzero(may)
        other = ids[at] != self.ids[q]
        self._add(ids, vectors, norms, at[other], q[other])

    def _add(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, at: np.ndarray, q: np.ndarray) -> None:
        scores = np.empty(len(at))
        with np.errstate(all="ignore"):
            for i in range(0, len(at), 1 << 16):
                a, b = at[i : i + (1 << 16)], q[i : i + (1 << 16)]
                scores[i : i + (1 << 16)] = dots(vectors[a], self.vectors[b]) / (norms[a] * self.norms[b])
            some = norms[at] * self.norms[q] != 0
        if not some.any():
            return
        touched = np.zeros(len(self.ids), bool)
        touched[q[some]] = True
        mine = touched[self.held[0]]
        where, who, score = (np.concatenate([h[mine], n]) for h, n in zip(self.held, (q[some], ids[at[some]], scores[some])))
        order = np.lexsort((who, np.where(np.isnan(score), -np.inf, -rounded(score)), where))
        where, who, score = where[order], who[order], score[order]
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        place = np.arange(len(where)) - np.repeat(starts, np.diff(np.r_[starts, len(where)]))
        full = place == self.k - 1
        self.least[where[full]] = np.where(np.isnan(score[full]), np.inf, score[full])
        kept = place < self.k
        self.held = tuple(np.concatenate([h[~mine], n[kept]]) for h, n in zip(self.held, (where, who, score)))


def many_top(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, cells: int) -> DataFrame:
    """(query_id, id, score): of every query, in each cell of vectors, the k best by rounded score, ties by id, own id left out. Queries
    are in so many cells, vectors in as many as tasks then need; a task holds the queries of one cell and passes vectors by."""
    spark = vectors.sparkSession
    ship(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cells)
    lanes = -(-tasks // cells)
    of = dict(vectors.dtypes)[id_col]
    lane = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def side(df: DataFrame, kind: int) -> DataFrame:
        whole = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
        own, other = ("lane", "cell") if kind else ("cell", "lane")
        dealt = whole.withColumn(own, lane(lanes if kind else cells)).withColumn(other, each(cells if kind else lanes))
        v = F.col("v") if dict(df.dtypes)[vector_col] == "array<double>" else F.col("v").cast("array<float>")
        return dealt.select(F.size("v").alias("width"), "cell", "lane", F.lit(kind).alias("kind"), "id", v.alias("v"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked, cell = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if cell is not None and len(cell.held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(cell.ids[cell.held[0]]), pa.array(cell.held[1]), pa.array(cell.held[2])], ["query_id", "id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            ids, values = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for start, end in zip(edges, [*edges[1:], len(keys)]):
                here, kind = tuple(keys[start, :3]), keys[start, 3]
                if here != key:
                    yield from out()
                    key, asked, cell = here, [], None
                if not kind:
                    asked.append((ids[start:end], values.slice(start, end - start).flatten().to_numpy().reshape(-1, here[0]).astype(np.float64)))
                    continue
                if cell is None and asked:
                    cell, asked = Cell(np.concatenate([a for a, _ in asked]), np.concatenate([b for _, b in asked]), k), []
                for at in range(start, end, ROWS) if cell is not None else ():
                    n = min(ROWS, end - at)
                    cell.take(ids[at : at + n], values.slice(at, n).flatten().to_numpy().reshape(-1, here[0]).astype(np.float64))
        yield from out()

    met = side(queries, 0).unionByName(side(vectors, 1)).repartition(tasks, "width", "cell", "lane").sortWithinPartitions("width", "cell", "lane", "kind")
    return met.mapInArrow(best, f"query_id {of}, id {of}, score double")
