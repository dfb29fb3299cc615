"""Approximate nearest neighbours by inner product: an inverted file whose lists are scanned dimension-adaptively.

*Measure to distance.* Every vector gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and every query a
zero; then the nearest by Euclidean distance is the largest by inner product.

*Lists.* Centroids are fitted by k-means on a bounded sample (``SAMPLE`` vectors, those whose hashed ids come first), coarse
ones, and, for tables of more than ``COARSE`` x ``PER_LIST`` vectors, fine ones for what is left of a vector less its coarse
centroid, which all coarse cells share. A list is a coarse cell and a fine one, so there is a list for about every
``PER_LIST`` vectors up to ``COARSE`` x ``FINE`` lists, while the model stays small. Every vector is indexed, in the list of its nearest centroids.
How many lists a query probes is tuned on the part of the sample (one in ``HELD_OUT``) that the fit leaves
out: these vectors are asked as queries are, with a zero for the added coordinate, and so many lists are probed that ``REACH``
of their neighbours by inner product within that part lie in them.
Lists are dealt out in groups of neighbouring lists. A group's vectors are dealt to blocks of about ``BLOCK_ROWS``, and the
queries that probe it to blocks of about ``QUERY_ROWS``; every block of vectors meets every block of queries once, so no
task holds a group, nor all queries of one.

*Scan.* Vectors and queries are turned by one random rotation, so that any leading coordinates hold a fair share of a
distance, and lists are kept in columns, ``STRIPE`` coordinates at a time. A query's bound is its distance to the
``SPARE`` (k + 1)-th nearest of those vectors of the sample that are in its lists, which the (k + 1)-th nearest in the lists
cannot exceed (a query probes more lists while these hold fewer of the sample). The sample gives the bound and nothing else: every
answer comes from a list. Stripe by stripe, partial distances
to all vectors of a list grow, and a vector is abandoned as soon as the hypothesis that its distance is within the bound
is refuted: with d of D coordinates seen, when sqrt(partial * D / d) > bound * (1 + EPSILON / sqrt(d)) (the test of
ADSampling). Partial distances are matrix products while most vectors survive, and are taken one by one after that. Survivors'
scores are inner products of the original vectors in double precision.

*Copies.* Equal vectors are indexed and searched once: a class of copies carries the k + 1 smallest ids of its own, which
is all that any answer can need, found with partial group limits; so a vector that a third of all rows share is no hot
key. Answers are expanded to the rows of each query class last, over ``SALTS`` salts.

Defined results. Rows with a null id, or vectors null, empty, zero or holding null or non-finite components, take no part;
nor do vectors of another than the most frequent length (the larger of equals), which have no inner product with the others. Repeated ids with equal vectors count once.
An empty table, or one without queries, gives no rows. Vectors of floats stay floats, others are doubles; scores are sums in
double precision of the vectors as they are. Only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, materialise, ship, table

K, EVERY = 20, 20
SAMPLE, PER_LIST, COARSE, FINE, GROUP, BLOCK_ROWS, QUERY_ROWS, REACH, TUNING = 16_384, 128, 2048, 1024, 8, 512, 256, 0.96, 512
STRIPE, EPSILON, DENSE, SALTS, SEED, SPARE, HELD_OUT, RANKED = 16, 2.1, 0.15, 16, 11, 2, 4, 16_384


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast(kind).alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0))
    rows = rows.where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (width["n"] if width else 0))


def rotation(n: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
    return c


def scan_list(x: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) positions of the pairs within each query's bound (squared), at most k of the nearest a query, and
    ties. x, q: rotated rows."""
    width, seen = x.shape[1], 0
    rows, cols, partial = None, None, np.zeros((len(q), len(x)))
    for a in range(0, width, STRIPE):
        xs, qs = x[:, a : a + STRIPE], q[:, a : a + STRIPE]
        if rows is None:
            partial += (qs * qs).sum(axis=1)[:, None] + (xs * xs).sum(axis=1)[None] - 2 * (qs @ xs.T)
        else:
            d = xs[cols] - qs[rows]
            partial += np.einsum("ij,ij->i", d, d)
        seen += xs.shape[1]
        limit = bound * ((1 + epsilon / np.sqrt(seen)) ** 2 * seen / width if seen < width else 1 + 1e-9) + 1e-9
        if rows is None:
            keep = partial <= limit[:, None]
            if seen == width or keep.mean() < DENSE:
                rows, cols = np.nonzero(keep)
                partial = partial[rows, cols]
        else:
            keep = partial <= limit[rows]
            rows, cols, partial = rows[keep], cols[keep], partial[keep]
        if rows is not None and not len(rows):
            break
    if len(rows) > k:
        order = np.lexsort((partial, rows))
        rows, cols, partial = rows[order], cols[order], partial[order]
        start = np.searchsorted(rows, rows)
        last = np.minimum(start + k - 1, len(rows) - 1)
        keep = (np.arange(len(rows)) - start < k) | ((rows[last] == rows) & (partial <= partial[last] * (1 + 1e-9) + 1e-9))
        rows, cols = rows[keep], cols[keep]
    return rows, cols


class Index:
    """Centroids, rotation, sample and largest norm: what is broadcast, of bounded size."""

    def __init__(self, sample: np.ndarray, largest: float, rows: int, k: int):
        self.largest, self.k = largest, k
        self.sample = self.augment(sample)
        self.rotation = rotation(self.sample.shape[1])
        self.fitted = len(sample) - len(sample) // HELD_OUT
        most = max(1, len(sample) // 8)  # centroids that the sample can tell apart
        c = kmeans(self.sample[: self.fitted], max(1, min(COARSE, rows // PER_LIST, most)))
        # Neighbouring lists get neighbouring numbers: in order along the centroids' principal axis.
        axis = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0] if len(c) > 1 else np.ones(c.shape[1])
        self.coarse = c[np.argsort(c @ axis, kind="stable")]
        self.fine = np.zeros((1, c.shape[1]))
        if (cells := min(FINE, rows // (PER_LIST * len(c)), most)) > 1:
            self.fine = kmeans(self._left(self.sample[: self.fitted])[1], cells)
        self.cross = 2 * self.coarse @ self.fine.T
        self.own = self.assign(self.sample)  # the sample's lists
        self.held = np.bincount(self.own, minlength=self.lists)
        self.probes = self._tune()

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def _left(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest coarse centroid, what is left of each vector less it)."""
        near = _distances(x, self.coarse).argmin(axis=1)
        return near, x - self.coarse[near]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The list of every vector."""
        near, left = self._left(x)
        return near * len(self.fine) + _distances(left, self.fine).argmin(axis=1)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists of every query, the nearest first: of its nearest coarse cells, about RANKED lists in all (at least those of
        32 cells)."""
        coarse, fine = _distances(q, self.coarse), _distances(q, self.fine)
        cells = min(len(self.coarse), max(32, RANKED // len(self.fine)))
        near = np.argsort(coarse, axis=1, kind="stable")[:, :cells]
        d = np.take_along_axis(coarse, near, axis=1)[:, :, None] + self.cross[near] + fine[:, None, :]
        at = np.argsort(d.reshape(len(q), -1), axis=1, kind="stable")
        return np.take_along_axis(near, at // len(self.fine), axis=1) * len(self.fine) + at % len(self.fine)

    def _tune(self) -> int:
        """On vectors that the centroids were not fitted on: those that were lie nearer to their centroids than the table's."""
        x, n = self.sample[self.fitted :], len(self.sample) - self.fitted
        k = min(self.k, n - 1)
        if k < 1:
            return self.lists
        pick = np.random.default_rng(SEED).choice(n, size=min(TUNING, n), replace=False)
        asked = self.queries(x[pick, :-1])
        d = -(asked @ x.T)  # the asked vectors' last coordinate is zero
        d[np.arange(len(pick)), pick] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        place = np.concatenate([places(o, own) for at in range(0, len(pick), 64) for o, own in zip(self.order(asked[at : at + 64]), self.own[self.fitted :][near[at : at + 64]], strict=True)])
        return min(self.lists, int(np.quantile(place, REACH)) + 1)

    def augment(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        more = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, more[:, None]])

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x.astype(np.float64), np.zeros((len(x), 1))])

    def lists_and_bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Of each query: the lists it probes, and the squared distance to the SPARE (k + 1)-th nearest of the sample in
        them; infinite where the sample has no more."""
        least = SPARE * (self.k + 1)
        order = self.order(q)
        held = np.cumsum(self.held[order], axis=1)
        probes = np.minimum(np.maximum(self.probes, (held < least).sum(axis=1) + 1), order.shape[1])
        lists = [np.sort(x[:n]) for x, n in zip(order, probes.tolist(), strict=True)]
        bounds = np.full(len(q), np.inf)
        d = (q * q).sum(axis=1)[:, None] + (self.sample**2).sum(axis=1)[None] - 2 * (q @ self.sample.T)
        for i, own in enumerate(lists):
            near = d[i, np.isin(self.own, own)]
            if len(near) >= least:
                bounds[i] = np.partition(near, least - 1)[least - 1]
        return [x.astype(np.int32) for x in lists], bounds


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, less each row's own square."""
    return (centroids**2).sum(axis=1) - 2 * (x @ centroids.T)


def places(order: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted list stands in an order; its length for those that do not."""
    by = np.argsort(order, kind="stable")
    seat = np.minimum(np.searchsorted(order, wanted, sorter=by), len(order) - 1)
    return np.where(order[by[seat]] == wanted, by[seat], len(order))


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found to every row where is_query (a condition on vec_id)."""
    ship(vectors.sparkSession)
    with Scratch(vectors.sparkSession):
        return _search(usable(vectors, id_col, vector_col), is_query, k)


def _search(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    spark, kind = rows.sparkSession, dict(rows.dtypes)["v"]
    by_id = Window.partitionBy("v").orderBy("vec_id")
    first = rows.select("v", "vec_id").withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    classes = first.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))  # k + 1 ids at most
    classes = materialise(classes.withColumn("class", F.col("ids")[0]), "ann-classes")
    queries = materialise(rows.where(is_query).select("vec_id", "v"), "ann-queries")

    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(square)).alias("largest")).first()
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("v").toPandas()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = spark.sparkContext.broadcast(Index(np.stack([np.asarray(x, np.float64) for x in sample["v"]]), stats["largest"], stats["n"], k))

    def assign(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                yield part.assign(list=held.value.assign(held.value.augment(np.stack(part["v"].to_numpy()))).astype(np.int32))

    def probe(batches):
        index = held.value
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                q = index.queries(np.stack(part["v"].to_numpy()))
                best, bounds = index.lists_and_bounds(q)
                rows = []
                for query, v, bound, lists in zip(part["query"], part["v"], bounds, best, strict=True):
                    group = lists // GROUP
                    cuts = np.flatnonzero(np.diff(group)) + 1
                    rows += [(int(x[0]) // GROUP, query, v, bound, x) for x in np.split(lists, cuts)]
                yield pd.DataFrame(rows, columns=["group", "query", "q", "bound", "lists"])

    indexed = materialise(classes.mapInPandas(assign, f"v {kind}, ids array<long>, class long, list int"), "ann-index")
    asked = queries.groupBy("v").agg(F.min("vec_id").alias("query"))
    probed = materialise(asked.mapInPandas(probe, f"group int, query long, q {kind}, bound double, lists array<int>"), "ann-probed")
    group = F.floor(F.col("list") / GROUP).cast("int").alias("group")
    parts = lambda most: F.ceil(F.count(F.lit(1)) / most).cast("int")
    # A row for each group: lists / GROUP of them at most.
    sizes = indexed.groupBy(group).agg(parts(BLOCK_ROWS).alias("blocks")).join(probed.groupBy("group").agg(parts(QUERY_ROWS).alias("ask_blocks")), "group")
    sizes = F.broadcast(materialise(sizes, "ann-groups"))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vectors = indexed.select("class", "v", "list", group).join(sizes, "group").withColumn("block", dealt("class", "blocks")).withColumn("ask_block", every("ask_blocks")).drop("blocks", "ask_blocks")
    asking = probed.join(sizes, "group").withColumn("ask_block", dealt("query", "ask_blocks")).withColumn("block", every("blocks")).drop("blocks", "ask_blocks")

    def scan(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(own) and len(ask):
            index = held.value
            lists, classes, queries = own["list"].to_numpy(), own["class"].to_numpy(), ask["query"].to_numpy()
            plain = np.stack(own["v"].to_numpy()).astype(np.float64)
            turned = index.augment(plain) @ index.rotation
            q = np.stack(ask["q"].to_numpy()).astype(np.float64)
            turned_q = index.queries(q) @ index.rotation
            bound = ask["bound"].to_numpy()
            wanted = np.concatenate(ask["lists"].to_numpy())
            who = np.repeat(np.arange(len(ask)), [len(x) for x in ask["lists"]])
            for one in np.unique(lists):
                rows, asking = np.flatnonzero(lists == one), who[wanted == one]
                step = max(1, (1 << 20) // len(rows))
                for at in range(0, len(asking), step):
                    some = asking[at : at + step]
                    i, j = scan_list(turned[rows], turned_q[some], bound[some], k + 1)
                    i, j = some[i], rows[j]
                    out.append((queries[i], classes[j], np.einsum("ij,ij->i", q[i], plain[j])))
        query, of, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query": query, "class": of, "score": score})

    block = ("group", "block", "ask_block")
    hits = vectors.groupBy(*block).cogroup(asking.groupBy(*block)).applyInPandas(scan, "query long, class long, score double")
    # The k + 1 best classes of a query class, then the k + 1 best ids of theirs.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    top = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    ids = indexed.select("class", "ids")
    ranked = top.join(ids, "class").select("query", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = ranked.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    answers = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    # Every row of the query class: the answer without itself.
    answers = answers.join(asked.select("query", "v"), "query").select("v", "found", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    everyone = queries.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    found = everyone.join(answers, ["v", "salt"]).select("vec_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("found"))
    out = found.select(F.col("vec_id").alias("query_id"), F.posexplode("found")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))
    return materialise(out, "ann-answers", keep=True)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
