"""Search: BM25, vectors, rank fusion, reranking, node distance, and their composition.

A question is a few terms, so corpus statistics are one aggregate row and every document is scored where it is read:
no postings are shuffled. k1, b and the fusion constant are parameters with the published defaults.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .reads import in_date_range, in_groups, is_current, of_types, with_any_label

if TYPE_CHECKING:
    from .index import WordIndex

K1, B, FUSION, FEW_QUERIES, MAX_QUERIES = 1.2, 0.75, 60, 8, 8192


# The most results of one call, and the most candidates that are looked at for them.
MOST_RESULTS, MOST_CANDIDATES = 100, 1000


def candidate_limit(limit: int, multiplier: int = 3) -> int:
    """Candidates for so many results."""
    if limit not in range(1, MOST_RESULTS + 1):
        raise ValueError(f"{limit} results asked for; a call gives 1 to {MOST_RESULTS}")
    wanted = multiplier * limit
    return wanted if wanted < MOST_CANDIDATES else MOST_CANDIDATES


def question_terms(question: str) -> list[str]:
    import re

    terms = sorted(set(re.findall(r"\w+", question.lower())) - {"_"})
    if not terms:
        raise ValueError("the question is empty")
    return terms


def bm25(docs: DataFrame, id_col: str, text: Column, question: str, *, k1: float = K1, b: float = B) -> DataFrame:
    """docs with score, those that have a term of the question. Two passes over the text: statistics, scores."""
    terms = question_terms(question)
    held = F.array(*[F.lit(t) for t in terms])
    counts = F.transform(held, lambda t: F.size(F.filter("_tokens", lambda x: x == t)))
    # A filter on the counts must not be pushed below them, where it would find the tokens anew for every term: a column that
    # is not deterministic keeps it above.
    own = docs.withColumn("_tokens", tokens(text)).withColumn("_dl", F.size("_tokens")).withColumn("_tf", counts).drop("_tokens").withColumn("_row", F.monotonically_increasing_id())
    stats = own.agg(F.count(F.lit(1)).alias("n"), F.avg("_dl").alias("avgdl"), *[F.count_if(F.col("_tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(F.lit(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        tf = F.col("_tf")[i]
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_dl") / F.lit(stats["avgdl"] or 1.0)))
    some = F.exists("_tf", lambda n: n > 0) & (F.col("_row") >= 0)
    return own.where(some).withColumn("score", F.round(score, 9)).drop("_dl", "_tf", "_row")


def top(scored: DataFrame, limit: int, id_col: str) -> DataFrame:
    """The best by score, ties by id, with their rank from 1. The rank is counted over the limited rows alone."""
    best = scored.orderBy(F.desc("score"), id_col).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def cosine(a: Column, b: Column) -> Column:
    """Of two float arrays, in double precision; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): exact nearest of every query vector. Few queries are one value of a scalar subquery, and each
    row is scored against them where it is read; more are dealt to cells of about MAX_QUERIES, which meet cells of vectors
    (``nearest``). Either way k rows a query and task are shuffled on. The work is queries times vectors."""
    few = queries.select(id_col, vector_col).limit(FEW_QUERIES + 1).collect()
    if len(few) <= FEW_QUERIES:
        return _block_top(vectors, few, k, id_col, vector_col)
    from .nearest import many_top

    found = many_top(vectors, queries, k, id_col, vector_col, -(-queries.count() // MAX_QUERIES)).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "score", "rank")


def _block_top(vectors: DataFrame, asked: list, k: int, id_col: str, vector_col: str) -> DataFrame:
    spark = vectors.sparkSession
    schema = f"query_id {dict(vectors.dtypes)[id_col]}, q {dict(vectors.dtypes)[vector_col]}"
    held = spark.createDataFrame([(r[0], r[1]) for r in asked], schema).agg(F.collect_list(F.struct("query_id", "q")))
    scored = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"), F.explode(held.scalar()).alias("a"))
    scored = scored.where(F.col("_id") != F.col("a.query_id")).select(F.col("a.query_id").alias("query_id"), "_id", F.round(cosine(F.col("_v"), F.col("a.q")), 6).alias("score")).where("score IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("_id", id_col)


def fuse(lists: list[DataFrame], id_col: str, constant: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank): (id, score)."""
    out = None
    for x in lists:
        one = x.select(id_col, (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(id_col).agg(F.round(F.sum("part"), 9).alias("score"))


def passthrough(passages: DataFrame, order: str = "rank") -> DataFrame:
    """(n - i) / n in the given order: the default reranker. For limited candidate lists."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    i = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order)) - 1
    return passages.withColumn("score", F.round((n - i) / n, 9))


def rerank(edges: DataFrame, ranked: DataFrame, *, min_score: float = 0.0, limit: int | None = None) -> DataFrame:
    """edges (uuid, fact, rank) and a ranker's answer (passage, place, score), with passages as often as it had them.
    The n-th answer with a text goes to the n-th edge with it. The ranker's order is kept, not sorted by score; edges
    that it left out follow with score 0, in the order of the first edge of their text; then threshold and limit."""
    nth = lambda by, order: F.row_number().over(Window.partitionBy(by).orderBy(order))
    e = edges.withColumn("_nth", nth("fact", "rank")).withColumn("_first", F.min("rank").over(Window.partitionBy("fact")))
    r = ranked.withColumn("_nth", nth("passage", "place")).select(F.col("passage").alias("fact"), "_nth", "place", "score")
    both = e.drop("score").join(r, ["fact", "_nth"], "left").withColumn("score", F.coalesce("score", F.lit(0.0))).where(F.col("score") >= min_score)
    by = (F.col("place").asc_nulls_last(), F.col("_first"), F.col("rank"))
    kept = both.orderBy(*by).limit(limit) if limit is not None else both
    return kept.withColumn("final_rank", F.row_number().over(Window.orderBy(*by))).drop("_nth", "_first", "place", "rank")


def stats(requested: int, ceiling: int, seen: int, eligible: int, returned: int, hidden: int = 0) -> dict:
    """What a bounded search may have missed: the ceiling reached, even if nothing was cut."""
    return {"requested": requested, "candidate_limit": ceiling, "candidates_seen": seen, "eligible": eligible, "returned": returned, "suppressed": hidden, "recall_may_be_incomplete": seen >= ceiling}


@dataclass(frozen=True)
class Asked:
    """What a search looks for, and among what: keyword only, or hybrid with the question's vector; near a centre; of groups
    (None: all), relation types, labels and dates."""

    question: str
    limit: int = 10
    multiplier: int = 3
    vector: Sequence[float] | None = None
    centre: str | None = None
    groups: list[str] | None = None
    types: list[str] | None = None
    labels: list[str] | None = None
    dates: dict = field(default_factory=dict)
    steps: int = 3  # how far from the centre distances are told

    @property
    def ceiling(self) -> int:
        return candidate_limit(self.limit, self.multiplier)


@dataclass(frozen=True)
class Found:
    """rows in their order by ``place``, and ``stats``, one row: what the search may have missed."""

    rows: DataFrame
    stats: DataFrame


def nearest_to(rows: DataFrame, vector: Sequence[float], vector_col: str, limit: int, id_col: str = "uuid") -> DataFrame:
    """Rows by cosine with one vector, with score and rank; those without a vector are left out."""
    scored = rows.withColumn("score", F.round(cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in vector])), 6)).where("score IS NOT NULL")
    return top(scored, limit, id_col)


def candidates(rows: DataFrame, asked: Asked, text: Column, vector_col: str, edges: DataFrame | None = None, ends: Sequence[str] = ("uuid",), index: WordIndex | None = None) -> DataFrame:
    """The best of rows for the question, up to the ceiling, with rank: by words, from the index if there is one; with a vector, by
    reciprocal ranks of words and cosine; with a centre, those whose ends are nearest to it first."""
    if index is None:
        found = top(bm25(rows, "uuid", text, asked.question), asked.ceiling, "uuid")
    else:  # the ceiling bounds what is sent to all tasks
        hits = index.search(asked.question, asked.ceiling, asked.groups)
        found = top(rows.join(F.broadcast(hits.withColumnRenamed("id", "uuid")), "uuid"), asked.ceiling, "uuid")
    if asked.vector is not None:
        near = nearest_to(rows, asked.vector, vector_col, asked.ceiling)
        fused = top(fuse([found, near], "uuid"), asked.ceiling, "uuid")
        found = rows.join(fused, "uuid")
    if asked.centre is not None:
        if edges is None:
            raise ValueError("a centre needs edges")
        from ..sources.store import written

        found = written(found, "candidates")  # read for its ends, and for the rows
        nodes = functools.reduce(DataFrame.union, [found.select(F.col(end).alias("uuid")) for end in ends])
        away = distance_to(edges, asked.centre, nodes, asked.steps)
        for i, end in enumerate(ends):
            found = found.join(away.select(F.col("uuid").alias(end), F.col("distance").alias(f"_d{i}")), end, "left")
        distance = F.coalesce(F.least(*[F.col(f"_d{i}") for i in range(len(ends))], F.lit(asked.steps + 1)), F.lit(asked.steps + 1))
        found = found.withColumn("distance", distance).drop(*[f"_d{i}" for i in range(len(ends))])
        found = found.withColumn("rank", F.row_number().over(Window.orderBy("distance", "rank")))  # the ceiling bounds these rows
    return found


def _stats(asked: Asked, seen: DataFrame, eligible: Column, returned: DataFrame) -> DataFrame:
    row = seen.agg(F.count(F.lit(1)).alias("candidates_seen"), F.count_if(eligible).alias("eligible"))
    given = returned.agg(F.count(F.lit(1)).alias("n")).scalar()
    return row.select(
        F.lit(asked.limit).alias("requested"), F.lit(asked.ceiling).alias("candidate_limit"), "candidates_seen", "eligible", given.alias("returned"),
        (F.col("candidates_seen") - F.col("eligible")).alias("suppressed"), (F.col("candidates_seen") >= asked.ceiling).alias("recall_may_be_incomplete"),
    )


def find_facts(facts: DataFrame, asked: Asked, now: Column, *, edges: DataFrame | None = None, min_score: float = 0.0, include_invalidated: bool = False, ranker: Callable[[DataFrame], DataFrame] | None = None, index: WordIndex | None = None) -> Found:
    """The composite search of facts: filters, then candidates up to the ceiling, only then what holds now, then the ranker's
    answer (passage, place, score) by n-th text, its threshold and the limit. ``ranker`` maps candidates (fact, rank) to that
    answer; by default they keep their order. ``index`` is one of the facts' names and texts; filters by type or date, whose
    statistics an index does not have, scan."""
    index = None if asked.types or asked.dates else index
    pool = in_date_range(of_types(in_groups(facts, asked.groups), asked.types or []), **asked.dates)
    seen = candidates(pool, asked, F.concat_ws(" ", "name", "fact"), "fact_embedding", facts if edges is None else edges, ("source_node_uuid", "target_node_uuid"), index)
    eligible = F.lit(True) if include_invalidated else is_current(now)
    current = seen.where(eligible).drop("score")
    if ranker is None:
        order = F.row_number().over(Window.orderBy("rank"))
        rows = passthrough(current).where(F.col("score") >= min_score).orderBy("rank").limit(asked.limit).withColumn("place", order).drop("rank")
    else:
        rows = rerank(current, ranker(current), min_score=min_score, limit=asked.limit).withColumnRenamed("final_rank", "place")
    return Found(rows, _stats(asked, seen, eligible, rows))


def find_nodes(nodes: DataFrame, asked: Asked, *, edges: DataFrame | None = None, index: WordIndex | None = None) -> Found:
    """The search of nodes by name and summary, of any of the labels. Nodes have no dates, so all that is seen is eligible.
    ``index`` is one of the nodes' names and summaries; a filter by labels scans."""
    pool = with_any_label(in_groups(nodes, asked.groups), asked.labels or [])
    seen = candidates(pool, asked, F.concat_ws(" ", "name", "summary"), "name_embedding", edges, index=None if asked.labels else index)
    rows = seen.orderBy("rank").limit(asked.limit).withColumnRenamed("rank", "place")
    return Found(rows, _stats(asked, seen, F.lit(True), rows))


def search_facts(facts: DataFrame, question: str, now: Column, *, limit: int = 10, multiplier: int = 3, min_score: float = 0.0, include_invalidated: bool = False) -> DataFrame:
    """Facts that hold now, found by words."""
    return find_facts(facts, Asked(question, limit, multiplier), now, min_score=min_score, include_invalidated=include_invalidated).rows


def search_report(facts: DataFrame, question: str, now: Column, *, limit: int = 10, multiplier: int = 3) -> DataFrame:
    """One row: what search_facts saw, left out and may have missed."""
    return find_facts(facts, Asked(question, limit, multiplier), now).stats


def split_by_currency(ranked: DataFrame, now: Column, limit: int, order: str = "rank") -> DataFrame:
    """Ranked facts as two lists, what holds now and what was replaced, each cut to the limit: ``current`` and ``place`` in its list."""
    own = ranked.withColumn("current", is_current(now))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("current").orderBy(order))).where(F.col("place") <= limit)


# A frontier of so many rows at most is sent to all tasks, a larger one is joined by node and salt.
SENT_FRONTIER, HUB_SALTS = 100_000, 16


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("source_node_uuid").alias("a"), F.col("target_node_uuid").alias("b")), F.struct(F.col("target_node_uuid").alias("a"), F.col("source_node_uuid").alias("b")))
    return edges.select(F.inline(ends)).where("a IS NOT NULL AND b IS NOT NULL")


def _next(ways: DataFrame, frontier: DataFrame, n: int, reached: DataFrame, distance: int) -> DataFrame:
    """The nodes next to a frontier (of, uuid; n rows) that are not reached yet, written. A hub's edges are dealt over salts where the
    frontier is not sent to all tasks."""
    from ..sources.store import written

    own = frontier.select("of", F.col("uuid").alias("a"))
    if n <= SENT_FRONTIER:
        met = ways.join(F.broadcast(own), "a")
    else:
        salted = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(HUB_SALTS - 1))))
        met = ways.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(HUB_SALTS)).cast("int")).join(salted, ["a", "_salt"])
    found = met.select("of", F.col("b").alias("uuid")).distinct().join(reached.select("of", "uuid"), ["of", "uuid"], "left_anti")
    return written(found.withColumn("distance", F.lit(distance)), "frontier")


def _start(nodes: DataFrame, of: Column) -> DataFrame:
    return nodes.select(of.alias("of"), "uuid", F.lit(0).alias("distance"))


def node_distance(edges: DataFrame, centre: str, most: int = 3) -> DataFrame:
    """(uuid, distance) of nodes within ``most`` steps of a centre, edges taken both ways: breadth first, each frontier written once,
    so that no step's plan holds those before it."""
    ways = _both_ways(edges)
    frontier = reached = _start(edges.sparkSession.createDataFrame([(centre,)], "uuid string"), F.lit(""))
    n = 1
    for step in range(1, most + 1):
        frontier = _next(ways, frontier, n, reached, step)
        reached, n = reached.unionByName(frontier), frontier.count()
        if n == 0:
            break
    return reached.select("uuid", "distance")


def distance_to(edges: DataFrame, centre: str, targets: DataFrame, most: int = 3) -> DataFrame:
    """(uuid, distance) of those of the targets (uuid; a bounded list, as of candidates) that are within ``most`` steps of a centre, edges taken
    both ways. Breadth first from both ends, always on from the smaller frontier; a path of at most ``most`` steps has a
    node that both ends have reached, so what a hub has around it need not be walked to the end."""
    ways = _both_ways(edges)
    spark = edges.sparkSession
    ends = [_start(spark.createDataFrame([(centre,)], "uuid string"), F.lit("")), _start(targets.select("uuid").where("uuid IS NOT NULL").distinct(), F.col("uuid"))]
    frontier, reached, sizes, depth = list(ends), list(ends), [1, ends[1].count()], [0, 0]
    for _ in range(most):
        side = 0 if sizes[0] <= sizes[1] else 1
        if sizes[side] == 0:  # this end has nothing new to reach, so it has all that it can
            break
        depth[side] += 1
        frontier[side] = _next(ways, frontier[side], sizes[side], reached[side], depth[side])
        reached[side], sizes[side] = reached[side].unionByName(frontier[side]), frontier[side].count()
    far = reached[1].withColumnRenamed("distance", "_far")
    met = reached[0].select("uuid", F.col("distance").alias("_near")).join(far, "uuid")
    return met.groupBy(F.col("of").alias("uuid")).agg(F.min(F.col("_near") + F.col("_far")).alias("distance"))
