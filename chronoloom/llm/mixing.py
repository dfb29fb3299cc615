"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations alone.

Every document of a source is queued in a shuffled order (by a seeded md5 of its id and text), then all of them once more: a
document may be taken twice at most. An entry's *virtual finish time* is the number of words its source has queued up to
and including it, divided by the source's target. All entries are then put in order of finish time over all sources, and
the order is cut where the budget, a whole number of words, is used up. A source that is served at its target's pace finishes its target at time
1, so each source's share comes near its target, to within a document or so.

No task holds a source: running sums are taken in two levels (ranges of the shuffle order within each source, then
inside one range), and so is the cut (ranges of the finish time, then inside the one range where the budget ends). There are
4096 ranges, 16 times as many for every 16-fold of partitions beyond that. Rows alike in source, id and text share a place in the
shuffle order; they are counted in 64 lanes, so a window has at most 64 rows for them, however many there are. Only tables with a row a source go through one task.

Defined results. A null text has size 0; a document of size 0 is never taken. A null source is a source of its own, the
last. A null id is shuffled as the text "null", so rows without one are told apart by their texts. Repeated rows are separate entries. An empty table gives an empty result.
Only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, input_partitions, keyed, materialise, shielded, table, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_COPIES = 2
SEED = "mix-1"
DIGITS = 3  # hexadecimal, of the number of ranges: of the shuffle order, and of the finish time from 0 to 1
LANES = 64  # that rows alike are dealt to
LAST_TIME = 4  # where ranges of the finish time end


def targets(per_source: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> also (weight, target): each source's share of ``budget`` times all sizes by weight,
    stopped at ``most`` times its size, the excess reshared by weight.

    That is water filling. With sources in order of limit / weight, the water level is found from running sums: while
    the first j sources are at their limit, the level is (budget - their limits) / (the other sources' weights).
    The windows have one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = per_source.withColumn("weight", w).withColumn("most", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    full = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(1))
    level = ranked.withColumn("level", (F.lit(float(budget)) * F.sum("source_size").over(everything) - full) / rest)
    level = level.withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.coalesce("water", F.lit(0.0)))
    return level.select("source", "source_size", "weight", target.alias("target"))


def _key(source: Column) -> Column:
    """A source as a key without nulls."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES, seed: str = SEED, row_col: str | None = None) -> DataFrame:
    """Per document: (doc_id, source, size, source_size, target, taken), and row_col, if given."""
    with Scratch(docs.sparkSession):
        row = [row_col] if row_col else []
        size = word_count(F.col(text_col)) if size is None else size
        draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
        lane = F.monotonically_increasing_id() % LANES
        sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), draw.alias("draw"), lane.alias("lane"), *row)
        sized = materialise(sized.withColumn("key", _key(F.col("source"))), "mix-sizes")
        return _mix(sized, row, weights, budget, most)


def _mix(sized: DataFrame, row: list[str], weights, budget: float, most: int) -> DataFrame:
    digits = max(DIGITS, math.ceil(math.log(input_partitions(sized), 16)))
    n_ranges = 16**digits
    sized = sized.withColumn("range", F.substring("draw", 1, digits))
    ranges = sized.groupBy("key", "range").agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
    per_source = ranges.groupBy("key").agg(F.sum("range_size").alias("source_size"), F.first("source").alias("source"))
    goal = targets(per_source.select("source", "source_size"), weights, budget, most)
    goal = goal.select(_key(F.col("source")).alias("key"), "source_size", "target")
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("key", "range", before.alias("before")).join(goal, "key")

    # Rows alike in id and text share a draw, and so a range: a window has one row for all of them in a lane.
    alike = ["key", "range", "draw", "doc_id", "size", "lane"]
    lanes = sized.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source"), *[F.min(c).alias(c) for c in row])
    inside = Window.partitionBy("key", "range").orderBy("draw", "doc_id", "size", "lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.join(ranges, ["key", "range"]).withColumn("first", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    if row:
        lanes = materialise(lanes, "mix-lanes")
        queued = lanes.where("n = 1").withColumn("nth", F.lit(1)).unionByName(_each(sized, lanes.where("n > 1"), alike, row))
    else:
        queued = lanes.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n"))))
    queued = queued.withColumn("queued", F.col("first") + F.col("nth") * F.col("size"))
    queued = materialise(queued.select("doc_id", "source", "size", "source_size", "target", "key", "draw", "queued", *row), "mix-queue", keep=True)

    can = (F.col("size") > 0) & (F.col("target") > 0)
    times = [F.when(can, (F.lit(k) * F.col("source_size") + F.col("queued")) / F.col("target")) for k in range(most)]
    span = lambda t: F.least(F.floor(t * n_ranges), F.lit(LAST_TIME * n_ranges)).cast("long")
    entries = queued.select("doc_id", "size", "target", "key", "draw", F.posexplode(F.array(*times)).alias("copy", "time")).where("time IS NOT NULL").withColumn("span", span(F.col("time")))

    # One row each comes to the driver: the budget, the range of finish times where it ends, and the last entry taken.
    words = goal.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    total = min(math.floor(Fraction(str(budget)) * words), most * words)  # what the targets add up to, without their rounding
    upto = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = entries.groupBy("span").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(upto))
    cut = spans.where(F.col("upto") > F.lit(total)).orderBy("span").limit(1).select("span", (F.col("upto") - F.col("n")).alias("used")).first()
    order = ("time", "key", "draw", "doc_id", "copy")
    if cut is None:
        taken = [F.when(t.isNotNull(), F.col("size")).otherwise(0) for t in times]
    else:
        at = Window.partitionBy("span").orderBy(*order, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = entries.where(F.col("span") == cut["span"]).withColumn("upto", F.lit(cut["used"]) + F.sum("size").over(at))
        last = edge.where(F.col("upto") <= F.lit(total)).select(F.max(F.struct(*order)).alias("last")).first()["last"]
        taken = []
        for k, t in enumerate(times):
            in_range = F.lit(False)
            if last is not None:
                entry = F.struct(t.alias("time"), F.col("key"), F.col("draw"), F.col("doc_id"), F.lit(k).alias("copy"))
                in_range = entry <= F.struct(*[F.lit(last[c]).cast(dict(entries.dtypes)[c]).alias(c) for c in order])
            taken.append(F.when(t.isNotNull() & ((span(t) < cut["span"]) | ((span(t) == cut["span"]) & in_range)), F.col("size")).otherwise(0))
    return queued.select("doc_id", "source", "size", "source_size", "target", sum(taken[1:], taken[0]).cast("long").alias("taken"), *row)


def _each(sized: DataFrame, lanes: DataFrame, alike: list[str], row: list[str]) -> DataFrame:
    """The rows of lanes that have several, with their number in the lane. A sort-merge join at every size."""
    s, n = sized.select(*alike, *row).alias("s"), lanes.drop(*row).hint("merge").alias("n")
    both = s.join(n, reduce(Column.__and__, [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in alike])).select("n.*", *[f"s.{c}" for c in row])
    return both.withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy(*row)))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: every row as many times as it is taken, in the columns of docs. Rows are told apart by a key of the
    stage's own, so rows without an id, or that share one, are each taken as often as the mix says."""
    docs, named = shielded(docs, "doc_id", "text", "source")
    docs = keyed(docs, "mix-rows", keep=True)
    taken = mix(docs.select("_row", "doc_id", "text", "source"), row_col="_row").where("taken > 0").select("_row", (F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    # A sort-merge join at every size: what is taken grows with the rows.
    return named(docs.join(taken.hint("merge"), "_row").withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, 2 * source_size AS most,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM per_source),
leveled AS (
  SELECT *, most / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
goal AS (
  SELECT source, source_size,
         least(CAST(most AS DOUBLE), weight * coalesce((SELECT max(level) FROM leveled WHERE level <= ratio), 0)) AS target
  FROM leveled),
queued AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, s.draw,
         coalesce('=' || s.source, 'null') AS key,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS queued
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
entries AS (
  SELECT *, (k * source_size + queued) / target AS finish FROM queued, (VALUES (0), (1)) AS c(k) WHERE size > 0 AND target > 0),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, key, draw, doc_id, k, size ROWS UNBOUNDED PRECEDING) AS upto FROM entries),
picked AS (
  SELECT doc_id, draw, queued, key, sum(size) AS taken FROM ordered WHERE upto <= (SELECT least(floor(1.5 * sum(source_size)), 2 * sum(source_size)) FROM goal) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, round(q.target, 6) AS target, CAST(coalesce(p.taken, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN picked p ON p.doc_id IS NOT DISTINCT FROM q.doc_id AND p.key = q.key AND p.queued = q.queued AND q.size > 0
"""
