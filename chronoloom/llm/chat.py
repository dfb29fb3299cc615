"""Chat formatting of preference pairs, in DataFrame operations alone.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text, null equal to
null, at equal places in turn order) is rendered once, as the prompt; what follows on each side is rendered as its
completion. Equal conversations, and one that
begins the other, leave an empty completion, which is kept as such.

A turn renders as ``<|im_start|>role\\ncontent<|im_end|>\\n``; ``<|`` within roles or contents is written ``< |``, so that no
text can forge a turn. The loss mask of a completion is the list of its trained spans [start, end) in code points: the content
and closing ``<|im_end|>`` of every assistant turn. Prompts are masked throughout.

Conversations 2k and 2k + 1 are pair k: the former was chosen, the latter rejected. One shuffle by pair
brings the turns of both together; within a pair everything is array expressions.

Defined results. A null role or text renders as an empty one. Turns with a null conversation id take no part. Turns are ordered by
turn (null first), then role, then text, so repeated turns stay, in a fixed order. A pair with one side only has
complete = false, its whole conversation as that side's completion and an empty other side. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _plain(t["role"]), F.lit("\n"))


def _body(t: Column) -> Column:
    return F.concat(_plain(t["text"]), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def trained_spans(turns: Column) -> Column:
    """Array of (start, end) of what is trained in render(turns)."""
    at = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        more = F.when(t["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + 1).alias("at"), F.concat(a["spans"], more).alias("spans"))

    return F.aggregate(turns, at, add, lambda a: a["spans"])


def format_pairs(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """turns (turn, role, text), with the pair each belongs to and whether on its chosen side ->
    (pair_id, complete, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans)."""
    t = turns.select(pair.alias("pair_id"), F.struct("turn", "role", "text").alias("t"), chosen.alias("c")).where("pair_id IS NOT NULL")
    sides = t.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("c"), F.col("t")))).alias("a"), F.sort_array(F.collect_list(F.when(~F.col("c"), F.col("t")))).alias("b"))
    a, b = F.col("a"), F.col("b")
    least = F.least(F.size("a"), F.size("b"))
    differs = F.filter(F.sequence(F.lit(0), least), lambda i: (i == least) | ~(F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"])))
    sides = sides.withColumn("n", differs[0])
    tail = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    sides = sides.select("pair_id", "n", ((F.size("a") > 0) & (F.size("b") > 0)).alias("complete"), F.slice(a, 1, F.col("n")).alias("p"), tail(a).alias("a"), tail(b).alias("b"))
    return sides.select("pair_id", "complete", F.col("n").cast("long").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"), render(a).alias("chosen"), render(b).alias("rejected"), trained_spans(a).alias("chosen_spans"), trained_spans(b).alias("rejected_spans"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    pairs = format_pairs(table(spark, sf_dir, "conversations"), F.floor(c / 2), F.pmod(c, F.lit(2)) == 0)
    return pairs.withColumn("chosen_spans", _text(F.col("chosen_spans"))).withColumn("rejected_spans", _text(F.col("rejected_spans")))


OP8_SQL = """
WITH t AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, conv_id % 2 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS i,
         '<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) AS head,
         replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' AS body
  FROM conversations WHERE conv_id IS NOT NULL),
pairs AS (
  SELECT pair_id, count(DISTINCT side) = 2 AS complete,
         least(coalesce(max(i) FILTER (WHERE side = 0), -1), coalesce(max(i) FILTER (WHERE side = 1), -1)) + 1 AS least_n
  FROM t GROUP BY pair_id),
differ AS (
  SELECT a.pair_id, min(a.i) AS n FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
  WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY a.pair_id),
prefix AS (SELECT pair_id, complete, coalesce(n, least_n) AS n FROM pairs LEFT JOIN differ USING (pair_id)),
placed AS (
  SELECT t.*, p.n,
         coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY t.pair_id, side, i >= p.n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM t JOIN prefix p ON t.pair_id = p.pair_id),
parts AS (
  SELECT pair_id,
         string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE side = 0 AND i < n) AS prompt,
         string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE side = 0 AND i >= n) AS chosen,
         string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE side = 1 AND i >= n) AS rejected,
         string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(body) AS BIGINT), ',' ORDER BY i) FILTER (WHERE side = 0 AND i >= n AND role = 'assistant') AS chosen_spans,
         string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(body) AS BIGINT), ',' ORDER BY i) FILTER (WHERE side = 1 AND i >= n AND role = 'assistant') AS rejected_spans
  FROM placed GROUP BY pair_id)
SELECT pair_id, complete, n AS n_prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
       coalesce(chosen_spans, '') AS chosen_spans, coalesce(rejected_spans, '') AS rejected_spans
FROM prefix JOIN parts USING (pair_id)
"""
