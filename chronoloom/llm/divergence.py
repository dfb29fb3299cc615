"""Source divergence audit: how far the term distribution of each source of a language is from those of its other sources, and
which terms set it apart from the language, by systolic rotation.

*Counts.* Tasks count terms exactly (a dictionary of each slice of texts, never a hash) per (language, source), with the number of
documents that have them, and add up before the shuffle. A language keeps the terms that at least ``LEAST_DOCS`` of its
documents have.

*Shards.* A language's kept terms are dealt out to shards of about ``SHARD`` terms, and numbered within a shard in order of their
UTF-8 bytes. A source's vector in a shard is what its terms there count, packed; no task or row holds more of a vector, however
hot the source. What is summed over terms is summed over shards.

*Rotation.* The sources of a language are seated in cells, one to a cell up to ``CELLS``, then more to a cell, ``MOST`` at the most. A
cell's vectors are resident: a task holds them, as dense counts, while the vectors of the other cells come past in the order of a
round-robin tournament: in round r the cells i and j meet with i + j = r (modulo the odd number of seats), each pair
of cells once, in one of the two, such that each cell is host of half its meetings. A meeting evaluates both directions. Rounds are an
order of rows within a task, not jobs, so a lost executor costs its tasks alone; a vector travels to half of the cells.

*Terms.* The language's own vector comes past first: each shard's heap of a resident's ``TOP`` terms is what the last ranking reads.

All arithmetic is of integers: shares by long division, since a count times 10^9 need not fit 64 bits. A sum of divergences fits while a
language keeps fewer than 2 * 10^9 terms, a count while a language has fewer than 9 * 10^15 occurrences.

Defined results. Null languages, sources and texts are read as ''. A source without terms has zero counts of every kept term; a language
with no kept term has values of 0 for its pairs and no terms. A language's only source has no pairs. Repeated rows count each, as do
rows without an id. Columns other than text, lang and source are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, input_partitions, map_arrow, materialise, slices, table
from .ngram_join import pack, unpack
from .terms import LETTERS, coded

LEAST_DOCS, TOP, UNIT = 3, 200, 10**9
SHARD, CELLS, MOST, SLICE = 1 << 16, 64, 128, 1 << 23


def shares(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + kept)), by long division in steps of three digits."""
    whole, rest = np.zeros(len(count), np.int64), count.astype(np.int64) + 1
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // (total + kept), rest % (total + kept)
    return 1 + whole


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in a group; term '' stands for the group itself."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                codes, at, terms = coded(part.column("text"), LETTERS)
                names = [part.column(c).fill_null("").dictionary_encode() for c in ("lang", "source")]
                lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in names)
                groups, own = np.unique(lang * len(names[1].dictionary) + source, return_inverse=True)
                width = max(1, len(terms))
                seen, n = np.unique(np.repeat(np.arange(len(own)), np.diff(at)) * width + codes, return_counts=True)
                key, place = np.unique(own[seen // width] * width + seen % width, return_inverse=True)
                total, docs_of = np.zeros(len(key), np.int64), np.bincount(place, minlength=len(key))
                np.add.at(total, place, n)
                group = np.concatenate([key // width, np.arange(len(groups))])
                none = np.zeros(len(groups), np.int64)
                where = divmod(groups[group], len(names[1].dictionary))
                columns = [x.dictionary.cast(pa.string()).take(pa.array(i)) for x, i in zip(names, where, strict=True)]
                columns += [pa.concat_arrays([terms.take(pa.array(key % width)).cast(pa.string()), pa.array([""] * len(groups), pa.string())])]
                columns += [pa.array(np.concatenate([total, none])), pa.array(np.concatenate([docs_of, none]))]
                yield pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])

    rows = map_arrow(docs, run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _packed(vectors: DataFrame) -> DataFrame:
    """vectors (lang, shard, source, v: idx and n by idx) with v as two packed columns."""

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            at, inner = v.offsets.to_numpy(), v.flatten()
            at = at - at[0]
            idx, n = (inner.field(c).to_numpy() for c in ("idx", "n"))
            runs = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            columns = [batch.column(c) for c in ("lang", "shard", "source")]
            columns += [pa.array([pack(idx[a:z].astype(np.uint32), gaps=True) for a, z in runs], pa.binary()), pa.array([pack(n[a:z].astype(np.int64)) for a, z in runs], pa.binary())]
            yield pa.record_batch(columns, names=["lang", "shard", "source", "idx", "counts"])

    return map_arrow(vectors, run, "lang string, shard long, source string, idx binary, counts binary")


class Vector:
    """A group's counts and shares of a shard's terms."""

    def __init__(self, row: dict, width: int):
        self.source, self.count = row["source"], np.zeros(width, np.int64)
        if row["idx"] is not None:
            self.count[unpack(row["idx"], "u4", gaps=True).astype(np.int64)] = unpack(row["counts"], "i8")
        self.none = 0
        if row["kept"]:
            both = shares(np.append(self.count, 0), row["total"], row["kept"])
            self.share, self.none = both[:-1], int(both[-1])  # none: the share of a term that the group lacks
        self.has = self.count > 0


def meeting(a: Vector, b: Vector) -> tuple[int, int]:
    """The divergence of a from b, and of b from a, over a shard's terms."""
    if not a.none or not len(a.count):
        return 0, 0
    either = np.flatnonzero(a.has | b.has)
    p, q = a.share[either], b.share[either]
    square, neither, apart = (p - q) * (p - q), len(a.count) - len(either), (a.none - b.none) ** 2
    return int((square // q).sum()) + neither * (apart // b.none), int((square // p).sum()) + neither * (apart // a.none)


def top_terms(own: Vector, lang: Vector, top: int) -> list[tuple[int, int]]:
    """(value, idx) of the terms that the group has and holds a larger share of than the language: the largest, then the first."""
    more = np.flatnonzero(own.has)
    more = more[own.share[more] > lang.share[more]] if len(more) else more
    if not len(more):
        return []
    p, q = own.share[more], lang.share[more]
    value = (p - q) * (p - q) // q
    return heapq.nsmallest(top, zip((-value).tolist(), more.tolist(), strict=True))


_RESULT = {"lang": pa.string(), "shard": pa.int64(), "source": pa.string(), "item": pa.string(), "idx": pa.int64(), "value": pa.int64()}


def rotate(rows: DataFrame, parts: int, top: int) -> DataFrame:
    """rows (lang, shard, cell, round, source, width, total, kept, idx, counts) -> (lang, shard, source, item, idx, value): item of
    pairs, idx of terms. In a cell come the language (round -2), the residents (-1), then the visitors by round."""

    def run(batches):
        at, lang, residents = None, None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if at != (here := (row["lang"], row["shard"], row["cell"])):
                    at, lang, residents = here, None, []
                own = Vector(row, row["width"])
                for other in residents if row["round"] >= -1 else ():
                    ab, ba = meeting(own, other)
                    out += [(*at[:2], own.source, other.source, None, ab), (*at[:2], other.source, own.source, None, ba)]
                if row["round"] == -2:
                    lang = own
                elif row["round"] == -1:
                    residents.append(own)
                    if lang.none:
                        out += [(*at[:2], own.source, None, idx, -value) for value, idx in top_terms(own, lang, top)]
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _RESULT.values(), strict=True)], names=list(_RESULT))

    dealt = rows.repartition(parts, "lang", "shard", "cell").sortWithinPartitions("lang", "shard", "cell", "round", "source")
    return map_arrow(dealt, run, "lang string, shard long, source string, item string, idx long, value long")


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", top: int = TOP, least_docs: int = LEAST_DOCS, shard: int = SHARD, cells: int = CELLS, most: int = MOST) -> DataFrame:
    """(lang, source, part, item, value, rank): of every source of a language its divergences from the other ones, and its terms."""
    spark = docs.sparkSession
    docs = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    parts = max(8, input_partitions(docs))
    with Scratch(spark):
        counts = materialise(count_terms(docs), "audit-counts")
        of_term = Window.partitionBy("lang", "term")
        kept = counts.where("term <> ''").select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("lang_docs"), F.sum("n").over(of_term).alias("lang_n"), F.row_number().over(of_term.orderBy("source")).alias("nth"))
        kept = materialise(kept.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", (F.col("nth") == 1).alias("first")), "audit-kept")

        own = counts.where("term = ''").select("lang", "source")
        langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("kept"), F.sum("n").alias("total"))
        cell_count = F.greatest(F.least(F.col("sources"), F.lit(cells)), F.ceil(F.col("sources") / most)).cast("long")
        langs = own.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(langs, "lang", "left").na.fill(0, ["kept", "total"])
        langs = materialise(langs.select("lang", "kept", "total", cell_count.alias("cells"), F.greatest(F.ceil(F.col("kept") / shard), F.lit(1)).cast("long").alias("shards")), "audit-langs")

        # Terms by shard and number; the language's own vector has a null source.
        dealt = kept.join(langs.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
        numbered = dealt.withColumn("idx", F.dense_rank().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1).select("lang", "shard", "idx", "term", "source", "n", "lang_n", "first")
        numbered = materialise(numbered, "audit-terms")
        entry = lambda source, n: F.struct(source.alias("source"), F.col(n).alias("n"))
        one, both = F.array(entry(F.col("source"), "n")), F.array(entry(F.col("source"), "n"), entry(F.lit(None).cast("string"), "lang_n"))
        entries = numbered.select("lang", "shard", "idx", F.explode(F.when(F.col("first"), both).otherwise(one)).alias("e"))
        vectors = entries.groupBy("lang", "shard", F.col("e.source").alias("source")).agg(F.sort_array(F.collect_list(F.struct("idx", F.col("e.n").alias("n")))).alias("v"))
        vectors = materialise(_packed(vectors), "audit-vectors")

        # Every group in every shard of its language, also where it has no term; seats in the order of names.
        seat = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = own.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).withColumn("seat", seat).join(langs.drop("total"), "lang").withColumn("cell", F.col("seat") % F.col("cells"))
        whole = langs.select("lang", F.lit(None).cast("string").alias("source"), "total", "kept", "cells", "shards", F.lit(-1).cast("long").alias("cell"))
        seated = whole.union(groups.select(whole.columns)).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        width = numbered.groupBy("lang", "shard").agg((F.max("idx") + 1).alias("width"))
        v = vectors.select("lang", "shard", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "idx", "counts")
        seated = seated.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).join(v, ["lang", "shard", "key"], "left").join(width, ["lang", "shard"], "left").na.fill(0, ["width"])

        odd = F.col("cells") + (F.col("cells") + 1) % 2
        hosts = F.when(odd > 1, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest((odd - 1) / 2, F.lit(1)).cast("long")), lambda d: F.pmod(F.col("cell") - d, odd)))
        calls = F.transform(F.filter(F.coalesce(hosts, F.array().cast("array<bigint>")), lambda h: h < F.col("cells")), lambda h: F.struct(h.alias("cell"), F.pmod(h + F.col("cell"), odd).alias("round")))
        home = F.array(F.struct(F.col("cell").alias("cell"), F.lit(-1).cast("long").alias("round")))
        everywhere = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1), lambda c: F.struct(c.alias("cell"), F.lit(-2).cast("long").alias("round")))
        met = F.when(F.col("source").isNull(), everywhere).otherwise(F.concat(home, calls))
        rows = seated.select("lang", "shard", F.explode(met).alias("at"), "source", "width", "total", "kept", "idx", "counts").select("lang", "shard", "at.cell", "at.round", "source", "width", "total", "kept", "idx", "counts")
        found = materialise(rotate(rows, parts, top), "audit-meetings")

        pairs = found.where("idx IS NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        names = numbered.where("first").select("lang", "shard", "idx", "term")
        terms = found.where("idx IS NOT NULL").drop("item").join(names, ["lang", "shard", "idx"]).select("lang", "source", F.col("term").alias("item"), "value")
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        out = [df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", pairs), ("term", terms))]
        return materialise(out[0].union(out[1].where(F.col("rank") <= top)), "audit", keep=True)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
word AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
own AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM word GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM own GROUP BY ALL HAVING sum(docs) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT g.lang, g.source, coalesce(sum(o.n), 0)::HUGEINT AS total FROM groups g LEFT JOIN (own o SEMI JOIN kept k ON o.lang = k.lang AND o.term = k.term) ON o.lang = g.lang AND o.source = g.source GROUP BY ALL),
q AS (SELECT k.lang, k.term, 1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS q FROM kept k JOIN langs l USING (lang)),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(o.n, 0) AS n, 1 + (1000000000 * (coalesce(o.n, 0)::HUGEINT + 1)) // (t.total + l.v) AS p
  FROM totals t JOIN langs l USING (lang) JOIN kept k ON k.lang = t.lang LEFT JOIN own o ON o.lang = t.lang AND o.source = t.source AND o.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
