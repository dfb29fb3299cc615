"""Quality rules whose cutoffs are chosen under a stated risk, in DataFrame operations alone.

*Base measures* are taken from whole texts (word and symbol counts, repeated lines, repeated 5-word windows) and two
fixed base rules reject documents of few or repeated words.

*Rules* compare a measure with a cutoff from a grid that runs from lenient to strict. All rules tighten together: level
k uses the k-th cutoff of every rule, so that a document has one number, the first level that rejects it.

*Cutoffs are chosen by risk control.* The labelled good documents of a stratum (its language) are the holdout: no rule is
fitted to them. If level k rejects x of the n good ones, the hypothesis "level k rejects more than ``risk`` of the good
documents" is refuted when the exact binomial probability P[Bin(n, risk) <= x] is at most ``error`` / strata. This is the
exact (Clopper-Pearson) upper bound on the false-rejection rate, read the other way round. Levels are tested from
lenient to strict and testing stops at the first that is not refuted (fixed-sequence testing, which needs no further
correction within a stratum), and dividing ``error`` by the number of strata (Bonferroni) corrects across strata. So with
probability 1 - ``error``, no stratum loses more than ``risk`` of its good documents to the rules. A stratum
with too few labels to refute anything keeps all that the base rules keep.

Strata are the ``MAX_STRATA`` languages with most labelled good documents, every other language (and null) falls into a
pooled stratum; so the table of cutoffs has at most ``MAX_STRATA`` + 1 rows, and only this table is broadcast.

Defined results. A null or empty text has no words, and so fails the base rules. Labels of a repeated doc_id count once,
at their lowest quality. A document without an id has no label. Columns named as the
measures are replaced in with_measures; a stage passes all columns through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shielded, table

RISK, ERROR, MAX_STRATA, POOLED = 0.05, 0.05, 4096, "(other)"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: Cutoffs from lenient to strict; a level rejects a document whose measure is above the cutoff.
GRIDS = {
    "symbol_ratio": (0.5, 0.3, 0.2, 0.15, 0.1, 0.05, 0.03, 0.02),
    "upper_ratio": (0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4),
    "exclaim_ratio": (4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5),
    "dup_line_ratio": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6),
    "word_length": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0),
}
LEVELS = 8
_SPACE = r"[\x20\x09-\x0D]"


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and reject_level.

    One pass over the text. A 5-word window is known by a 64-bit hash within its document; positions are looked at only
    in documents where two windows agree."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "reject_level", "_row")
    inner = ("_words", "_lines", "_windows", "_sorted", "_length", "_upper", "_exclaim", "_rules")
    d = docs.select(
        "*",
        F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("_words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.length(t).alias("_length"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[A-Z]+", ""))).cast("long").alias("_upper"),
        (F.length(t) - F.length(F.regexp_replace(t, r"!+", ""))).cast("long").alias("_exclaim"),
    )
    w, n = F.col("_words"), F.size("_words")
    d = d.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))).alias("_windows"),
    )
    s = F.col("_sorted")
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull()
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        F.sort_array(twice), start, lambda a, i: F.struct((a["n"] + (i + WINDOW) - F.greatest(i, a["end"])).cast("long").alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"]
    )
    d = d.withColumn("n_repeat_words", F.when(s.isNull(), F.lit(0).cast("long")).otherwise(covered))
    # Filters on the verdict must not be pushed below this point: with the arrays written out in place of their names,
    # they would be built anew for every element. A column that is not deterministic keeps them above.
    d = d.withColumn("_row", F.monotonically_increasing_id())
    base = (F.col("_row") < 0) | (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    d = d.withColumn("base_failed", base)
    chars, words = F.greatest("word_chars", F.lit(1)).cast("double"), F.greatest("n_words", F.lit(1)).cast("double")
    values = {
        "symbol_ratio": F.col("n_symbols") / chars,
        "upper_ratio": F.col("_upper") / chars,
        "exclaim_ratio": F.col("_exclaim") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)).cast("double"),
        "word_length": F.col("word_chars") / words,
    }
    level = F.least(*[_first_level(values[k], GRIDS[k]) for k in GRIDS])
    return d.withColumn("reject_level", F.when(F.col("_row") < 0, -1).otherwise(level)).drop(*inner, "_n_lines", "_row")


def _first_level(value: Column, grid: tuple[float, ...]) -> Column:
    """The first level whose cutoff the value is above; LEVELS if none."""
    at = F.when(value > F.lit(grid[0]), 0)
    for k, cutoff in enumerate(grid[1:], 1):
        at = at.when(value > F.lit(cutoff), k)
    return at.otherwise(LEVELS)


def _ln_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series at x + 8, taken back by the recurrence. Error below 1e-12."""
    y = x + 8
    low = x
    for k in range(1, 8):
        low = low * (x + k)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - F.ln(low)


def binomial_tail(x: Column, n: Column, p: float) -> Column:
    """P[Bin(n, p) <= x] for x < n p (otherwise some value above 0.3): the largest term from ln gamma, the smaller ones
    by their ratio, downwards. Terms more than 9 standard deviations below the largest add less than 1e-17 of the sum
    and are left out."""
    x, n = x.cast("double"), n.cast("double")
    top = _ln_gamma(n + 1) - _ln_gamma(x + 1) - _ln_gamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p)
    steps = F.least(x, F.ceil(9 * F.sqrt(n * p * (1 - p))) + 60).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, k: Column) -> Column:
        i = x - k + 1
        term = a["term"] * i * (1 - p) / ((n - i + 1) * p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(F.filter(F.sequence(F.lit(0), steps), lambda k: k > 0), start, add, lambda a: a["sum"])
    return F.when(x >= n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def cutoffs(labelled: DataFrame, *, risk: float = RISK, error: float = ERROR, max_strata: int = MAX_STRATA) -> DataFrame:
    """(stratum, reject_level) of labelled good documents -> (stratum, max_level): the strictest level refuted for each
    stratum, -1 if none. At most max_strata + 1 rows."""
    hist = labelled.groupBy("stratum", "reject_level").count()
    sizes = hist.groupBy("stratum").agg(F.sum("count").alias("n"))
    named = sizes.where(F.col("stratum").isNotNull()).orderBy(F.col("n").desc(), "stratum").limit(max_strata).select("stratum", F.lit(True).alias("named"))
    pooled = hist.join(F.broadcast(named), "stratum", "left").select(F.when(F.col("named"), F.col("stratum")).otherwise(POOLED).alias("stratum"), "reject_level", "count")
    pivot = pooled.groupBy("stratum").agg(F.sum("count").alias("n"), *[F.coalesce(F.sum(F.when(F.col("reject_level") <= k, F.col("count"))), F.lit(0)).alias(f"x{k}") for k in range(LEVELS)])
    strata = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    tested = pivot.withColumn("limit", F.lit(error) / strata)
    for k in range(LEVELS):
        tested = tested.withColumn(f"p{k}", binomial_tail(F.col(f"x{k}"), F.col("n"), risk))
    level = F.when(F.col("p0") > F.col("limit"), -1)
    for k in range(1, LEVELS):
        level = level.when(F.col(f"p{k}") > F.col("limit"), k - 1)
    return tested.select("stratum", level.otherwise(LEVELS - 1).alias("max_level"))


def labelled_good(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """(stratum, reject_level) of the documents labelled good that pass the base rules: the holdout."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1").select(F.col("doc_id").alias("_id"))
    own = measured.where("NOT base_failed").select(F.col(id_col).alias("_id"), F.col(lang_col).alias("stratum"), "reject_level")
    return own.join(good, "_id").select("stratum", "reject_level")


def with_verdict(measured: DataFrame, cuts: DataFrame, lang_col: str = "lang") -> DataFrame:
    """measured, and kept."""
    cuts = cuts.select(F.col("stratum").alias("_stratum"), "max_level")
    own = F.broadcast(cuts.where(F.col("_stratum") != POOLED))  # at most MAX_STRATA rows
    rest = cuts.where(F.col("_stratum") == POOLED).select(F.max("max_level").alias("m")).first()["m"]
    d = measured.join(own, F.col(lang_col) == F.col("_stratum"), "left")
    limit = F.coalesce("max_level", F.lit(-1 if rest is None else rest))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("reject_level") > limit)).drop("_stratum", "max_level")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = materialise(with_measures(docs).drop("text"), "quality-measures")
    cuts = cutoffs(labelled_good(measured, table(spark, sf_dir, "labels")))
    out = with_verdict(measured, cuts)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the rules reject, in the columns of docs. Texts are measured once: rows are written with their
    verdict's measures, and read again for the cutoffs (without the texts) and to be kept or left out."""
    docs, restored = shielded(docs, "doc_id", "text", "lang")
    measured = with_measures(docs).select(*docs.columns, "base_failed", "reject_level")
    measured = materialise(measured, "quality-measured", keep=True)
    cuts = materialise(cutoffs(labelled_good(measured, table(spark, sf_dir, "labels"))), "quality-cutoffs", keep=True)
    return restored(with_verdict(measured, cuts).where("kept"))


def _oracle() -> str:
    level = lambda value, grid: "CASE " + " ".join(f"WHEN {value} > {c!r}::DOUBLE THEN {k}" for k, c in enumerate(grid)) + f" ELSE {LEVELS} END"
    chars, words = "greatest(word_chars, 1)::DOUBLE", "greatest(n_words, 1)::DOUBLE"
    values = {
        "symbol_ratio": f"n_symbols / {chars}", "upper_ratio": f"n_upper / {chars}", "exclaim_ratio": f"n_exclaim / {words}",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)::DOUBLE", "word_length": f"word_chars / {words}",
    }
    levels = ", ".join(level(values[k], GRIDS[k]) for k in GRIDS)
    return rf"""
WITH words AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS row
  FROM documents),
placed AS (SELECT row, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS last FROM words WHERE len(w) >= {WINDOW}),
windows AS (SELECT row, i, last, concat_ws(' ', x, {", ".join(f"lead(x, {k}) OVER p" for k in range(1, WINDOW))}) AS g FROM placed WINDOW p AS (PARTITION BY row ORDER BY i)),
grams AS (SELECT row, i, g FROM windows WHERE i <= last - {WINDOW - 1}),
repeated AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM repeated, range(0, {WINDOW}) AS r(k) GROUP BY row),
base AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaim,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered c USING (row)),
leveled AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, least({levels}) AS reject_level FROM base),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
holdout AS (SELECT lang, reject_level FROM leveled JOIN good USING (doc_id) WHERE NOT base_failed),
named AS (SELECT lang FROM holdout WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT {MAX_STRATA}),
pooled AS (SELECT CASE WHEN lang IN (SELECT lang FROM named) THEN lang ELSE '{POOLED}' END AS stratum, reject_level FROM holdout),
sizes AS (SELECT stratum, count(*) AS n FROM pooled GROUP BY stratum),
tests AS (
  SELECT s.stratum, n, k, (SELECT count(*) FROM pooled p WHERE p.stratum = s.stratum AND p.reject_level <= k) AS x
  FROM sizes s, range(0, {LEVELS}) AS r(k)),
tails AS (
  SELECT stratum, k, CASE WHEN x >= n * {RISK} THEN 1 ELSE (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) FROM range(0, x + 1) AS q(i)) END AS p
  FROM tests),
cuts AS (
  SELECT stratum, coalesce(min(k) FILTER (WHERE p > {ERROR} / (SELECT count(*) FROM sizes)), {LEVELS}) - 1 AS max_level FROM tails GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND reject_level > coalesce(c.max_level, (SELECT max_level FROM cuts WHERE stratum = '{POOLED}'), -1) AS kept
FROM leveled l LEFT JOIN cuts c ON c.stratum = l.lang AND c.stratum <> '{POOLED}'
"""


OP2_SQL = _oracle()
