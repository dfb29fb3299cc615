"""Invariants and data checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

SEVERITY = ("ok", "warn", "fail")
DEALT = 1 << 20  # about as many ids a task sorts, however many there are


def leaked(served: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """Facts served as current that are not."""
    from .reads import is_current

    return served.select("uuid").join(facts.where(~is_current(now)).select("uuid"), "uuid", "left_semi")


# What a row may have wrong by itself, and how grave that is.
LEVELS = {"no id": "fail", "blank facts": "warn", "ends before start": "warn", "vector width": "fail"}


def row_rules(columns: list[str], width: int | None = None) -> dict[str, Column]:
    """The checks that a row with these columns answers alone, by name: true where it is wrong."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = {}
    if "uuid" in columns:
        rules["no id"] = blank("uuid")
    if "fact" in columns:
        rules["blank facts"] = blank("fact")
    if {"valid_at", "invalid_at"} <= set(columns):
        rules["ends before start"] = F.coalesce(F.col("invalid_at") < F.col("valid_at"), F.lit(False))
    for vector in ("embedding", "name_embedding", "fact_embedding"):
        if vector in columns and width is not None:
            rules["vector width"] = F.coalesce(F.size(vector) != width, F.lit(False)) & F.col(vector).isNotNull()
    return rules


class Watched:
    """``rows`` to be written, and what the write itself sees of them: their number and, for each of the rules, how many break it. The
    counts are taken in the tasks that write, each of which counts once however often it is tried, so no scan follows."""

    def __init__(self, rows: DataFrame, rules: dict[str, Column]):
        self.rules, self._seen = list(rules), Observation()
        counts = [F.count_if(broken).alias(f"_{i}") for i, broken in enumerate(rules.values())]
        self.rows = rows.observe(self._seen, F.count(F.lit(1)).alias("_rows"), *counts)

    def counts(self) -> dict[str, int]:
        """{"rows": n, rule: n, ...}, once the rows are written; a table that is planned away as empty has 0 of all."""
        got = self._seen.get
        return {"rows": got.get("_rows") or 0} | {rule: got.get(f"_{i}") or 0 for i, rule in enumerate(self.rules)}


def counted_checks(spark: SparkSession, counts: dict[str, dict[str, int]]) -> DataFrame:
    """(kind, check, status, detail) of the counts that writes have left, by table; nothing is read."""
    found = [(kind, rule, "ok" if not n else LEVELS[rule], n) for kind, of in sorted(counts.items()) for rule, n in of.items() if rule != "rows"]
    return spark.createDataFrame(found, "kind string, check string, status string, detail long")


def data_checks(facts: DataFrame, nodes: DataFrame, width: int | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(check, status, detail): duplicate ids, unknown endpoints, ends before starts, blank facts, vectors of another width. Facts are
    flagged where they are read and counted once for all of their checks; flags alone go with the ids. Ids are nearly all unique, so tables
    of them would hold them all: they are dealt to as many tasks as they ask for and sorted, and a second one of an id is a duplicate."""
    from .reads import with_missing

    levels = {"duplicate ids": "fail", "unknown endpoints": "fail"} | {k: v for k, v in LEVELS.items() if k in row_rules(facts.columns) and k != "no id"}
    rules = row_rules(facts.columns)
    own = facts.select("uuid", "source_node_uuid", "target_node_uuid", *[broken.alias(k) for k, broken in rules.items() if k in levels])
    flagged = with_missing(own, nodes, nodes).withColumn("unknown endpoints", F.col("missing").isNotNull())
    flags = [k for k in levels if k in flagged.columns]
    tasks = max(facts.sparkSession.sparkContext.defaultParallelism, math.ceil(facts.count() / DEALT))
    nth = F.row_number().over(Window.partitionBy("uuid").orderBy("uuid"))
    total = flagged.select("uuid", *flags).repartition(tasks, "uuid").withColumn("_nth", nth).agg(F.count_if(F.col("_nth") == 2).alias("duplicate ids"), *[F.count_if(k).alias(k) for k in flags])
    if vectors is not None:
        levels["vector width"] = "fail"
        total = total.withColumn("vector width", vectors.agg(F.count_if(F.size("embedding") != width).alias("n")).scalar())
    row = lambda k: F.struct(F.lit(k).alias("check"), F.when(F.col(k) == 0, "ok").otherwise(levels[k]).alias("status"), F.col(k).alias("detail"))
    return total.select(F.inline(F.array(*[row(k) for k in levels])))


def worst_status(checks: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), F.col("status"))
    return checks.agg(F.coalesce(F.max_by("status", rank), F.lit("ok")).alias("status"))


def secret_audit(files: DataFrame) -> DataFrame:
    """(path, line, families) of lines of text files (path, line, text) that hold a secret's shape."""
    from ..functions.text import secret_shapes

    return files.select("path", "line", secret_shapes(F.col("text")).alias("families")).where(F.size("families") > 0)
