"""A first answer: a few invented facts, and a question of them by words alone."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import day
from ..operators import search

QUESTION = "Which queue does the harbour office use?"
FACTS = [
    ("harbour office", "paper ledger", "USES_QUEUE", "The harbour office uses a paper ledger as its queue.", "2023-03-01", "2023-09-12"),
    ("harbour office", "tide board", "USES_QUEUE", "The harbour office uses the tide board as its queue.", "2023-09-12", None),
    ("harbour office", "tide board", "MOVED_TO", "The harbour office moved its queue to the tide board in autumn.", "2023-09-12", None),
    ("pilot station", "two lamps", "SIGNALS_WITH", "The pilot station signals with two lamps after dusk.", "2023-05-20", None),
    ("ferry crew", "noon rota", "WORKS_BY", "The ferry crew works by a noon rota.", "2023-06-02", "2030-01-01"),
]


def digest() -> str:
    """What the facts are, so that a graph built from others is built again."""
    return hashlib.sha256(json.dumps(FACTS).encode()).hexdigest()[:12]


def build(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(nodes, facts): a node for every name, once."""
    rows = spark.createDataFrame(FACTS, "source string, target string, name string, fact string, valid_at string, invalid_at string")
    names = rows.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    uuid = lambda c: F.substring(F.sha2(c, 256), 1, 32)
    nodes = names.select(uuid("name").alias("uuid"), "name", F.lit("demo").alias("group_id"), F.array(F.lit("Entity")).alias("labels"), F.lit("").alias("summary"))
    at = lambda c: F.to_timestamp(c).alias(c)
    facts = rows.select(uuid("fact").alias("uuid"), "name", "fact", uuid("source").alias("source_node_uuid"), uuid("target").alias("target_node_uuid"), F.lit("demo").alias("group_id"), at("valid_at"), at("invalid_at"))
    return nodes, facts


def ask(facts: DataFrame, now, question: str = QUESTION, limit: int = 3) -> DataFrame:
    """(current, place, fact, valid_at, invalid_at) with days: what holds, then what was replaced, each up to the limit. There is room
    among the candidates for both."""
    found = search.top(search.bm25(facts, "uuid", F.concat_ws(" ", "name", "fact"), question), 2 * limit, "uuid")
    split = search.split_by_currency(found, now, limit)
    return split.select("current", "place", "fact", day(F.col("valid_at")).alias("valid_at"), day(F.col("invalid_at")).alias("invalid_at"))


def exit_status(answer: DataFrame) -> int:
    """0 if something that holds was found; 1 if nothing was, or only what was replaced."""
    return int(answer.where("current").isEmpty())
