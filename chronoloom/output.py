"""What is shown of results: one JSON object a line, lines for people, and the places where files go by default."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.gates import EXIT


def json_output(rows: DataFrame, *order: str) -> DataFrame:
    """(value): rows as JSON, with nulls."""
    own = rows.orderBy(*order) if order else rows
    return own.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def fact_line(score: str = "score") -> Column:
    """A fact for people: since when it holds, until when it held."""
    until = F.when(F.col("invalid_at").isNotNull(), F.concat(F.lit(" until "), F.date_format("invalid_at", "yyyy-MM-dd"))).otherwise("")
    return F.concat(F.format_string("%.2f  ", F.col(score).cast("double")), F.col("fact"), F.lit(" (since "), F.coalesce(F.date_format("valid_at", "yyyy-MM-dd"), F.lit("an unknown day")), until, F.lit(")"))


def pending_lines(queue: DataFrame, most: int = 10) -> list[str]:
    """The first proposals that wait, and how many more there are."""
    rows = queue.orderBy("created_at", "id").limit(most + 1).select("id", "domain", "text").collect()
    lines = [f"{r['id']}  {r['domain']}  {r['text']}" for r in rows[:most]]
    return lines + [f"and {queue.count() - most} more"] if len(rows) > most else lines


class Refused(ValueError):
    """A command that was refused, with its exit code."""

    def __init__(self, what: str, why: str):
        super().__init__(what)
        self.code = EXIT.get(why, 1)


def export_path(workspace: str, now: datetime) -> str:
    return f"{workspace.rstrip('/')}/export-{now:%Y%m%dT%H%M%SZ}.jsonl"


def review_path(snapshot: str) -> str:
    return f"{snapshot}.review.jsonl"


def approved_path(snapshot: str) -> str:
    return f"{snapshot}.approved.jsonl"


def embedder_path(database: str) -> str:
    return f"{database}.embedder.json"


def workspace(configured: str, override: str = "CHRONOLOOM_WORKSPACE") -> str:
    """The workspace, unless the environment names another."""
    return os.environ.get(override) or configured
