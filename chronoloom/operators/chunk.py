"""Bounded chunks of long texts: paragraphs together while they fit, long ones cut at white space."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

MAX_CHARS = 12_000


def cut_paragraph(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters: cut at the last line end or space in reach, or hard where that would
    leave less than half a piece."""
    pieces, at, end = [], 0, len(text)
    while end - at > most:
        near = max(text.rfind("\n", at, at + most + 1), text.rfind(" ", at, at + most + 1)) - at
        near = near if near >= most // 2 else most
        pieces.append(text[at : at + near].strip())
        at += near
        while at < end and text[at].isspace():
            at += 1
    if at < end:
        pieces.append(text[at:end])
    return pieces


def chunks(text: str | None, most: int = MAX_CHARS) -> list[str]:
    text = (text or "").strip()
    if not text:
        return []
    if most <= 0 or len(text) <= most:
        return [text]
    out: list[list[str]] = []
    size = 0
    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        for piece in cut_paragraph(paragraph, most):
            if out and size + 2 + len(piece) <= most:
                out[-1].append(piece)
                size += 2 + len(piece)
            else:
                out.append([piece])
                size = len(piece)
    return ["\n\n".join(x) for x in out]


def chunk_records(records: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """records (name, body, ...) in chunks: further columns stay, a name of several parts tells which, and chunk_index
    and chunk_count are null for a whole. Records without text vanish. Cutting depends on what was cut before, so it runs
    in Python, by rows."""

    ship(records.sparkSession)

    # By rows, not Arrow batches: a worker holds a hundred texts and their chunks, however long texts are, where a batch holds 10,000.
    cut = F.udf(lambda body: chunks(body, most), "array<string>", useArrow=False)
    long = records.withColumn("_c", cut("body")).withColumn("_n", F.size("_c")).select("*", F.posexplode("_c").alias("_i", "_b"))
    several = F.col("_n") > 1
    part = F.concat(F.trim(F.col("name")), F.lit(" [part "), (F.col("_i") + 1).cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit("]"))
    return long.withColumn("name", F.when(several, part).otherwise(F.col("name"))).withColumn("body", F.col("_b")).withColumn("chunk_index", F.when(several, F.col("_i") + 1)).withColumn("chunk_count", F.when(several, F.col("_n"))).drop("_c", "_n", "_i", "_b")
