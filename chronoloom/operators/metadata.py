"""One-row metadata: which embedder a graph was written with, where a group's records belong."""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import model_base

IDENTITY = "model string, dimensions int, api_url string"


def database_key(provider: Column, location: Column, name: Column) -> Column:
    return F.concat_ws(":", provider, location, name)


def embedder_drift(recorded: DataFrame, configured: DataFrame, key: str = "database_key") -> DataFrame:
    """recorded and configured (database_key, model, dimensions) -> (database_key, drift): null where they agree or nothing
    is recorded; model names are compared without what follows a colon."""
    r = recorded.select(key, F.col("model").alias("old_model"), F.col("dimensions").alias("old_width"))
    both = configured.join(r, key, "left")
    what = F.when(F.col("old_width").isNotNull() & (F.col("old_width") != F.col("dimensions")), "dimensions")
    what = what.when(F.col("old_model").isNotNull() & (model_base(F.col("old_model")) != model_base(F.col("model"))), "model")
    return both.select(key, what.alias("drift"))


def record_identity(old: DataFrame, new: DataFrame, key: str = "database_key") -> DataFrame:
    """The record after a successful write: a first one is entered, an older one is kept."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def target_group(records: DataFrame, override: str | None, allowed: list[str]) -> DataFrame:
    """records with target_group: the override, else their own; and ``problem`` where there is none or it is not allowed."""
    group = F.coalesce(F.lit(override).cast("string"), F.when(F.col("group_id") != "", F.col("group_id")))
    problem = F.when(group.isNull(), "no group").when(~group.isin(allowed), "not allowed")
    return records.withColumn("target_group", group).withColumn("problem", problem)


# Kinds of failure that may pass, one that does not, and words of those that may.
PASSING_KINDS = ("TimeoutError", "ConnectionError", "OSError", "JSONDecodeError", "RateLimitError", "EmptyResponseError", "ValidationError")
FINAL_KINDS = ("OutputTruncatedError",)
PASSING_WORDS = r"\b429\b|timeout|timed out|temporar|rate limit|empty response|connection|unavailable|try again|too many requests|resource_exhausted|resource exhausted|overloaded"


def _with_kinds_of(names: tuple[str, ...]) -> list[str]:
    """Names of kinds of failure, and of the built-in ones that are of these kinds."""
    known = {k: v for k, v in vars(builtins).items() if isinstance(v, type) and issubclass(v, BaseException)}
    bases = tuple(known[n] for n in names if n in known)
    return sorted({*names, *(k for k, v in known.items() if issubclass(v, bases))})


def retryable(status: Column, kind: Column, detail: Column) -> Column:
    """Whether a failed call is worth another try: by its status if it has one, else by kind (or a kind that it is one of), else by its words."""
    by_words = F.lower(F.coalesce(detail, F.lit(""))).rlike(PASSING_WORDS)
    return F.when(kind.isin(list(FINAL_KINDS)), False).when(status.between(400, 599), (status == 429) | (status >= 500)).when(kind.isin(_with_kinds_of(PASSING_KINDS)), True).otherwise(by_words)


def read_identity(spark: SparkSession, path: str) -> DataFrame:
    """(model, dimensions, api_url) recorded beside a graph; no row where there is none, and an error where it names no model or width."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], IDENTITY)
    rows = spark.read.schema(IDENTITY).option("multiLine", "true").json(path)
    if not rows.where("trim(coalesce(model, '')) <> '' AND dimensions > 0").count() == rows.count() == 1:
        raise ValueError(f"{path}: not the record of an embedder")
    return rows


def write_identity(spark: SparkSession, path: str, model: str, dimensions: int, api_url: str = "") -> DataFrame:
    """Record, after a write that landed, what made its vectors."""
    row = spark.createDataFrame([(model.split(":", 1)[0].strip(), dimensions, api_url)], IDENTITY)
    row.coalesce(1).write.mode("overwrite").json(path)
    return read_identity(spark, path)


def agreed_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """The one record of two places: what either has; an error if they differ."""
    both = a.unionByName(b).select(model_base(F.col("model")).alias("model"), "dimensions").distinct()
    if both.count() > 1:
        raise ValueError("the records of the embedder disagree")
    return both
