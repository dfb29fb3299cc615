"""Keys and digests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# The fields of a proposal that a reviewer approves, in the order of canonical JSON.
REVIEWED = ("domain", "edges", "fact_type", "facts", "id", "learned_at", "link", "operation", "provenance", "said", "source", "supersedes", "supersedes_rejection", "text", "valid_at")


def record_key(domain: Column, name: Column, body: Column, valid_at: Column) -> Column:
    """Content key of a record: the first 32 hex digits of SHA-256 over its parts, joined by U+001F."""
    parts = [domain, strip(F.coalesce(name, F.lit(""))), strip(F.coalesce(body, F.lit(""))), F.coalesce(valid_at, F.lit(""))]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def uuid_of(key: Column) -> Column:
    """32 hex digits in the form of a UUID."""
    return F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def canonical_json(row: DataFrame | list[str], columns: list[str] | None = None) -> Column:
    """One compact JSON object with sorted keys, nulls left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns or row)]), {"ignoreNullFields": "true"})


def content_digest(have: list[str]) -> Column:
    """Digest of a proposal's reviewed fields, of those among the columns ``have``; empty strings count, nulls do not."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json([c for c in REVIEWED if c in have]), 256))


def group_folder(group: Column) -> Column:
    """Folder name of a group: safe whatever the group is called."""
    return F.sha2(group, 256)


def retry_delay(key: Column, attempt: Column, base: float) -> Column:
    """Seconds before the attempt after this one: doubling, with up to a quarter of base more by the key."""
    share = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))
    return F.when(F.lit(base <= 0), F.lit(0.0)).otherwise(F.lit(base) * F.pow(F.lit(2.0), attempt - 1) + share * base * 0.25)


def model_base(model: Column) -> Column:
    """Model name without what follows a colon."""
    return F.trim(F.substring_index(model, ":", 1))
