"""Input records: JSONL, JSON, plain documents and folders of them; queues and ledgers; writes that replace or append."""

from __future__ import annotations

import pathlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..operators.chunk import MAX_CHARS, chunk_records
from .views import LEDGER, PROPOSAL, RECORD

SUFFIXES = (".jsonl", ".json", ".md", ".markdown", ".txt")


_OBJECT = T.MapType(T.StringType(), T.StringType())


def _lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, block, n, line) of text files, blank lines too: (block, n) goes in the order of a file's lines."""
    reader = spark.read.option("recursiveFileLookup", "true") if glob else spark.read
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return rows.select(*where, F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def line_number(lines: DataFrame, bad) -> int:
    """The number, from 1, of a line of its file: those before it are counted where they are read."""
    before = (F.col("block") < bad["block"]) | ((F.col("block") == bad["block"]) & (F.col("n") < bad["n"]))
    return lines.where((F.col("file") == bad["file"]) & before).count() + 1


def json_lines(spark: SparkSession, path: str, *, skip_invalid: bool = False, glob: str | None = None) -> DataFrame:
    """(file, block, n, line, object) of every line that is not blank: what it reads as, a map from its fields to their text. A line
    that is no object is an error that tells its number, or skipped."""
    lines = _lines(spark, path, glob)
    rows = lines.where(F.trim("line") != "").withColumn("object", F.from_json("line", _OBJECT))
    is_object = F.col("object").isNotNull() & F.ltrim("line").startswith("{")
    if not skip_invalid and (bad := rows.where(~is_object).orderBy("file", "block", "n").first()) is not None:
        raise ValueError(f"{bad['file']}:{line_number(lines, bad)}: not an object: {bad['line'][:80]}")
    return rows.where(is_object)


def _record(of: str) -> list:
    """The fields of a record from a map of them. A field that is there and null is the text "None" where one must be."""
    must = lambda c: F.when(F.map_contains_key(of, c), F.coalesce(F.col(of)[c], F.lit("None")))
    return [(must(c) if c in ("name", "body") else F.col(of)[c]).alias(c) for c in RECORD.fieldNames()]


def _missing() -> Column:
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    return F.when(blank("name"), "name").when(blank("body"), "body")


def read_records(spark: SparkSession, path: str, *, skip_invalid: bool = False, glob: str | None = None) -> DataFrame:
    """JSONL records (name, body, domain, valid_at, provenance). Blank lines vanish. A line that is no object, or lacks
    name or body, is an error that tells the line, or skipped. A snapshot's header on the first line of all is refused."""
    lines = _lines(spark, path, glob)
    first = lines.select("line", F.get_json_object("line", "$.kind").alias("k")).first()
    if first is not None and first["k"] == "export":
        raise ValueError(f"{path}: a snapshot, not records")
    rows = json_lines(spark, path, skip_invalid=skip_invalid, glob=glob).select("file", "block", "n", *_record("object"))
    if not skip_invalid and (bad := rows.withColumn("lacks", _missing()).where("lacks IS NOT NULL").orderBy("file", "block", "n").first()) is not None:
        raise ValueError(f"{bad['file']}:{line_number(lines, bad)}: no {bad['lacks']}")
    return rows.where(_missing().isNull()).select(*RECORD.fieldNames())


def read_json(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Records of JSON files, each an object or a list of objects, all with name and body."""
    reader = spark.read.option("recursiveFileLookup", "true") if glob else spark.read
    files = (reader.option("pathGlobFilter", glob) if glob else reader).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    listed = F.when(F.col("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    items = files.withColumn("items", F.from_json(listed, T.ArrayType(_OBJECT)))
    if (bad := items.where(F.col("items").isNull() | (F.size("items") == 0) | F.exists("items", lambda x: x.isNull())).first()) is not None:
        raise ValueError(f"{bad['file']}: neither an object nor a list of objects")
    rows = items.select("file", F.explode("items").alias("object")).select("file", *_record("object"))
    if (bad := rows.where(_missing().isNotNull()).first()) is not None:
        raise ValueError(f"{bad['file']}: a record without name or body")
    return rows.select(*RECORD.fieldNames())


def _led_away(root: str) -> list[str]:
    """Names below a folder of this machine that lead out of it; none for other stores, which have no links."""
    if "://" in root and not root.startswith("file://"):
        return []
    base = pathlib.Path(root.removeprefix("file://"))
    top = base.resolve()
    return sorted(str(p.relative_to(base)) for p in base.rglob("*") if p.is_symlink() and not p.resolve().is_relative_to(top))


def read_documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".md", ".markdown", ".txt")) -> DataFrame:
    """(name, body) of text files under a folder, whole: names are paths below it; hidden parts, other suffixes, blank files and what
    lies beyond links that lead out of the folder are left out."""
    root = path.rstrip("/")
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("p"), strip(F.col("value")).alias("body"))
    bare = F.regexp_replace(F.url_decode(F.regexp_replace("p", "[+]", "%2B")), "^file:/+", "/")
    base = root.removeprefix("file://")
    name = F.when(bare.startswith(base + "/"), F.substring(bare, len(base) + 2, 1 << 30)).otherwise(F.element_at(F.split(bare, "/"), -1))
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower(name).endswith(s)
    for away in _led_away(root):
        wanted = wanted & ~((name == away) | name.startswith(away + "/"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    return files.select(name.alias("name"), "body", none("domain"), none("valid_at")).where(wanted & ~name.rlike(r"(^|/)\.") & (F.col("body") != "")).withColumn("provenance", F.concat(F.lit("local document: "), F.col("name")))


def read_input(spark: SparkSession, path: str, *, domain: str | None = None, max_chars: int = MAX_CHARS, skip_invalid: bool = False) -> DataFrame:
    """Records of a file, by suffix, or of all such files of a folder, in chunks, in the order of their names; no record is an error."""
    low = path.lower()
    if low.endswith(".jsonl"):
        rows = read_records(spark, path, skip_invalid=skip_invalid)
    elif low.endswith(".json"):
        rows = read_json(spark, path)
    else:
        rows = read_documents(spark, path)
        if not low.endswith(SUFFIXES):
            rows = rows.unionByName(read_records(spark, path, skip_invalid=skip_invalid, glob="*.jsonl")).unionByName(read_json(spark, path, glob="*.json"))
    if domain:
        rows = rows.withColumn("domain", F.coalesce(F.when(F.col("domain") != "", F.col("domain")), F.lit(domain)))
    rows = chunk_records(rows, max_chars)
    if rows.limit(1).count() == 0:
        raise ValueError(f"{path}: no records")
    return rows.orderBy("name", "chunk_index")


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Proposals; a corrupt line is an error."""
    return spark.read.schema(PROPOSAL).option("mode", "FAILFAST").json(path)


def completed_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct keys of a ledger; corrupt lines are passed over."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path).where("key IS NOT NULL").select("key").distinct()


def queued(queue: DataFrame, groups: list[str] | None = None, status: str = "pending") -> DataFrame:
    """Proposals of the queue with a status, of the groups."""
    rows = queue.where(F.col("status") == status)
    return rows if groups is None else rows.where(F.col("domain").isin(groups))


def landed_proposal(archive: DataFrame, proposal: str) -> DataFrame:
    """The archived proposal whose facts landed, with its episodes: what can be retracted; else an error."""
    found = archive.where((F.col("id") == proposal) & (F.col("status") == "approved") & (F.col("operation") != "retire") & (F.size("episodes") > 0))
    if found.isEmpty():
        raise ValueError(f"{proposal}: not a proposal with landed facts")
    return found


def rejected(queue: DataFrame, archive: DataFrame, domain: str | None = None) -> DataFrame:
    """Rejected proposals of archive and queue, newest decision first, undecided last; ``facts`` always filled."""
    both = archive.unionByName(queue, allowMissingColumns=True).where("status = 'rejected'")
    both = both if domain is None else both.where(F.col("domain") == domain)
    facts = F.when(F.coalesce(F.size("facts"), F.lit(0)) > 0, F.col("facts")).otherwise(F.array("text"))
    return both.withColumn("facts", facts).orderBy(F.desc(F.coalesce("decided_at", F.lit(""))), "id")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_table(df: DataFrame, base: str) -> str:
    """Write a new version beside the old ones: readers of a version see all of it or none. Returns its path."""
    path = f"{base.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def rewrite_queue(queue: DataFrame, moves) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go to the archive)."""
    moved = F.coalesce(moves, F.lit(False))
    return queue.where(~moved), queue.where(moved)


def write_by_group(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder a group, so that a read of a group opens only its own files."""
    df.write.mode(mode).partitionBy("group_id").parquet(path)
