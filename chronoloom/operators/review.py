"""Snapshots and their review: one text file of a header and records, and decisions on its facts."""

from __future__ import annotations

import hashlib
import json
import pathlib
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("entity_node", "episodic_node", "entity_edge", "episodic_edge")
DECISIONS = ("accept", "refuse", "contested", "review")
FORMATS = (1, 2)
VECTORS = ("name_embedding", "fact_embedding")


def snapshot_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """(kind_order, uuid, line): every record as canonical JSON (sorted keys, no nulls), vectors left out."""
    out = None
    for i, kind in enumerate(KINDS):
        if kind not in parts:
            continue
        df = parts[kind].drop(*VECTORS).withColumn("kind", F.lit(kind))
        one = df.select(F.lit(i).alias("kind_order"), F.col("uuid"), F.to_json(F.struct(*sorted(df.columns))).alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def write_snapshot(parts: dict[str, DataFrame], path: str, header: dict) -> dict:
    """Write header and records in order (kinds, then ids) to one file, by way of a temporary name. The checksum covers
    record lines in file order, so they pass through the driver one partition at a time, and are never held all."""
    lines = snapshot_lines(parts).orderBy("kind_order", "uuid", "line").select("line")
    target = pathlib.Path(path)
    body, digest, n = target.with_suffix(".body"), hashlib.sha256(), 0
    with body.open("w", encoding="utf-8") as f:
        for row in lines.toLocalIterator():
            f.write(row["line"] + "\n")
            digest.update(row["line"].encode() + b"\n")
            n += 1
    head = header | {"kind": "export", "format_version": 2, "record_count": n, "sha256": digest.hexdigest()}
    whole = target.with_suffix(".part")
    with whole.open("w", encoding="utf-8") as f, body.open(encoding="utf-8") as g:
        f.write(json.dumps(head, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n")
        for line in g:
            f.write(line)
    body.unlink()
    whole.replace(target)
    return head


def read_snapshot(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, lines (kind, line)) of a snapshot in one file, once it was read through: the header comes first, kinds and format are known, and of
    format 2 the count and checksum match. Tasks read it, by ranges of bytes; the driver reads the header alone."""
    from ..sources import formats

    formats.register(spark)
    head, _ = formats.first_line(path)
    lines = spark.read.format(formats.SnapshotSource.name()).load(path)
    try:
        lines.write.format("noop").mode("overwrite").save()
    except PySparkException as e:
        told = [x for x in str(e).splitlines() if x.startswith("ValueError: ")]
        if not told:
            raise
        raise ValueError(told[-1].removeprefix("ValueError: ")) from e
    return head, lines.select("kind", "line")


def typed_records(lines: DataFrame, kind: str, group: str | None = None) -> DataFrame:
    """Records of one kind from a snapshot's lines (kind, line), with the kind's schema: without vectors, and of another group, if given."""
    from ..sources.views import KINDS as SCHEMAS

    schema = T.StructType([f for f in SCHEMAS[kind] if f.name not in VECTORS])
    rows = lines.where(F.col("kind") == kind).select(F.from_json("line", schema).alias("r")).select("r.*")
    return rows if group is None else rows.withColumn("group_id", F.lit(group))


def all_records(lines: DataFrame, group: str | None = None) -> dict[str, DataFrame]:
    return {kind: typed_records(lines, kind, group) for kind in KINDS}


# A block is 2 ** BRANCH_BITS records that follow each other in a part; so many children has a node of the tree above the blocks.
BRANCH_BITS = 12


def write_parts(parts: dict[str, DataFrame], path: str, header: dict) -> dict:
    """A snapshot as a folder of Parquet parts, one a task and none through the driver: (part, place, kind, line), with the checksum of every
    block of ordered records in the manifest beside them. The header has the root of the tree over the blocks' checksums,
    so neither a task nor the driver holds the hashes of a part."""
    lines = snapshot_lines(parts).orderBy("kind_order", "uuid", "line").select("line", F.get_json_object("line", "$.kind").alias("kind"))
    placed = lines.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    placed.write.mode("error").parquet(f"{path}/lines")
    spark = lines.sparkSession
    block_sums(spark.read.parquet(f"{path}/lines")).write.mode("error").parquet(f"{path}/manifest")
    return header | {"kind": "export", "format_version": 2} | tree_root(spark.read.parquet(f"{path}/manifest"))


def _sum_of(members: str | Column) -> Column:
    """The checksum of gathered (number, digest), in the order of their numbers, which count too."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(members)), lambda x: F.concat(x["n"].cast("string"), F.lit(":"), x["h"])), "\n"), 256)


def block_sums(lines: DataFrame) -> DataFrame:
    """(block, part, records, sha256): the leaves of the tree. A place is the part's number and, in its lower 33 bits, that of the record in it,
    so a block never has records of two parts."""
    one = lines.select("part", F.shiftright("place", BRANCH_BITS).alias("block"), F.struct(F.col("place").alias("n"), F.sha2(F.concat("line", F.lit("\n")), 256).alias("h")).alias("x"))
    return one.groupBy("block").agg(F.min("part").alias("part"), F.count(F.lit(1)).alias("records"), _sum_of("x").alias("sha256"))


def tree_root(blocks: DataFrame) -> dict:
    """{record_count, sha256}: the root over the blocks' checksums. Levels are made until one has as few nodes as a node may have children;
    blocks of several snapshots whose places differ have one root too, however they are put together."""
    from ..sources.store import written

    level, most = blocks.select(F.col("block").alias("n"), "records", F.col("sha256").alias("h")), 1 << BRANCH_BITS
    while level.count() > most:
        above = level.groupBy(F.shiftright("n", BRANCH_BITS).alias("_above")).agg(F.sum("records").alias("records"), _sum_of_level().alias("h"))
        level = written(above.select(F.col("_above").alias("n"), "records", "h"), "tree")
    root = level.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), _sum_of_level().alias("h")).first()
    return {"record_count": root["records"], "sha256": root["h"]}


def _sum_of_level() -> Column:
    return _sum_of(F.struct("n", "h"))


def damaged_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block, part, first, last): blocks of a snapshot in parts whose records are not those of the manifest, with the numbers that their
    records have, or should have, in the part."""
    had = spark.read.parquet(f"{path}/manifest").select("block", F.col("part").alias("_part"), F.col("sha256").alias("_sha256"))
    both = block_sums(spark.read.parquet(f"{path}/lines")).join(had, "block", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("_sha256")))
    first = F.shiftleft(F.col("block"), BRANCH_BITS) % F.lit(1 << 33)
    return both.select("block", F.coalesce("part", "_part").alias("part"), first.alias("first"), (first + (1 << BRANCH_BITS) - 1).alias("last"))


def read_block(spark: SparkSession, path: str, block: int) -> DataFrame:
    """(place, kind, line) of one block: the range of places reaches the files, which are in that order, so the rest is not read."""
    at = block << BRANCH_BITS
    return spark.read.parquet(f"{path}/lines").where(F.col("place").between(at, at + (1 << BRANCH_BITS) - 1)).select("place", "kind", "line")


def read_parts(spark: SparkSession, path: str, header: dict | None = None) -> DataFrame:
    """(kind, line) of a snapshot in parts, once every block's checksum, and the header's, match."""
    if (bad := damaged_blocks(spark, path).orderBy("block").first()) is not None:
        raise ValueError(f"{path}: part {bad['part']}, records {bad['first']} to {bad['last']} do not match their checksum")
    if header is not None and {k: header.get(k) for k in ("record_count", "sha256")} != tree_root(spark.read.parquet(f"{path}/manifest")):
        raise ValueError(f"{path}: the parts are not those of the header")
    return spark.read.parquet(f"{path}/lines").select("kind", "line")


def decision_template(facts: DataFrame) -> DataFrame:
    """A row for every fact, to be decided."""
    return facts.select(F.lit("decision").alias("kind"), F.lit("entity_edge").alias("record_kind"), "uuid", "fact", F.lit("review").alias("decision"), F.lit("").alias("reason"))


def write_decisions(rows: DataFrame, path: str, snapshot: dict) -> dict:
    """A folder of JSONL decisions for a snapshot with this header, and the header of the decisions, which names it."""
    header = {"kind": "review", "format_version": 1, "decision_scope": "entity_edge", "snapshot_sha256": snapshot.get("sha256"), "snapshot_record_count": snapshot.get("record_count")}
    spark = rows.sparkSession
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("error").text(f"{path}/decisions")
    spark.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{path}/header")
    return header


def read_decisions(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(header, rows) of decisions in a folder, or in one file whose first line is the header. A row of another kind or scope, an unknown
    word and a refusal without a reason are errors that tell the line."""
    from ..sources.records import _lines, json_lines, line_number
    from ..sources.views import DECISION

    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/decisions")
    apart = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    source = f"{path}/decisions" if apart else path
    first = (spark.read.text(f"{path}/header") if apart else _lines(spark, path).where(F.trim("line") != "").select("line")).first()
    header = json.loads(first[0]) if first else None
    if header is None or header.get("kind") != "review":
        raise ValueError(f"{path}: no decisions")
    if header.get("format_version") != 1:
        raise ValueError(f"{path}: format {header.get('format_version')} is not supported")
    rows = json_lines(spark, source)
    rows = rows if apart else rows.where(F.coalesce(F.col("object")["kind"], F.lit("")) != "review")
    rows = rows.select("file", "block", "n", *[F.col("object")[c].alias(c) for c in DECISION.fieldNames()])
    wrong = (
        F.when(~F.col("kind").eqNullSafe("decision"), "not a decision").when(~F.col("record_kind").eqNullSafe("entity_edge"), "decisions are of facts alone")
        .when(~F.coalesce(F.col("decision").isin(list(DECISIONS)), F.lit(False)), "an unknown decision").when((F.col("decision") == "refuse") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "a refusal without a reason")
    )
    if (bad := rows.withColumn("wrong", wrong).where("wrong IS NOT NULL").orderBy("file", "block", "n").first()) is not None:
        raise ValueError(f"{bad['file']}:{line_number(_lines(spark, source), bad)}: {bad['wrong']}")
    return header, rows.drop("file", "block", "n")


def promote(snapshot: dict, records: dict[str, DataFrame], review: dict, decisions: DataFrame) -> tuple[dict, dict[str, DataFrame]]:
    """(header, records) of what reviewers accepted. The decisions must be of this snapshot, one for every fact, and none open."""
    if review.get("snapshot_sha256") != snapshot.get("sha256"):
        raise ValueError(f"decisions are of snapshot {review.get('snapshot_sha256')}, not {snapshot.get('sha256')}")
    facts = records["entity_edge"]
    if (bad := decision_problems(facts, decisions).orderBy("problem", "uuid").first()) is not None:
        raise ValueError(f"decision on {bad['uuid']}: {bad['problem']}")
    kept, episodes = apply_decisions(facts, records["episodic_node"], decisions)
    counts = decisions.agg(F.count_if(F.col("decision") == "accept").alias("accepted"), F.count_if(F.col("decision") == "refuse").alias("refused")).first()
    return snapshot | {"review": {"source_sha256": snapshot.get("sha256"), **counts.asDict()}}, records | {"entity_edge": kept, "episodic_node": episodes}


def decision_problems(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(problem, uuid): decisions that are unknown, repeated, of an unknown word, without a reason for a refusal, or
    open, and facts without one. Empty if the decisions can be applied."""
    counted = decisions.groupBy("uuid").agg(F.count(F.lit(1)).alias("n"), F.first("decision").alias("decision"), F.first("reason").alias("reason"))
    both = facts.select("uuid", F.lit(True).alias("_fact")).join(counted, "uuid", "full_outer")
    problem = (
        F.when(F.col("_fact").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
        .when(~F.col("decision").isin(list(DECISIONS)), "not a decision").when((F.col("decision") == "refuse") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "no reason")
        .when(F.col("decision").isin("review", "contested"), "unresolved")
    )
    return both.select(problem.alias("problem"), "uuid").where("problem IS NOT NULL")


def apply_decisions(facts: DataFrame, episodes: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, episodes) without the refused facts; episodes' lists lose them too, in their order.

    Refused ids meet the lists' elements in a join, so there is no list of all refusals in one row."""
    refused = decisions.where("decision = 'refuse'").select("uuid").distinct()
    kept = facts.join(refused, "uuid", "left_anti")
    listed = episodes.select(F.col("uuid").alias("_e"), F.posexplode("entity_edges").alias("pos", "fact_id"))
    left = listed.join(refused.withColumnRenamed("uuid", "fact_id"), "fact_id", "left_anti").groupBy("_e").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "fact_id"))), lambda x: x["fact_id"]).alias("_kept"))
    own = episodes.join(left, F.col("uuid") == F.col("_e"), "left")
    lists = F.when(F.col("entity_edges").isNotNull(), F.coalesce("_kept", F.array().cast("array<string>")))
    return kept, own.withColumn("entity_edges", lists).drop("_e", "_kept")


def restore_plan(records: dict[str, DataFrame], allowed: list[str], override: str | None = None) -> DataFrame:
    """A dry run: (target_group, kind, planned) of what a restore would write; a record of no group, or of one that is not
    allowed, is an error."""
    from .metadata import target_group

    rows = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "uuid", "group_id") for kind, df in records.items()])
    planned = target_group(rows, override, allowed)
    if (bad := planned.where("problem IS NOT NULL").orderBy("problem", "uuid").first()) is not None:
        raise ValueError(f"{bad['kind']} {bad['uuid']}: {bad['problem']}")
    return planned.groupBy("target_group", "kind").agg(F.count(F.lit(1)).alias("planned"))


def restore(existing: dict[str, DataFrame], records: dict[str, DataFrame], group: str | None = None, embed: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Upsert records by uuid: nodes, episodes, facts, mentions. Edges whose endpoints neither exist nor come along are
    left out and reported as (kind, uuid, missing). A snapshot has no vectors: ``embed`` (``models.re_embedded`` of a model) gives
    the records new ones."""
    from .reads import dangling
    from .workflow import upsert

    into = {k: (df if group is None else df.withColumn("group_id", F.lit(group))).drop(*VECTORS) for k, df in records.items()}
    into = into if embed is None else embed(into)
    out, failed = dict(existing), None
    for kind in KINDS:
        if kind not in into:
            continue
        rows = into[kind]
        if kind in ("entity_edge", "episodic_edge"):
            sources = out["entity_node" if kind == "entity_edge" else "episodic_node"]
            bad = dangling(rows, sources, out["entity_node"]).select(F.lit(kind).alias("kind"), "uuid", "missing")
            rows = rows.join(bad.select("uuid"), "uuid", "left_anti")
            failed = bad if failed is None else failed.unionByName(bad)
        out[kind] = upsert(out[kind], rows) if kind in out else rows
    return out, failed
