"""Streams: resumable ingestion with a ledger, duplicates within a watermark, proposal states."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.identity import uuid_of
from ..operators.metadata import FINAL_KINDS, PASSING_KINDS, PASSING_WORDS
from ..operators.workflow import keyed_records, resume_plan, step
from ..shipping import ship
from ..sources.ledger import Ledger
from ..sources.views import RECORD


OUTCOME = "key string, episode_uuid string, name string, domain string, facts array<string>, nodes int, edges int, attempts int, operation string, error_type string, error string, retryable boolean"


def passes(error: BaseException) -> bool:
    """Whether a failed call is worth another try: by its status if it has one, else by its kind or one that it is a kind of, else by
    its words."""
    status = getattr(error, "status_code", None) or getattr(getattr(error, "response", None), "status_code", None)
    kinds = {k.__name__ for k in type(error).__mro__}
    if kinds & set(FINAL_KINDS):
        return False
    if isinstance(status, int) and 400 <= status <= 599:
        return status == 429 or status >= 500
    return bool(kinds & set(PASSING_KINDS)) or re.search(PASSING_WORDS, str(error).lower()) is not None


def extract_records(records: DataFrame, extract: Callable[[dict], tuple[int, list[str]]], *, attempts: int = 3, base: float = 0.0) -> DataFrame:
    """(OUTCOME) of keyed records: ``extract`` takes a record and returns (nodes, facts). A record that fails costs no other: it is tried
    ``attempts`` times if the failure may pass, after a delay that doubles and differs by key, and then has an error in place of facts.
    Runs in Arrow batches, as it may call out to a model."""
    ship(records.sparkSession)

    def one(row: dict) -> tuple:
        for attempt in range(1, attempts + 1):
            try:
                nodes, facts = extract(row)
                return facts, nodes, len(facts), attempt, None, None, None, None
            except Exception as e:  # noqa: BLE001  whatever it is belongs to this record
                again = passes(e)
                if not again or attempt == attempts:
                    return None, 0, 0, attempt, "extract", type(e).__name__, str(e).strip() or f"{type(e).__name__} (no message)", again
                time.sleep(base * 2 ** (attempt - 1) + base * 0.25 * int(row["key"][:8], 16) / 0xFFFFFFFF)
        raise AssertionError

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in OUTCOME.split(", ")]
        for frame in frames:
            rows = [(r["key"], r["episode_uuid"], r["name"], r["domain"], *one(r)) for r in frame.to_dict("records")]
            yield pd.DataFrame(rows, columns=names).astype({"nodes": "int32", "edges": "int32", "attempts": "int32"})

    return records.mapInPandas(run, OUTCOME)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def ingest_stream(spark: SparkSession, source: str, target: str, ledger: str, checkpoint: str, *, domain: str, extract: Callable[[dict], tuple[int, list[str]]] | None = None, attempts: int = 3, files_per_batch: int | None = None) -> StreamingQuery:
    """Ingest what is new in a folder of JSONL, then stop; stopped early, it ends between two micro-batches (of ``files_per_batch`` files).

    A micro-batch takes the records whose key the ledger lacks, of which it opens only files that may hold one of them (``Ledger``), and writes
    them once (``target``); then those that are done are entered in the ledger, with receipts and failures beside it. Its folders carry the
    checkpoint's id and the batch's number, so a batch that is run again replaces what it had written, and streams with
    checkpoints of their own may share a ledger, one at a time. A record that failed is kept whole in a queue beside the target
    (``-retry``): the next run takes what of it the ledger lacks before anything new, once a run. ``extract`` as in
    extract_records; without it, records are kept as episodes."""
    reader = spark.readStream.schema(RECORD)
    records = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(source)
    queue = f"{target}-retry"

    def enter(new: DataFrame, name: str) -> DataFrame:
        """Records through extraction into folders of that name; what there is of each key."""
        s = new.sparkSession
        outcome = extract_records(new, extract, attempts=attempts) if extract else new.withColumn("error", F.lit(None).cast("string"))
        outcome.write.mode("overwrite").parquet(f"{target}/batch={name}")
        held = s.read.schema(outcome.schema).parquet(f"{target}/batch={name}")
        entry = held.where("error IS NULL").select("key", "domain", "name", F.lit(name).alias("ingested_at")).dropDuplicates(["key"])
        if extract:
            held.where("error IS NULL").select("key", "episode_uuid", "name", "domain", "nodes", "edges", "attempts").write.mode("overwrite").parquet(f"{target}-receipts/batch={name}")
            held.where("error IS NOT NULL").drop("facts", "nodes", "edges").write.mode("overwrite").parquet(f"{target}-failures/batch={name}")
        Ledger(s, ledger).enter(entry, name)
        return held

    tried = None
    if extract and _there(spark, queue):
        failed = spark.read.option("recursiveFileLookup", "true").parquet(queue)
        waiting = resume_plan(failed, Ledger(spark, ledger).entries_of(failed)).dropDuplicates(["key"])
        if not waiting.isEmpty():
            tried = enter(waiting, f"retry-{uuid.uuid4().hex}").select("key")

    def land(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        name = f"{json.loads(s.read.text(f'{checkpoint}/metadata').first()[0])['id']}-{number}"
        held_keys = Ledger(s, ledger)
        held_keys.merge(but=name)
        own = keyed_records(batch, domain)
        new = resume_plan(own, held_keys.entries_of(own, but=name))
        held = enter(new if tried is None else new.join(tried.distinct(), "key", "left_anti"), name)
        if extract:
            new.join(held.where("error IS NOT NULL").select("key").distinct(), "key", "left_semi").write.mode("overwrite").parquet(f"{queue}/batch={name}")

    return records.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_extraction(records: DataFrame, extract: Callable[[dict], tuple[int, list[str]]], path: str, *, allowed: list[str], default: str) -> tuple[dict, DataFrame]:
    """Extract into a snapshot of its own for review, and change nothing else: (header, failures). Records must be of one allowed
    group. Writes the snapshot in parts at ``path``, and its decisions, all open, beside it."""
    from ..operators.review import decision_template, read_parts, typed_records, write_decisions, write_parts

    own = keyed_records(records, default)
    groups = sorted(r["domain"] for r in own.select("domain").distinct().limit(2).collect())
    if len(groups) != 1:
        raise ValueError("a snapshot for review has one group; these are of " + ", ".join(groups))
    if groups[0] not in allowed:
        raise ValueError(f"unknown group: {groups[0]}")
    extract_records(own, extract).write.mode("error").parquet(f"{path}/outcome")
    spark = records.sparkSession
    outcome = spark.read.parquet(f"{path}/outcome")
    fine = outcome.where("error IS NULL").join(own.dropDuplicates(["key"]).select("key", "body"), "key").dropDuplicates(["key"])
    uuid = uuid_of(F.substring(F.sha2(F.concat_ws("\x1f", "key", F.col("pos").cast("string")), 256), 1, 32))
    facts = fine.select("key", "episode_uuid", "domain", F.posexplode("facts").alias("pos", "fact")).select(uuid.alias("uuid"), "fact", F.array("episode_uuid").alias("episodes"), F.col("domain").alias("group_id"), "episode_uuid")
    listed = facts.groupBy(F.col("episode_uuid").alias("uuid")).agg(F.sort_array(F.collect_list("uuid")).alias("entity_edges"))
    episodes = fine.select(F.col("episode_uuid").alias("uuid"), "name", F.col("domain").alias("group_id"), F.col("body").alias("content")).join(listed, "uuid", "left")
    header = write_parts({"episodic_node": episodes, "entity_edge": facts.drop("episode_uuid")}, f"{path}/snapshot", {"groups": groups, "provider": "staged"})
    template = decision_template(typed_records(read_parts(spark, f"{path}/snapshot", header), "entity_edge"))
    write_decisions(template, f"{path}/review", header)
    return header, outcome.where("error IS NOT NULL").drop("facts", "nodes", "edges")


def distinct_records(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of keyed records (key, event_time) without repeats that arrive within the delay."""
    return records.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["key"])


def event_counts(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; late events are taken within the delay."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    out = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


class _Review(StatefulProcessor):
    """Walks a proposal's events by the steps that the batch fold takes. The last step taken and how many events were refused are a state
    each; a claim may have an end, at which a timer hands it back unless it was settled; decided proposals may be forgotten."""

    def __init__(self, claim_ms: int | None, forget_ms: int | None):
        self.claim_ms, self.forget_ms = claim_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, status string", self.forget_ms)
        self.refused = handle.getValueState("refused", "n long", self.forget_ms)
        self.claim = handle.getValueState("claim", "until long")

    def _row(self, key, seq: int | None, status: str, refused: int) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "seq": pd.array([seq], dtype="Int64"), "status": [status or None], "refused": [refused]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, status = self.last.get() if self.last.exists() else (None, "")
        refused = self.refused.get()[0] if self.refused.exists() else 0
        events = sorted((int(s), str(x)) for frame in rows for s, x in zip(frame["seq"], frame["status"], strict=True))
        for at, event in events:
            late = seq is not None and at <= seq
            after = None if late else step(status, event)
            if after is None:
                refused += 1
                continue
            seq, status = at, after
            if self.claim_ms is not None and status == "draining":
                until = timerValues.getCurrentProcessingTimeInMs() + self.claim_ms
                self.claim.update((until,))
                self.handle.registerTimer(until)
            elif self.claim.exists():
                self.handle.deleteTimer(self.claim.get()[0])
                self.claim.clear()
        if seq is not None:
            self.last.update((seq, status))
        self.refused.update((refused,))
        yield self._row(key, seq, status, refused)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.claim.exists() or not self.last.exists():
            return
        seq, status = self.last.get()
        self.claim.clear()
        if status == "draining":
            self.last.update((seq, "approved"))
            yield self._row(key, seq, "approved", self.refused.get()[0])

    def close(self) -> None:
        pass


def proposal_states(log: DataFrame, *, claim_ms: int | None = None, forget_ms: int | None = None) -> DataFrame:
    """A stream of (id, seq, status) events -> each proposal's state after every batch, as ``workflow.folded_states`` has it of the same log.
    An event that comes after a later one of its proposal is refused. claim_ms: a claim that is not settled in so many milliseconds is
    handed back; forget_ms: a proposal without events for so long is forgotten. Needs the RocksDB state store."""
    mode = "none" if claim_ms is None and forget_ms is None else "processingTime"
    ship(log.sparkSession)
    return log.groupBy("id").transformWithStateInPandas(_Review(claim_ms, forget_ms), "id string, seq long, status string, refused long", "update", mode)
