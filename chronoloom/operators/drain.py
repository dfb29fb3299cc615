"""The queue's life as transformations of tables: filing, decisions, claims, landing, archive.

A queue is a DataFrame with the columns of ``views.PROPOSAL``. Every step takes one and returns new ones; ``drain_store`` commits them to a
store, so a reader sees a step whole or not at all.
"""

from __future__ import annotations

import contextlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import content_digest
from ..functions.text import secret_shapes, strip
from ..sources.commits import Transaction, put_if_absent, read_text
from ..sources.store import Store, written
from .gates import EXIT, ApproveRule, approving_rule, binding_error, decidable, gate_codes
from .reads import in_groups
from .workflow import clean_reason, episodes_to_land, mark_retired

NO_FACTS = "no facts were found in it"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def file_proposals(proposals: DataFrame, now: Column, *, rejected: DataFrame | None = None, rules: list[ApproveRule] | None = None, **gates) -> tuple[DataFrame, DataFrame]:
    """(queue rows, refused rows): what passes all gates, pending or approved by the first rule that does, bound to the digest of
    its content; and what does not, with exit_code, refusal, secrets, n_sentences and resembles."""
    facts = F.filter(F.transform("facts", strip), lambda t: t != "")
    own = gate_codes(proposals.withColumn("facts", facts), rejected, **gates)
    refused = own.where("exit_code <> 0")
    fine = own.where("exit_code = 0").drop("exit_code", "refusal", "secrets", "n_sentences", "resembles", "ratio")
    fine = fine.withColumn("text", F.array_join("facts", " | ")).withColumn("facts", F.when(F.size("facts") > 1, F.col("facts"))).withColumn("supersedes", F.coalesce("supersedes", F.lit("")))
    fine = approving_rule(fine, rules or [])
    digest = content_digest(fine.columns)
    approved = F.col("rule").isNotNull()
    fine = fine.withColumn("approved_digest", F.when(approved, digest)).withColumn("decided_by", F.col("rule")).withColumn("decided_at", F.when(approved, now))
    return fine.withColumn("status", F.when(approved, "approved").otherwise("pending")).drop("rule"), refused


def file_retirements(named: DataFrame, now: Column, *, require_source: bool = False) -> tuple[DataFrame, DataFrame]:
    """(queue rows, refused rows) of retirements (id, domain, edges, reason, provenance, source, link): facts to end, without
    a replacement. One that names no fact or gives no reason, or has a secret's shape, is refused."""
    edges = F.array_distinct(F.filter(F.transform("edges", strip), lambda e: e != ""))
    own = named.withColumn("edges", edges).withColumn("text", clean_reason(F.col("reason"))).drop("reason")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    refusal = F.when(F.size("edges") <= 0, "edges").when(F.col("text").isNull(), "reason").when(F.lit(require_source) & (blank("source") | blank("link")), "source_required")
    secrets = secret_shapes(*[F.col(c) for c in ("text", "provenance", "source", "link")])
    code = F.when(refusal.isNotNull(), EXIT["rejected"]).when(F.size(secrets) > 0, EXIT["secret"]).otherwise(0)
    own = own.withColumn("refusal", refusal).withColumn("exit_code", code)
    fine = own.where("exit_code = 0").drop("exit_code", "refusal")
    return fine.withColumn("operation", F.lit("retire")).withColumn("fact_type", F.lit("action-record")).withColumn("supersedes", F.lit("")).withColumn("status", F.lit("pending")).withColumn("created_at", now), own.where("exit_code <> 0")


def decide(queue: DataFrame, ids: DataFrame, status: str, now: Column, *, reason: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queue, rows for the archive, (id, changed)): the named proposals (id) approved, bound to what they say now, or rejected, which
    takes any approval back and moves them to the archive. What can no longer be decided stays, and is not changed."""
    if status not in ("approved", "rejected"):
        raise ValueError(f"not a decision: {status}")
    named = ids.select("id").distinct().withColumn("_named", F.lit(True))
    own = queue.join(named, "id", "left").withColumn("_takes", F.coalesce("_named", F.lit(False)) & decidable(status))
    takes = F.col("_takes")
    if status == "approved":
        own = own.withColumn("approved_digest", F.when(takes, content_digest(queue.columns)).otherwise(F.col("approved_digest")))
    else:
        own = own.withColumn("approved_digest", F.when(~takes, F.col("approved_digest"))).withColumn("decided_by", F.when(takes, F.lit("reviewer")).otherwise(F.col("decided_by")))
        own = own.withColumn("reason", F.when(takes, clean_reason(F.lit(reason))).otherwise(F.col("reason")))
    own = own.withColumn("status", F.when(takes, status).otherwise(F.col("status"))).withColumn("decided_at", F.when(takes, now).otherwise(F.col("decided_at")))
    changed = named.select("id").join(own.where("_takes").select("id", F.lit(True).alias("_c")), "id", "left").select("id", F.coalesce("_c", F.lit(False)).alias("changed"))
    moves = takes if status == "rejected" else F.lit(False)
    return own.where(~moves).select(*queue.columns), own.where(moves).select(*queue.columns), changed


def _unlanded() -> Column:
    return F.coalesce(F.size("landed"), F.lit(0)) <= 0


def _released(draining_at: Column, fails: Column) -> Column:
    """The claim of a proposal after a drain: handed back where it fails, unless something of it landed."""
    stale = (F.col("status") == "approved") & draining_at.isNotNull() & _unlanded() & fails
    return F.when(~F.coalesce(stale, F.lit(False)), draining_at)


def release(queue: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The queue with claims handed back, of all (what a drain that stopped left) or of the given ids; what landed in part keeps its claim,
    as it must not be rejected any more."""
    named = F.lit(True)
    if only is not None:
        queue = queue.join(only.select("id").distinct().withColumn("_only", F.lit(True)), "id", "left")
        named = F.col("_only")
    return queue.withColumn("draining_at", _released(F.col("draining_at"), named)).drop("_only")


def claim(queue: DataFrame, now: Column) -> DataFrame:
    """The queue with what is approved, and still says what was approved, claimed for a drain."""
    ready = (F.col("status") == "approved") & binding_error(queue.columns).isNull()
    return queue.withColumn("draining_at", F.when(F.coalesce(ready, F.lit(False)), F.coalesce("draining_at", now)).otherwise(F.col("draining_at")))


def planned(queue: DataFrame) -> DataFrame:
    """What a drain would do: (id, index, domain, body, valid_at, binding, decided_by), a row for each fact to land and each retirement."""
    approved = queue.where("status = 'approved'").withColumn("binding", F.coalesce(binding_error(queue.columns), F.lit("ok")))
    own = approved.select("id", "binding", F.coalesce("decided_by", F.lit("reviewer")).alias("decided_by"))
    facts = episodes_to_land(approved).select("id", "index", "domain", "body", "valid_at")
    body = F.concat(F.lit("retire "), F.array_join("edges", ", "), F.lit(": "), F.col("text"))
    ends = approved.where("operation = 'retire'").select("id", F.lit(0).alias("index"), "domain", body.alias("body"), "valid_at")
    return facts.unionByName(ends).join(own, "id")


@dataclass(frozen=True)
class Drained:
    """queue and archived rows after a drain; facts with what was retired; failures (id, domain, index, error); summary, one row."""

    queue: DataFrame
    archived: DataFrame
    facts: DataFrame
    failures: DataFrame
    summary: DataFrame


def land_claimed(queue: DataFrame, land: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, index, episode_uuid, edges, error) of what is claimed and still says what was approved, written: ``land``, which may ask a
    model, is called once for each fact, however often its outcome is read."""
    return _landed(queue.where("draining_at IS NOT NULL"), land)


def _landed(queue: DataFrame, land: Callable[[DataFrame], DataFrame]) -> DataFrame:
    ready = queue.where("status = 'approved'").where(binding_error(queue.columns).isNull())
    return written(land(episodes_to_land(ready)).select("id", "index", "episode_uuid", "edges", "error"), "landed")


def drain(queue: DataFrame, facts: DataFrame, land: Callable[[DataFrame], DataFrame], now: Column, at: Column) -> Drained:
    """Claim, land and settle all that is approved. ``land`` takes episodes (id, index, name, body, domain, valid_at, provenance) and
    returns (id, index, episode_uuid, edges, error). ``now`` is text for the queue, ``at`` an instant for facts."""
    held = _held(claim(release(queue), now))
    return _settled(queue, held, facts, _landed(queue, land), now, at)  # whatever is approved and bound is claimed


def drain_store(store: Store, land: Callable[[DataFrame], DataFrame], now: Column, at: Column) -> Row:
    """A drain of a store, as its one drain (``only_drain``): the claim is committed before anything lands, so that no reviewer
    rejects what is landing; what landed is settled against the queue as it is then, anew if another commit comes between.
    Returns the summary (completed, failed)."""
    store.change(lambda t: t.write("queue", claim(release(t.read("queue")), now)), "claim")
    outcome = land_claimed(store.read("queue"), land)

    def finish(t: Transaction) -> Row:
        done = settle(t.read("queue"), t.read("entity_edge"), outcome, now, at)
        t.write("queue", done.queue)
        t.write("archive", t.read("archive").unionByName(done.archived))
        t.write("entity_edge", done.facts)
        return done.summary.first()

    return store.change(finish, "drain")


def settle(queue: DataFrame, facts: DataFrame, outcome: DataFrame, now: Column, at: Column) -> Drained:
    """What a claimed queue and the facts are after its facts landed with that outcome (a written table, as it is read several times).

    A fact has landed if there was no error and it gave at least one edge. A proposal of which all facts landed goes to the
    archive; of one that failed in part, what landed is recorded and the rest stays approved for the next drain; one that
    failed whole is released. A retirement is done whole or not at all. Ids are unique; approved rows that share one share its outcome."""
    return _settled(queue, _held(queue), facts, outcome, now, at)


def _held(queue: DataFrame) -> DataFrame:
    """Of what is approved, all that settling asks for but no texts, written: the digest of a proposal is computed once, and neither
    joins nor tables between them carry its content."""
    approved, retires = queue.where("status = 'approved'"), F.col("operation") == "retire"
    n = F.when(F.coalesce(F.size("facts"), F.lit(0)) > 0, F.size("facts")).otherwise(1)
    own = approved.select("id", "domain", "valid_at", "landed", "draining_at", retires.alias("_retires"), F.when(retires, F.col("edges")).alias("edges"), n.alias("_n"), binding_error(queue.columns).alias("_error"))
    return written(own, "held")


def _settled(queue: DataFrame, held: DataFrame, facts: DataFrame, outcome: DataFrame, now: Column, at: Column) -> Drained:
    """``held`` says what is claimed, whatever the queue says of it."""
    ready = held.where("draining_at IS NOT NULL AND _error IS NULL")
    error = F.coalesce("error", F.when(F.coalesce(F.col("edges"), F.lit(0)) <= 0, F.lit(NO_FACTS)))
    outcome = outcome.join(ready.select("id", "domain"), "id").select("id", "domain", "index", "episode_uuid", error.alias("error"))
    good = F.when(F.col("error").isNull(), F.struct("index", "episode_uuid"))
    by_id = outcome.groupBy("id").agg(F.sort_array(F.collect_list(good)).alias("_got"), F.count("error").alias("_failed"))

    ends = ready.where("_retires").select("id", "domain", F.explode("edges").alias("uuid"))
    known = in_groups(facts, None).select("uuid", F.coalesce("group_id", F.lit("")).alias("_group"), F.col("invalid_at").isNotNull().alias("_ended"))
    met = ends.join(known, "uuid", "left").withColumn("_here", F.col("_group").isNotNull() & ((F.col("_group") == F.col("domain")) | (F.col("_group") == "")))
    mine = lambda c: F.array_sort(F.array_compact(F.collect_list(F.when(c, F.col("uuid")))))
    per = met.groupBy("id").agg(mine(~F.col("_here")).alias("_missing"), mine(F.col("_here") & ~F.col("_ended")).alias("_open"), mine(F.col("_here") & F.col("_ended")).alias("_over"))

    own = held.join(by_id, "id", "left").join(per, "id", "left")
    found, touched = F.size("_missing") == 0, F.size("_got") > 0
    landed = F.when(touched, F.array_union(F.coalesce("landed", F.array().cast("array<int>")), F.transform("_got", lambda x: x["index"])))
    whole = F.when(F.col("_retires"), F.coalesce(found, F.lit(False))).otherwise(F.coalesce(F.size(F.coalesce(landed, F.col("landed"))), F.lit(0)) >= F.col("_n"))
    done = F.col("draining_at").isNotNull() & F.col("_error").isNull() & whole
    lost = F.coalesce(F.size("_missing") > 0, F.lit(False))
    fails = F.col("_error").isNotNull() | (F.coalesce("_failed", F.lit(0)) > 0) | lost
    own = own.select(
        "id", "domain", "valid_at", "edges", "_error", F.col("draining_at").alias("_claim"), landed.alias("_landed"), F.when(touched, F.transform("_got", lambda x: x["episode_uuid"])).alias("_episodes"),
        F.when(lost, F.col("_missing")).alias("_lost"), F.when(found, F.col("_open")).alias("_open"), F.when(found, F.col("_over")).alias("_over"), F.coalesce(done, F.lit(False)).alias("_done"), fails.alias("_fails"),
    )
    own = written(own.dropDuplicates(["id"]), "settled")

    failure = lambda df, index, error: df.select("id", "domain", index.alias("index"), error.alias("error"))
    failures = failure(own.where("_error IS NOT NULL"), _null("int"), F.col("_error")).unionByName(failure(outcome.where("error IS NOT NULL"), F.col("index") + 1, F.col("error")))
    failures = failures.unionByName(failure(own.where("_lost IS NOT NULL"), _null("int"), F.concat(F.lit("facts not found: "), F.array_join("_lost", ", "))))

    verdicts = own.select("id", "_claim", "_landed", "_episodes", "_open", "_over", "_done", "_fails")
    after = queue.join(verdicts, "id", "left")
    approved = F.col("status") == "approved"
    after = after.withColumn("landed", F.coalesce("_landed", F.col("landed"))).withColumn("episodes", F.when(F.col("_episodes").isNotNull(), F.concat(F.coalesce("episodes", F.array().cast("array<string>")), "_episodes")).otherwise(F.col("episodes")))
    after = after.withColumn("retired", F.coalesce("_open", F.col("retired"))).withColumn("already_invalid", F.coalesce("_over", F.col("already_invalid")))
    after = after.withColumn("draining_at", F.when(approved, F.col("_claim")).otherwise(F.col("draining_at")))
    gone = F.coalesce(approved & F.col("_done"), F.lit(False))
    archived = after.where(gone).withColumn("drained_at", now).select(*queue.columns)
    left = after.where(~gone).withColumn("draining_at", _released(F.col("draining_at"), F.col("_fails"))).select(*queue.columns)

    ended = own.where("_done AND _open IS NOT NULL").select("valid_at", F.explode("edges").alias("uuid")).groupBy("uuid").agg(F.min("valid_at").alias("_valid_at"))
    changed = mark_retired(facts.join(ended, "uuid", "left"), ended.select("uuid"), ended=F.coalesce(F.to_timestamp("_valid_at").cast(dict(facts.dtypes)["invalid_at"]), at), now=at).drop("_valid_at", "outcome")
    summary = own.agg(F.count_if("_done").alias("completed")).select("completed", failures.agg(F.count(F.lit(1)).alias("n")).scalar().alias("failed"))
    return Drained(left, archived, changed, failures, summary)


@contextlib.contextmanager
def only_drain(spark: SparkSession, lock: str, lease: float = 3600.0) -> Iterator[bool]:
    """Whether this is the one drain of a workspace: the holder of the last of numbered leases, in a folder that all share. A lease ends
    when it is given back, or, if its driver died, ``lease`` seconds after it began: what it claimed and did not land
    is then the next drain's. Each number can be put once, so of several that follow an ended lease one gets the next."""
    names = _names(spark, lock)
    number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)
    if number and f"{number}.done" not in names:
        held = json.loads(read_text(spark, f"{lock}/{number}.json"))
        if held["until"] > time.time():
            yield False
            return
    mine = f"{lock}/{number + 1}"
    if not put_if_absent(spark, f"{mine}.json", json.dumps({"owner": spark.sparkContext.applicationId, "until": time.time() + lease})):
        yield False
        return
    try:
        yield True
    finally:
        put_if_absent(spark, f"{mine}.done", "")


def _names(spark: SparkSession, folder: str) -> set[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()
