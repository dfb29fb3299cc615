"""The reviewed write path as transformations of tables: states, episodes to land, resumption, retirement, retraction."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import record_key, uuid_of
from ..functions.text import correction_body, provenance_line, strip
from .reads import episode_edges, in_groups


#: The steps that a proposal may take from each state; "" is before it was filed. Nothing leads out of the last two.
STEPS = {
    "": ("pending", "approved"), "pending": ("approved", "rejected"), "approved": ("rejected", "draining"), "draining": ("approved", "archived"),
    "rejected": (), "archived": (),
}
STATES, RUN = tuple(STEPS), 4096


def step(state: str, status: str) -> str | None:
    """The state after an event; None if it is refused."""
    return status if status in STEPS[state] else None


def _after(was: Column, status: Column) -> Column:
    """Whether an event is a step that leads on from a state."""
    return functools.reduce(Column.__or__, [(was == s) & status.isin(list(to)) for s, to in STEPS.items() if to])


def folded_states(log: DataFrame, *, run: int = RUN) -> DataFrame:
    """An event log (id, seq, status) -> (id, seq, status, refused): each proposal's state, the event that led to it, and how many
    events were no step from the state that they met. Before the first step the status is null.

    What a run of events does is a function from the state before it to the state after it, so runs of at most ``run``
    numbers are each made such a function, wherever they are, and only these are put together by id: no task holds all
    events of a proposal, however many it has."""
    at = lambda s, seq, refused: F.struct(s.alias("status"), seq.alias("seq"), refused.alias("refused"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    start = F.array(*[at(F.lit(s), none, zero) for s in STATES])
    events = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), F.col("status"))))
    runs = log.groupBy("id", F.floor(F.col("seq") / run).alias("run")).agg(events.alias("events"))
    taken = lambda x, e: F.when(F.coalesce(_after(x["status"], e["status"]), F.lit(False)), at(e["status"], e["seq"], x["refused"])).otherwise(at(x["status"], x["seq"], x["refused"] + 1))
    runs = runs.select("id", "run", F.aggregate("events", start, lambda acc, e: F.transform(acc, lambda x: taken(x, e))).alias("does"))
    place = F.create_map(*[F.lit(x) for i, s in enumerate(STATES) for x in (s, i)])
    then = lambda acc, does: F.transform(F.array(F.element_at(does, F.element_at(place, acc["status"]) + 1)), lambda y: at(y["status"], F.coalesce(y["seq"], acc["seq"]), acc["refused"] + y["refused"]))[0]
    whole = runs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "does"))), lambda r: r["does"]).alias("runs"))
    last = whole.select("id", F.aggregate("runs", at(F.lit(""), none, zero), then).alias("r"))
    return last.select("id", "r.seq", F.nullif(F.col("r.status"), F.lit("")).alias("status"), "r.refused")


def episodes_to_land(approved: DataFrame) -> DataFrame:
    """A row for each fact of an approved proposal that has not landed: (id, index, name, body, domain, valid_at, provenance)."""
    texts = F.when(F.coalesce(F.size("facts"), F.lit(0)) > 0, F.col("facts")).otherwise(F.array("text"))
    own = approved.where("operation <> 'retire'").withColumn("_n", F.size(texts)).select("*", F.posexplode(texts).alias("index", "fact"))
    own = own.where(~F.coalesce(F.array_contains("landed", F.col("index")), F.lit(False)))
    name = F.concat(F.lit("workspace "), F.col("id"), F.when(F.col("_n") > 1, F.concat(F.lit(" #"), (F.col("index") + 1).cast("string"))).otherwise(""))
    at = F.coalesce(F.when(F.col("valid_at") != "", F.col("valid_at")), F.col("created_at"))
    line = provenance_line(*[F.col(c) for c in ("fact_type", "provenance", "source", "link", "learned_at", "said")])
    body = correction_body(F.col("operation"), F.col("fact"), F.col("valid_at"), F.col("created_at"), F.col("supersedes"))
    return own.select("id", "index", name.alias("name"), body.alias("body"), "domain", at.alias("valid_at"), line.alias("provenance"))


def keyed_records(records: DataFrame, default_domain: str) -> DataFrame:
    """records (name, body, domain, valid_at) with domain filled in, key and episode_uuid."""
    domain = F.coalesce(F.when(F.col("domain") != "", F.col("domain")), F.lit(default_domain))
    own = records.withColumn("domain", domain)
    own = own.withColumn("key", record_key(F.col("domain"), F.col("name"), F.col("body"), F.col("valid_at")))
    return own.withColumn("episode_uuid", uuid_of(F.col("key")))


def resume_plan(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """Records whose key the ledger does not have; repeated ones within a batch stay, under one episode."""
    return records.join(ledger.select("key").distinct(), "key", "left_anti")


def land_summary(outcome: DataFrame) -> DataFrame:
    """(domain, ingested, failed, without_facts) of landing outcomes (domain, error, edges)."""
    return outcome.groupBy("domain").agg(
        F.count_if(F.col("error").isNull()).alias("ingested"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error").isNull() & (F.col("edges") == 0)).alias("without_facts")
    )


def retire(facts: DataFrame, named: DataFrame, *, groups: list[str] | None, ended: Column, now: Column) -> DataFrame:
    """facts with the named (uuid) ones ended. All or nothing: a name that the groups do not have is an error. Facts that
    have an end already, even one ahead, are left as they are. ``outcome`` tells retired from already_invalid."""
    named = named.select("uuid").distinct()
    missing = named.join(in_groups(facts, groups, or_none=True), "uuid", "left_anti").orderBy("uuid").limit(5).collect()
    if missing:
        raise ValueError("facts not found: " + ", ".join(r["uuid"] for r in missing))
    return mark_retired(facts, named, ended=ended, now=now)


def mark_retired(facts: DataFrame, named: DataFrame, *, ended: Column, now: Column) -> DataFrame:
    own = facts.join(named.withColumn("_named", F.lit(True)), "uuid", "left")
    takes = F.coalesce("_named", F.lit(False)) & F.col("invalid_at").isNull()
    outcome = F.when(takes, "retired").when(F.col("_named"), "already_invalid")
    expired = F.when(takes, now).otherwise(F.col("expired_at") if "expired_at" in facts.columns else F.lit(None).cast(dict(facts.dtypes)["invalid_at"]))
    return own.withColumn("outcome", outcome).withColumn("expired_at", expired).withColumn("invalid_at", F.when(takes, ended).otherwise(F.col("invalid_at"))).drop("_named")


def retraction(episodes: DataFrame, facts: DataFrame, now: Column, groups: list[str] | None = None) -> DataFrame:
    """What to do with the current facts of a proposal's episodes: retire those that rest on them alone, keep the others."""
    return episode_edges(episodes, facts, now, groups).withColumn("action", F.when(F.col("only"), "retire").otherwise("keep"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "uuid") -> DataFrame:
    """new rows in place of existing ones with their key."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def clean_reason(reason: Column) -> Column:
    return F.nullif(strip(reason), F.lit(""))
