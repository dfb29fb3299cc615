"""The queue's life, extraction, review files, stores, settings and the first answer."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from chronoloom import output, settings
from chronoloom.functions import text
from chronoloom.operators import checks, drain, gates, metadata, reads, review, search, workflow
from chronoloom.plans import demo
from chronoloom.sources import records, store
from chronoloom.sources.views import FACT, PROPOSAL
from chronoloom.streaming import ingest



def now():
    return F.lit("2024-02-01T00:00:00Z")


def at():
    return F.lit("2024-02-01").cast("timestamp")


def proposals(spark, *rows):
    base = dict.fromkeys(PROPOSAL.fieldNames())
    df = spark.createDataFrame([base | {"domain": "g", "fact_type": "source-fact", "operation": "assert", "created_at": "2024-01-01", "text": "t", "supersedes": ""} | r for r in rows], PROPOSAL)
    return df


def approved(spark, *rows):
    from chronoloom.functions.identity import content_digest

    q = proposals(spark, *[{"status": "approved"} | r for r in rows])
    return q.withColumn("approved_digest", F.coalesce("approved_digest", content_digest(q.columns)))


def facts_of(spark, *rows):
    base = dict.fromkeys(FACT.fieldNames())
    return spark.createDataFrame([base | {"group_id": "g"} | r for r in rows], FACT)


# ---------------------------------------------------------------- filing and decisions


def test_filing(spark):
    rows = [
        {"id": "a", "facts": [" One fact. ", " "], "source": "s", "link": "l"}, {"id": "b", "facts": ["One. Two"]}, {"id": "c", "facts": []},
        {"id": "d", "facts": ["x uses y", "y uses z"], "provenance": "doc"}, {"id": "e", "facts": ["the password is hunter2hunter2"]}, {"id": "f", "facts": ["uses MongoDB now."]},
        {"id": "h", "facts": ["uses MongoDB now."], "supersedes_rejection": "r1"},
    ]
    rejected = proposals(spark, {"id": "r1", "facts": ["uses MongoDB now"], "status": "rejected"})
    queue, refused = drain.file_proposals(proposals(spark, *rows).drop("status", "approved_digest", "decided_at", "decided_by"), now(), rejected=rejected, rules=[gates.ApproveRule("source-fact", "source-link")])
    assert {r["id"]: (r["status"], r["decided_by"], r["text"], r["facts"]) for r in queue.collect()} == {
        "a": ("approved", "policy:source-fact:source-link", "One fact.", None), "d": ("pending", None, "x uses y | y uses z", ["x uses y", "y uses z"]), "h": ("pending", None, "uses MongoDB now.", None)}
    assert {r["id"]: r["exit_code"] for r in refused.collect()} == {"b": 4, "c": 2, "e": 6, "f": 5}
    assert queue.where("status = 'approved'").select(gates.binding_error(queue.columns).alias("e")).first()["e"] is None


def test_filing_retirements(spark):
    rows = [("a", "g", [" e1", "e1", "e2"], "wrong", "", "", ""), ("b", "g", [" "], "r", "", "", ""), ("c", "g", ["e"], " ", "", "", ""), ("d", "g", ["e"], "secret: abcdefgh1", "", "", "")]
    df = spark.createDataFrame(rows, "id string, domain string, edges array<string>, reason string, provenance string, source string, link string")
    queue, refused = drain.file_retirements(df, now())
    assert [(r["id"], r["edges"], r["operation"], r["text"]) for r in queue.collect()] == [("a", ["e1", "e2"], "retire", "wrong")]
    assert {r["id"]: (r["refusal"], r["exit_code"]) for r in refused.collect()} == {"b": ("edges", 2), "c": ("reason", 2), "d": (None, 6)}
    assert drain.file_retirements(df, now(), require_source=True)[0].isEmpty()


def test_decisions(spark):
    queue = proposals(spark, {"id": "p", "status": "pending"}, {"id": "c", "status": "approved", "approved_digest": "x", "draining_at": "t"}, {"id": "l", "status": "approved", "approved_digest": "x", "landed": [0]}, {"id": "o", "status": "approved", "approved_digest": "x", "decided_by": "policy"})
    ids = spark.createDataFrame([(x,) for x in "pclo?"], "id string")
    left, gone, changed = drain.decide(queue, ids, "rejected", now(), reason=" no ")
    assert sorted(r["id"] for r in left.collect()) == ["c", "l"]
    assert {r["id"]: (r["status"], r["approved_digest"], r["decided_by"], r["reason"]) for r in gone.collect()} == {i: ("rejected", None, "reviewer", "no") for i in "po"}
    assert {r["id"]: r["changed"] for r in changed.collect()} == {"p": True, "o": True, "c": False, "l": False, "?": False}
    left, gone, changed = drain.decide(queue, ids, "approved", now())
    assert gone.isEmpty() and [r["id"] for r in changed.where("changed").collect()] == ["p"]
    assert left.where("id = 'p'").select(gates.binding_error(left.columns).alias("e"), "status").first() == (None, "approved")
    with pytest.raises(ValueError):
        drain.decide(queue, ids, "pending", now())


# ---------------------------------------------------------------- drain


def land_with(spark, outcomes):
    """Landing as a table: (id, index) -> (edges, error)."""

    def land(episodes):
        rows = [(r["id"], r["index"], f"ep-{r['id']}-{r['index']}", *outcomes[r["id"], r["index"]]) for r in episodes.collect()]
        return spark.createDataFrame(rows, "id string, index int, episode_uuid string, edges int, error string")

    return land


def test_drain_lands_retires_and_keeps_the_rest(spark):
    queue = approved(
        spark, {"id": "one"}, {"id": "part", "facts": ["f0", "f1"], "provenance": "d"}, {"id": "none"}, {"id": "bad"}, {"id": "changed", "approved_digest": "sha256:old"}, {"id": "again", "facts": ["f0", "f1"], "landed": [0], "episodes": ["ep0"], "draining_at": "t0"},
        {"id": "end", "operation": "retire", "edges": ["e1", "e2"], "valid_at": "2024-01-10"}, {"id": "lost", "operation": "retire", "edges": ["e3", "e9"]}, {"id": "stale", "draining_at": "t0"}, {"id": "wait", "status": "pending"},
    )
    ended = datetime.datetime(2023, 1, 1)
    facts = facts_of(spark, {"uuid": "e1"}, {"uuid": "e2", "invalid_at": ended}, {"uuid": "e3"}, {"uuid": "e4"})
    outcomes = {("one", 0): (2, None), ("part", 0): (1, None), ("part", 1): (0, "boom"), ("none", 0): (0, None), ("bad", 0): (0, "boom"), ("again", 1): (3, None), ("stale", 0): (1, None)}
    assert {r["id"]: r["binding"] for r in drain.planned(queue).collect()} == {"one": "ok", "part": "ok", "none": "ok", "bad": "ok", "changed": "mismatch", "again": "ok", "end": "ok", "lost": "ok", "stale": "ok"}
    assert [r["body"] for r in drain.planned(queue).where("id = 'end'").collect()] == ["retire e1, e2: t"]
    got = drain.drain(queue, facts, land_with(spark, outcomes), now(), at())
    archived = {r["id"]: r for r in got.archived.collect()}
    assert set(archived) == {"one", "again", "end", "stale"} and all(r["drained_at"] for r in archived.values())
    assert archived["again"]["episodes"] == ["ep0", "ep-again-1"] and archived["again"]["landed"] == [0, 1]
    assert (archived["end"]["retired"], archived["end"]["already_invalid"]) == (["e1"], ["e2"])
    left = {r["id"]: r for r in got.queue.collect()}
    assert set(left) == {"part", "none", "bad", "changed", "lost", "wait"}
    assert left["part"]["landed"] == [0] and left["part"]["draining_at"] is not None
    assert all(left[i]["draining_at"] is None for i in ("none", "bad", "changed", "lost", "wait"))
    errors = {(r["id"], r["index"]): r["error"] for r in got.failures.collect()}
    assert errors == {("part", 2): "boom", ("none", 1): drain.NO_FACTS, ("bad", 1): "boom", ("changed", None): "mismatch", ("lost", None): "facts not found: e9"}
    after = {r["uuid"]: r for r in got.facts.collect()}
    assert after["e1"]["invalid_at"] == datetime.datetime(2024, 1, 10) and after["e1"]["expired_at"] == datetime.datetime(2024, 2, 1)
    assert after["e2"]["invalid_at"] == ended and after["e3"]["invalid_at"] is None and after["e4"]["invalid_at"] is None and len(after) == 4
    assert got.summary.first().asDict() == {"completed": 4, "failed": 5}


def test_release_and_claim(spark):
    queue = approved(spark, {"id": "a", "draining_at": "t"}, {"id": "b", "draining_at": "t", "landed": [0]}, {"id": "c"}, {"id": "d", "status": "pending"})
    held = lambda q: {r["id"]: r["draining_at"] for r in q.collect()}
    assert held(drain.release(queue)) == {"a": None, "b": "t", "c": None, "d": None}
    assert held(drain.release(queue, spark.createDataFrame([("c",)], "id string"))) == {"a": "t", "b": "t", "c": None, "d": None}
    assert held(drain.claim(queue, now())) == {"a": "t", "b": "t", "c": "2024-02-01T00:00:00Z", "d": None}


def test_one_drain_at_a_time(spark, tmp_path):
    lock = f"file://{tmp_path}/lock"
    with drain.only_drain(spark, lock) as mine:
        assert mine
        with drain.only_drain(spark, lock) as other:
            assert not other
    with drain.only_drain(spark, lock) as mine:
        assert mine


def test_a_dead_drains_lease_ends(spark, tmp_path):
    lock = f"file://{tmp_path}/lock"
    dead = drain.only_drain(spark, lock, lease=0.0)
    assert dead.__enter__()  # and its driver is gone
    with drain.only_drain(spark, lock) as mine:
        assert mine
        with drain.only_drain(spark, lock) as other:
            assert not other


def counted(spark, tmp_path, error=None):
    """Landing in a UDF that leaves a file for every call."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def land(episodes):
        def one(i, n):
            import pathlib
            import uuid

            (pathlib.Path(str(calls)) / f"{i}-{n}-{uuid.uuid4().hex}").touch()
            return 1

        return episodes.select("id", "index", F.col("id").alias("episode_uuid"), F.udf(one, "int")("id", "index").alias("edges"), F.lit(error).cast("string").alias("error"))

    return land, lambda: sorted(p.name.rsplit("-", 1)[0] for p in calls.iterdir())


def test_each_fact_lands_once(spark, tmp_path):
    """However many of a drain's outputs are read."""
    land, calls = counted(spark, tmp_path)
    queue = approved(spark, {"id": "a"}, {"id": "b", "facts": ["f0", "f1"], "provenance": "d"}, {"id": "c", "status": "pending"})
    got = drain.drain(queue, facts_of(spark, {"uuid": "e"}), land, now(), at())
    for df in (got.queue, got.archived, got.facts, got.failures, got.summary, got.archived):
        df.collect()
    assert calls() == ["a-0", "b-0", "b-1"]


def test_drain_of_a_store(spark, tmp_path):
    """The claim is there before anything lands, so a rejection made meanwhile is refused; another commit is kept."""
    s = store.Store(spark, f"file://{tmp_path}/graph")
    s.set_up()
    s.write_all({"queue": approved(spark, {"id": "a"}, {"id": "end", "operation": "retire", "edges": ["e1"], "valid_at": "2024-01-10"}, {"id": "p", "status": "pending"}), "entity_edge": facts_of(spark, {"uuid": "e1"}, {"uuid": "e2"})})
    land, calls = counted(spark, tmp_path)
    seen = []

    def meanwhile(episodes):
        queue = s.read("queue")
        seen.append({r["id"]: r["draining_at"] for r in queue.collect()})
        ids = spark.createDataFrame([("a",), ("p",)], "id string")
        left, gone, changed = drain.decide(queue, ids, "rejected", now(), reason="no")
        seen.append({r["id"]: r["changed"] for r in changed.collect()})
        s.write_all({"queue": left, "archive": gone})
        return land(episodes)

    assert drain.drain_store(s, meanwhile, now(), at()).asDict() == {"completed": 2, "failed": 0}
    assert seen == [{"a": "2024-02-01T00:00:00Z", "end": "2024-02-01T00:00:00Z", "p": None}, {"a": False, "p": True}] and calls() == ["a-0"]
    assert s.read("queue").isEmpty() and {r["id"]: r["status"] for r in s.read("archive").collect()} == {"a": "approved", "end": "approved", "p": "rejected"}
    assert {r["uuid"]: r["invalid_at"] is not None for r in s.read("entity_edge").collect()} == {"e1": True, "e2": False}


def test_queue_readers(spark):
    queue = proposals(spark, {"id": "a", "status": "pending"}, {"id": "b", "status": "pending", "domain": "h"}, {"id": "c", "status": "approved"})
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(records.queued(queue)) == ["a", "b"] and ids(records.queued(queue, ["g"])) == ["a"] and ids(records.queued(queue, status="approved")) == ["c"]
    archive = proposals(spark, {"id": "x", "status": "approved", "episodes": ["e"]}, {"id": "y", "status": "approved", "episodes": []}, {"id": "z", "status": "approved", "operation": "retire", "episodes": ["e"]})
    assert ids(records.landed_proposal(archive, "x")) == ["x"]
    for i in "yzq":
        with pytest.raises(ValueError):
            records.landed_proposal(archive, i)


def test_ranked_matches(spark):
    rejected = proposals(spark, *[{"id": f"r{i}", "text": f"text {i}", "decided_at": str(i % 3), "reason": "why"} for i in range(7)])
    matches = spark.createDataFrame([("p", "t", f"r{i}", 0.8 if i < 6 else 0.9) for i in range(7)], "id string, text string, rejected_id string, ratio double")
    got = gates.ranked_matches(matches, rejected, 5).orderBy("place").collect()
    assert [r["rejected_id"] for r in got] == ["r6", "r2", "r5", "r1", "r4"]


# ---------------------------------------------------------------- extraction


class Slow(ConnectionResetError):
    pass


def flaky(row):
    if row["name"] == "never":
        raise Slow("gone")
    if row["name"] == "wrong":
        raise KeyError("field")
    return 2, [f"{row['body']} {i}" for i in range(int(row["body"][-1]))]


def test_extraction_isolates_records(spark, tmp_path):
    rows = [("a", "b2", "", None, None), ("never", "b1", "d", None, None), ("wrong", "b1", "d", None, None), ("empty", "b0", "d", None, None)]
    own = workflow.keyed_records(spark.createDataFrame(rows, "name string, body string, domain string, valid_at string, provenance string"), "d")
    got = {r["name"]: r for r in ingest.extract_records(own, flaky, attempts=3).collect()}
    assert got["a"]["facts"] == ["b2 0", "b2 1"] and (got["a"]["nodes"], got["a"]["edges"], got["a"]["attempts"]) == (2, 2, 1)
    assert (got["never"]["attempts"], got["never"]["retryable"], got["never"]["error_type"], got["never"]["error"]) == (3, True, "Slow", "gone")
    assert (got["wrong"]["attempts"], got["wrong"]["retryable"]) == (1, False) and got["empty"]["edges"] == 0


@pytest.mark.parametrize(("error", "again"), [(TimeoutError(), True), (FileNotFoundError(), True), (Slow(), True), (ValueError("rate limit hit"), True), (ValueError("bad"), False), (type("OutputTruncatedError", (OSError,), {})(), False), (type("Api", (Exception,), {"status_code": 503})(), True), (type("Api", (Exception,), {"status_code": 401})("connection"), False)])
def test_what_is_tried_again(error, again):
    assert ingest.passes(error) is again


def test_retryable_knows_kinds_of_kinds(spark):
    df = spark.createDataFrame([("FileNotFoundError", None, ""), ("ConnectionResetError", None, ""), ("OutputTruncatedError", 503, ""), ("KeyError", None, "try again"), ("KeyError", None, "")], "k string, s int, d string")
    assert [r[0] for r in df.select(metadata.retryable(F.col("s"), F.col("k"), F.col("d"))).collect()] == [True, True, False, True, False]


def test_stream_with_extraction_keeps_receipts_and_failures(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.jsonl").write_text('{"name": "a", "body": "x1"}\n{"name": "never", "body": "y1"}\n{"name": "a", "body": "x1"}\n')
    out, ledger, check = (f"file://{tmp_path}/{x}" for x in ("out", "ledger", "check"))
    ingest.ingest_stream(spark, str(source), out, ledger, check, domain="d", extract=flaky, attempts=2).awaitTermination(120)
    (source / "2.jsonl").write_text('{"name": "a", "body": "x1"}\n{"name": "never", "body": "y1"}\n')
    ingest.ingest_stream(spark, str(source), out, ledger, check, domain="d", extract=flaky, attempts=2).awaitTermination(120)
    assert [r["name"] for r in spark.read.parquet(ledger).collect()] == ["a"]
    assert [r["name"] for r in spark.read.parquet(f"{out}-receipts").collect()] == ["a", "a"]  # repeated in one batch
    assert [(r["name"], r["attempts"]) for r in spark.read.parquet(f"{out}-failures").collect()] == [("never", 2)] * 2  # and tried anew
    ingest._there(spark, ledger)


def test_a_failed_record_is_tried_by_the_next_run(spark, tmp_path):
    """Also with no new file; once a run; and no more when it is done."""
    source, mended = tmp_path / "in", tmp_path / "mended"
    source.mkdir()
    (source / "1.jsonl").write_text('{"name": "a", "body": "x1"}\n{"name": "later", "body": "y1", "domain": "own"}\n')
    out, ledger, check = (f"file://{tmp_path}/{x}" for x in ("out", "ledger", "check"))

    def extract(row):
        import pathlib

        if row["name"] == "later" and not pathlib.Path(str(mended)).exists():
            raise ValueError("not yet")
        return 1, [row["body"]]

    run = lambda: ingest.ingest_stream(spark, str(source), out, ledger, check, domain="d", extract=extract).awaitTermination(120)
    held = lambda at: sorted(r["name"] for r in spark.read.parquet(at).collect())
    run()
    run()
    assert held(ledger) == ["a"] and held(f"{out}-failures") == ["later", "later"]
    mended.touch()
    run()
    assert held(ledger) == ["a", "later"] and {(r["name"], r["domain"]) for r in spark.read.parquet(f"{out}-receipts").collect()} == {("a", "d"), ("later", "own")}
    n = len(list((tmp_path / "ledger").iterdir()))
    run()
    assert len(list((tmp_path / "ledger").iterdir())) == n and held(ledger) == ["a", "later"]


def test_a_broken_ledger_is_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"name": "a", "body": "x"}\n')
    (tmp_path / "ledger" / "batch=9").mkdir(parents=True)
    (tmp_path / "ledger" / "batch=9" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):  # noqa: B017
        ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ledger"), str(tmp_path / "check"), domain="d").awaitTermination(120)
    assert not (tmp_path / "out").exists()


def test_staged_extraction_and_promotion(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b2", "g", None, None), ("never", "b1", "g", None, None), ("c", "b1", "", None, None)], "name string, body string, domain string, valid_at string, provenance string")
    at = f"file://{tmp_path}/stage"
    header, failed = ingest.stage_extraction(rows, flaky, at, allowed=["g"], default="g")
    assert header["record_count"] == 5 and [r["name"] for r in failed.collect()] == ["never"]
    records_of = review.all_records(review.read_parts(spark, f"{at}/snapshot", header))
    facts = records_of["entity_edge"].orderBy("fact").collect()
    assert [r["fact"] for r in facts] == ["b1 0", "b2 0", "b2 1"]
    told, rows_of = review.read_decisions(spark, f"{at}/review")
    assert told["snapshot_sha256"] == header["sha256"] and {r["decision"] for r in rows_of.collect()} == {"review"}
    with pytest.raises(ValueError, match="unresolved"):
        review.promote(header, records_of, told, rows_of)
    word = F.when(F.col("fact") == "b2 0", "refuse").otherwise("accept")
    decided = rows_of.withColumn("decision", word).withColumn("reason", F.when(word == "refuse", "no"))
    with pytest.raises(ValueError, match="not"):
        review.promote(header | {"sha256": "other"}, records_of, told, decided)
    with pytest.raises(ValueError, match="missing"):
        review.promote(header, records_of, told, decided.where("decision = 'refuse'"))
    new, kept = review.promote(header, records_of, told, decided)
    assert new["review"] == {"source_sha256": header["sha256"], "accepted": 2, "refused": 1}
    refused = next(r["uuid"] for r in facts if r["fact"] == "b2 0")
    assert kept["entity_edge"].count() == 2 and not any(refused in (r["entity_edges"] or []) for r in kept["episodic_node"].collect())
    with pytest.raises(ValueError, match="one group"):
        ingest.stage_extraction(rows.withColumn("domain", F.col("name")), flaky, f"{at}2", allowed=["g"], default="g")


# ---------------------------------------------------------------- review files


def test_decision_files_name_the_line(spark, tmp_path):
    head = {"kind": "review", "format_version": 1, "snapshot_sha256": "x"}
    row = {"kind": "decision", "record_kind": "entity_edge", "uuid": "e", "decision": "accept"}
    p = tmp_path / "d.jsonl"

    def write(*rows):
        p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")

    write(head, row, "", row | {"uuid": "f", "decision": "refuse", "reason": "r"})
    got, rows = review.read_decisions(spark, str(p))
    assert got == head and sorted(r["uuid"] for r in rows.collect()) == ["e", "f"]
    for bad, why in ((row | {"decision": "maybe"}, "unknown"), (row | {"kind": "x"}, "not a decision"), (row | {"record_kind": "node"}, "facts alone"), (row | {"decision": "refuse", "reason": " "}, "reason"), ("[1]", "not an object")):
        write(head, "", row, bad)
        with pytest.raises(ValueError, match=f"d.jsonl:4: .*{why}"):
            review.read_decisions(spark, str(p))
    for first in (row, head | {"format_version": 2}):
        write(first, row)
        with pytest.raises(ValueError):
            review.read_decisions(spark, str(p))


def test_parts_are_checked(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    nodes = spark.createDataFrame([(f"n{i}", f"name {i}", [0.5]) for i in range(50)], "uuid string, name string, name_embedding array<float>").repartition(4)
    header = review.write_parts({"entity_node": nodes}, at, {"groups": ["g"]})
    lines = review.read_parts(spark, at, header)
    assert lines.count() == header["record_count"] == 50 and not any("embedding" in r["line"] for r in lines.collect())
    rows = review.typed_records(lines, "entity_node", "other").collect()
    assert {r["uuid"] for r in rows} == {f"n{i}" for i in range(50)} and {r["group_id"] for r in rows} == {"other"}
    with pytest.raises(ValueError, match="header"):
        review.read_parts(spark, at, header | {"record_count": 49})
    spark.read.parquet(f"{at}/lines").withColumn("line", F.replace("line", F.lit("name 7"), F.lit("name 8"))).write.parquet(f"{at}2/lines")
    spark.read.parquet(f"{at}/manifest").write.parquet(f"{at}2/manifest")
    with pytest.raises(ValueError, match="checksum"):
        review.read_parts(spark, f"{at}2", header)


def test_a_tree_of_blocks(spark, tmp_path, monkeypatch):
    """The root against a plain version, with several levels; a changed, a lost and an added record each name their block."""
    monkeypatch.setattr(review, "BRANCH_BITS", 3)
    at = f"file://{tmp_path}/s"
    nodes = spark.range(1000).select(F.format_string("n%04d", "id").alias("uuid"), F.concat(F.lit("name "), "id").alias("name"))
    header = review.write_parts({"entity_node": nodes}, at, {})
    lines = spark.read.parquet(f"{at}/lines").orderBy("place").collect()

    def tree(children):
        return hashlib.sha256("\n".join(f"{n}:{h}" for n, h in children).encode()).hexdigest()

    def above(level):
        return {k: tree(sorted(x for x in level.items() if x[0] >> 3 == k)) for k in {n >> 3 for n in level}}

    level = above({r["place"]: hashlib.sha256((r["line"] + "\n").encode()).hexdigest() for r in lines})
    assert len(level) > 64
    while len(level) > 8:
        level = above(level)
    assert header["sha256"] == tree(sorted(level.items())) and header["record_count"] == 1000 and review.read_parts(spark, at, header).count() == 1000

    own = lines[500]["place"]
    block = review.read_block(spark, at, own >> 3)
    assert own in [r["place"] for r in block.collect()] and block.count() <= 8 and "GreaterThanOrEqual(place" in block._jdf.queryExecution().toString()
    here, table = F.col("place") == own, spark.read.parquet(f"{at}/lines")
    added = spark.createDataFrame([(lines[-1]["line"], "entity_node", 7 << 33, 7)], "line string, kind string, place long, part int")
    broken = {"a": (table.withColumn("line", F.when(here, F.concat("line", F.lit(" "))).otherwise(F.col("line"))), own >> 3), "b": (table.where(~here), own >> 3), "c": (table.unionByName(added), 7 << 30)}
    for name, (rows, bad) in broken.items():
        rows.write.parquet(f"{at}-{name}/lines")
        spark.read.parquet(f"{at}/manifest").write.parquet(f"{at}-{name}/manifest")
        found = review.damaged_blocks(spark, f"{at}-{name}").collect()
        assert [r["block"] for r in found] == [bad] and found[0]["first"] == (bad << 3) % (1 << 33)
        with pytest.raises(ValueError, match=f"part {found[0]['part']}, records {found[0]['first']} to"):
            review.read_parts(spark, f"{at}-{name}", header)


def test_restore_plan(spark):
    rows = {"entity_node": spark.createDataFrame([("a", "g"), ("b", "")], "uuid string, group_id string"), "entity_edge": spark.createDataFrame([("c", "g")], "uuid string, group_id string")}
    with pytest.raises(ValueError, match="b: no group"):
        review.restore_plan(rows, ["g"])
    got = {(r["target_group"], r["kind"]): r["planned"] for r in review.restore_plan(rows, ["g", "h"], "h").collect()}
    assert got == {("h", "entity_node"): 2, ("h", "entity_edge"): 1}
    with pytest.raises(ValueError, match="not allowed"):
        review.restore_plan(rows, ["g"], "x")


# ---------------------------------------------------------------- input


def test_reader_rules(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('\n{"kind": "export", "name": "a", "body": "b"}\n{"name": null, "body": "x", "domain": "d"}\n')
    assert [(r["name"], r["body"]) for r in records.read_records(spark, str(p)).collect()] == [("a", "b"), ("None", "x")]  # the header is not on line 1
    p.write_text('{"name": "a", "body": "b"}\n\n[1, 2]\n{"name": "c"}\n')
    with pytest.raises(ValueError, match=r"r.jsonl:3: not an object"):
        records.read_records(spark, str(p))
    assert records.read_records(spark, str(p), skip_invalid=True).count() == 1
    p.write_text('{"name": "a", "body": "b"}\n{"name": "c", "body": "  "}\n')
    with pytest.raises(ValueError, match=r"r.jsonl:2: no body"):
        records.read_records(spark, str(p))
    j = tmp_path / "r.json"
    for body, n in (('{"name": "a", "body": "b"}', 1), ('[{"name": "a", "body": "b"}, {"name": "c", "body": null}]', 2)):
        j.write_text(body)
        assert records.read_input(spark, str(j), domain="d").count() == n
    for body in ("[]", "[1]", "3", '{"name": "a"}', "not json"):
        j.write_text(body)
        with pytest.raises(ValueError):
            records.read_input(spark, str(j))


def test_folders_of_all_kinds(spark, tmp_path):
    root, away = tmp_path / "in", tmp_path / "away"
    (root / "sub").mkdir(parents=True)
    away.mkdir()
    (away / "x.md").write_text("outside")
    (root / "link").symlink_to(away)
    (root / "a+b c.md").write_text(" text ")
    (root / "sub" / "r.jsonl").write_text('{"name": "j", "body": "b"}\n')
    (root / "o.json").write_text('{"name": "k", "body": "b", "domain": "own"}')
    got = records.read_input(spark, str(root), domain="d").collect()
    assert [(r["name"], r["body"], r["domain"]) for r in got] == [("a+b c.md", "text", "d"), ("j", "b", "d"), ("k", "b", "own")]
    assert got[0]["provenance"] == "local document: a+b c.md"


# ---------------------------------------------------------------- stores, settings, groups


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/graph")
    assert s.read("entity_edge").isEmpty()
    s.set_up()
    s.set_up()
    assert s.log.head() == 1 and s.missing_indexes() == list(store.INDEXES)
    s.write("entity_edge", facts_of(spark, {"uuid": "e1", "name": "USES", "fact": "a uses b b"}, {"uuid": "e2", "group_id": "h", "fact": "c"}).drop("fact_embedding"))
    before = s.read("entity_edge")
    assert before.count() == 2 and s.read("entity_edge", ["h"]).first()["uuid"] == "e2"
    s.build_indexes()
    assert s.missing_indexes() == [] and [(r["uuid"], r["tf"], r["dl"]) for r in s.look_up("edge_name_and_fact", ["b"]).collect()] == [("e1", 2, 5)]
    s.write("entity_edge", facts_of(spark, {"uuid": "e3", "fact": "d"}))
    assert before.count() == 2 and s.read("entity_edge").count() == 1  # a read goes on with what it had
    assert [r["uuid"] for r in s.sql("SELECT uuid FROM entity_edge WHERE fact = :fact", fact="d").collect()] == ["e3"]


def test_time_limit(spark):
    with store.bounded(spark, 60, "count"):
        assert spark.range(10).count() == 10
    slow = F.udf(lambda x: __import__("time").sleep(30) or x, "long")
    with pytest.raises(TimeoutError), store.bounded(spark, 1, "sleep"):
        spark.range(1).select(slow("id")).collect()
    assert spark.range(10).count() == 10


def test_settings(tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"groups": ["${G:main}", "b"], "base": "${ROOT}/x${EMPTY}", "model": "nomic-embed-text:latest", "dimensions": 768}))
    got = settings.load(str(p), {"ROOT": "/r"})
    assert (got.groups, got.base) == (["main", "b"], "/r/x")
    for bad in ({"groups": ["a", "a"]}, {"groups": ["-a"]}, {"groups": []}, {"layout": "x"}, {"similarity": 0}, {"dimensions": 3}, {"multiplier": 11}, {"unknown": 1}, []):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            settings.load(str(p))


def test_scopes(spark):
    assert reads.scopes_of(["a", "b"], "separate") == [["a"], ["b"]] and reads.scopes_of(["a"], "shared") == [["a"]] and reads.scopes_of(["a"], "single") == [["a"], [""]]
    rows = spark.createDataFrame([("u", "", 1), ("u", "a", 2), ("v", "", 3), ("w", "b", 4)], "uuid string, group_id string, x int")
    got = {r["uuid"]: r["x"] for r in reads.read_scopes(rows, ["a"], "single").collect()}
    assert got == {"u": 2, "v": 3} and reads.single_group(["a"], ["a", "b"]) == "a"
    with pytest.raises(ValueError, match="a, b"):
        reads.single_group([], ["a", "b"])
    last = reads.last_wins(spark.createDataFrame([("u", 1, "x"), ("v", 2, "y"), ("u", 3, "z")], "uuid string, at int, t string"), "uuid", "at")
    assert sorted((r["uuid"], r["t"], r["place"]) for r in last.collect()) == [("u", "z", 1), ("v", "y", 2)]
    nodes = spark.createDataFrame([("one",), ("one",)], "store string")
    assert [(r["group_id"], r["nodes"]) for r in reads.status_by_store(nodes, ["a", "b"], ["one", "one"]).collect()] == [("a", 2)]


def test_embedder_records(spark, tmp_path):
    at = f"file://{tmp_path}/e.json"
    assert metadata.read_identity(spark, at).isEmpty()
    metadata.write_identity(spark, at, "m:latest", 4)
    one = metadata.read_identity(spark, at)
    assert one.first()[:2] == ("m", 4) and metadata.agreed_identity(one, one).count() == 1
    with pytest.raises(ValueError):
        metadata.agreed_identity(one, spark.createDataFrame([("n", 4, "")], metadata.IDENTITY))
    (tmp_path / "bad.json").write_text('{"model": " ", "dimensions": 0}')
    with pytest.raises(ValueError):
        metadata.read_identity(spark, f"file://{tmp_path}/bad.json")


# ---------------------------------------------------------------- search and output


def test_search_near_a_centre_with_a_ranker(spark):
    rows = [{"uuid": f"e{i}", "name": "USES", "fact": "uses it" if i < 2 else f"uses {i}", "source_node_uuid": f"n{i}", "target_node_uuid": f"n{i + 1}", "fact_embedding": [1.0, float(i)]} for i in range(6)]
    facts, day = facts_of(spark, *rows), F.lit("2024-01-01").cast("timestamp")
    near = search.find_facts(facts, search.Asked("uses", limit=3, centre="n5"), day).rows.orderBy("place").collect()
    assert [r["uuid"] for r in near] == ["e4", "e5", "e3"]
    back = lambda c: c.select(F.col("fact").alias("passage"), (-F.col("rank")).alias("place"), (F.col("rank") / 10).alias("score"))
    got = search.find_facts(facts, search.Asked("uses", limit=2), day, ranker=back, min_score=0.2)
    assert [r["uuid"] for r in got.rows.orderBy("place").collect()] == ["e5", "e4"] and got.stats.first()["returned"] == 2
    hybrid = search.find_facts(facts, search.Asked("it", limit=5, vector=[0.0, 1.0], types=["USES"]), day)
    assert hybrid.rows.count() == 5 and hybrid.stats.first()["candidates_seen"] == 6
    with pytest.raises(ValueError):
        search.find_facts(facts, search.Asked("uses", limit=101), day)
    with pytest.raises(ValueError):
        search.find_nodes(spark.createDataFrame([("n", "uses", "", "g", ["x"])], "uuid string, name string, summary string, group_id string, labels array<string>"), search.Asked("uses", centre="n"))


def test_embedding_without_a_model(spark):
    got = spark.createDataFrame([("a b",), ("b a",), ("",), ("c",)], "t string").select(text.embed(F.col("t"), 16).alias("v")).collect()
    assert got[0]["v"] == got[1]["v"] and got[2]["v"] is None and sum(x * x for x in got[3]["v"]) == pytest.approx(1) and len(got[0]["v"]) == 16


def test_first_answer(spark):
    nodes, facts = demo.build(spark)
    assert nodes.count() == 7 and facts.count() == 5 and len(demo.digest()) == 12
    day = F.lit("2024-01-01").cast("timestamp")
    answer = demo.ask(facts, day)
    rows = {(r["current"], r["place"]): r for r in answer.collect()}
    assert "tide board" in rows[True, 1]["fact"] and rows[False, 1]["invalid_at"] == "2023-09-12" and demo.exit_status(answer) == 0
    assert demo.exit_status(demo.ask(facts.where("invalid_at < '2024-01-01'"), day)) == 1 and demo.exit_status(demo.ask(facts, day, "zebra")) == 1


def test_output(spark, monkeypatch):
    rows = facts_of(spark, {"uuid": "e", "fact": "f", "valid_at": datetime.datetime(2024, 1, 2)}).select("uuid", "fact", "valid_at", "invalid_at", F.lit(0.5).alias("score"))
    assert json.loads(output.json_output(rows.select("uuid", "invalid_at")).first()["value"]) == {"uuid": "e", "invalid_at": None}
    assert rows.select(output.fact_line().alias("l")).first()["l"] == "0.50  f (since 2024-01-02)"
    queue = proposals(spark, *[{"id": f"p{i:02}"} for i in range(12)])
    assert len(lines := output.pending_lines(queue)) == 11 and lines[-1] == "and 2 more" and len(output.pending_lines(queue.limit(3))) == 3
    assert output.Refused("x", "secret").code == 6 and output.export_path("/w/", datetime.datetime(2024, 1, 2, 3, 4, 5)) == "/w/export-20240102T030405Z.jsonl"
    monkeypatch.setenv("CHRONOLOOM_WORKSPACE", "/other")
    assert output.workspace("/w") == "/other" and output.review_path("s") == "s.review.jsonl"


def test_small_reads(spark):
    from chronoloom.functions import times

    f = facts_of(spark, {"uuid": "a", "fact": "x"}, {"uuid": "b", "fact": "y"})
    assert reads.find_edge([f.limit(0), f], "b").first()["fact"] == "y" and reads.find_edge([f], "z").isEmpty()
    late = spark.range(2).select(times.too_late(F.timestamp_add("MINUTE", F.col("id") * 10, F.lit("2024-01-01").cast("timestamp")), F.lit("2024-01-01").cast("timestamp")).alias("l"))
    assert [r["l"] for r in late.collect()] == [False, True]
    lines = spark.createDataFrame([("p", 1, "fine"), ("p", 2, "pass" + "word: hunter2hunter2")], "path string, line int, text string")
    assert [r["line"] for r in checks.secret_audit(lines).collect()] == [2]
    assert spark.createDataFrame([(" a ",), (" ",)], "r string").select(workflow.clean_reason(F.col("r")).alias("r")).collect() == [("a",), (None,)]
    assert hashlib.sha256(b"g").hexdigest() == spark.range(1).select(F.sha2(F.lit("g"), 256).alias("h")).first()["h"]
