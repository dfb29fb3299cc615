import json
import random
import time

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import workflow
from chronoloom.sources import ledger, records
from chronoloom.streaming import ingest


def test_jsonl(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"name": "a", "body": "x y\u0085z"}\n\nnot json\n{"name": "b", "body": "y"}\n', encoding="utf-8")
    assert records.read_records(spark, str(p), skip_invalid=True).count() == 2
    with pytest.raises(ValueError):
        records.read_records(spark, str(p))
    p.write_text(json.dumps({"kind": "export", "name": "a", "body": "b"}) + "\n")
    with pytest.raises(ValueError, match="snapshot"):
        records.read_records(spark, str(p))


def test_folder(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    for name, body in (("a.txt", "one"), ("b.md", "two"), ("nested/a.txt", "three"), (".hidden.md", "no"), ("ignored.py", "no")):
        (tmp_path / name).write_text(body)
    got = records.read_input(spark, str(tmp_path), domain="d").collect()
    assert [(r["name"], r["body"], r["domain"]) for r in got] == [("a.txt", "one", "d"), ("b.md", "two", "d"), ("nested/a.txt", "three", "d")]


def test_empty_input_is_an_error(spark, tmp_path):
    (tmp_path / "a.md").write_text("  ")
    with pytest.raises(ValueError):
        records.read_input(spark, str(tmp_path))


def test_ledger_and_queue(spark, tmp_path):
    p = tmp_path / "ledger.jsonl"
    p.write_text('{"key": "k1"}\ngarbage\n{"key": "k1"}\n{"key": "k2"}\n')
    assert sorted(r["key"] for r in records.completed_keys(spark, str(p)).collect()) == ["k1", "k2"]
    q = tmp_path / "q.jsonl"
    q.write_text('{"id": "p1", "domain": "d", "status": "rejected", "text": "a", "decided_at": "2"}\n{"id": "p2", "domain": "d", "status": "rejected", "text": "b", "decided_at": "3"}\n{"id": "p3", "status": "pending"}\n')
    queue = records.read_queue(spark, str(q))
    assert [r["id"] for r in records.rejected(queue, queue.limit(0), "d").collect()] == ["p2", "p1"]
    stay, go = records.rewrite_queue(queue, F.col("status") == "rejected")
    assert (stay.count(), go.count()) == (1, 2)


def test_stream_ingests_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.jsonl").write_text('{"name": "a", "body": "x"}\n{"name": "b", "body": "y"}\n')
    paths = [str(tmp_path / x) for x in ("out", "ledger", "check")]
    ingest.ingest_stream(spark, str(source), *paths, domain="d").awaitTermination(120)
    (source / "2.jsonl").write_text('{"name": "a", "body": "x"}\n{"name": "c", "body": "z"}\n')
    ingest.ingest_stream(spark, str(source), *paths, domain="d").awaitTermination(120)
    assert sorted(r["name"] for r in spark.read.parquet(paths[0]).collect()) == ["a", "b", "c"]


def test_stream_windows_equal_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = str(tmp_path / "events")
    events.write.parquet(source)
    q = ingest.event_counts(spark.readStream.schema(events.schema).parquet(source), delay="40 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def walk(events):
    """Each proposal's state by a plain loop over its events in order."""
    out = {}
    for i, seq, status in sorted(events, key=lambda e: e[1]):
        at, last, refused = out.get(i, ("", None, 0))
        legal = {"": "pending approved", "pending": "approved rejected", "approved": "rejected draining", "draining": "approved archived"}.get(at, "")
        out[i] = (status, seq, refused) if status in legal.split() else (at, last, refused + 1)
    return {i: (s or None, q, r) for i, (s, q, r) in out.items()}


def some_events(n=600):
    rng = random.Random(4)
    steps = ["pending", "approved", "approved", "draining", "draining", "archived", "rejected", "lost"]
    return [(f"p{rng.randint(0, 60)}", seq, rng.choice(steps if seq > 60 else ["pending", "rejected"])) for seq in range(n)]


SCHEMA = "id string, seq long, status string"


def test_folded_states(spark):
    """Whatever the length of runs: a hot proposal's events are never together."""
    events = some_events() + [("hot", 1000 + i, ["approved", "draining"][i % 2]) for i in range(300)]
    df = spark.createDataFrame(events, SCHEMA).repartition(3)
    for run in (1, 7, 4096):
        assert {r["id"]: (r["status"], r["seq"], r["refused"]) for r in workflow.folded_states(df, run=run).collect()} == walk(events)
    assert workflow.folded_states(df.limit(0)).collect() == []


def states(spark, tmp_path, batches, name, **how):
    source, got = tmp_path / name, []
    source.mkdir()
    q = ingest.proposal_states(spark.readStream.schema(SCHEMA).parquet(str(source)), **how).writeStream.outputMode("update")
    q = q.foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:
        for i, batch in enumerate(batches):
            if not isinstance(batch, list):  # time passes, at most a minute
                until = time.time() + 60
                while not batch(got) and time.time() < until:
                    time.sleep(0.2)
            else:
                spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"{name}-{i}"))
                for p in (tmp_path / f"{name}-{i}").glob("*.parquet"):
                    p.rename(source / f"{i}-{p.name}")
            if not how:  # with timers there is always another batch
                q.processAllAvailable()
    finally:
        q.stop()
    return got


def test_stream_states_equal_the_batch(spark, tmp_path):
    events = some_events()
    batches = [events[:100], events[100:350], events[350:]]
    last = {}
    for i, seq, status, refused in states(spark, tmp_path, batches, "log"):
        last[i] = (status, seq, refused)
    assert last == walk(events) == {r["id"]: (r["status"], r["seq"], r["refused"]) for r in workflow.folded_states(spark.createDataFrame(events, SCHEMA)).collect()}


def test_late_events_are_refused(spark, tmp_path):
    got = states(spark, tmp_path, [[("p", 1, "pending"), ("p", 5, "approved")], [("p", 3, "rejected")], [("p", 6, "rejected")]], "late")
    assert got == [("p", 5, "approved", 0), ("p", 5, "approved", 1), ("p", 6, "rejected", 1)]


def test_claims_end(spark, tmp_path):
    """One that is not settled is handed back; one that is, is not."""
    first = [("a", 1, "approved"), ("a", 2, "draining"), ("b", 1, "approved"), ("b", 2, "draining"), ("b", 3, "archived")]
    got = states(spark, tmp_path, [first, lambda got: len(got) > 2, [("a", 3, "draining"), ("c", 1, "pending")], lambda got: any(r[0] == "c" for r in got)], "claims", claim_ms=1500)
    assert sorted(got[:2]) == [("a", 2, "draining", 0), ("b", 3, "archived", 0)] and got[2] == ("a", 2, "approved", 0)
    assert ("a", 3, "draining", 0) in got[3:] and not any(r[0] == "b" for r in got[2:])


def test_a_ledger_opens_only_files_that_may_hold_a_key(spark, tmp_path):
    """Over 50 writes of new keys a lookup opens next to nothing, finds every key that is there, and runs stay few."""
    own = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    batch = lambda i: spark.range(i * 20, i * 20 + 20, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit("d").alias("domain"), F.lit("n").alias("name"), F.lit(str(i)).alias("ingested_at"))
    opened, runs = [], []
    for i in range(50):
        own.merge()
        if i % 7 == 0:
            assert own.entries_of(batch(i)).join(batch(i), "key", "left_semi").isEmpty()
            opened.append(len(own.opened))
        own.enter(batch(i), f"s-{i}")
        runs.append(len(own.runs()))
    assert max(opened) <= 1 and max(runs) <= 2 * ledger.FAN
    everything = spark.range(0, 1000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    assert own.entries_of(everything).select("key").distinct().count() == 1000
    assert own.entries_of(batch(49).limit(1)).where("ingested_at = '49'").count() and len(own.opened) == 1


def test_a_ledger_of_many_files(spark, tmp_path, monkeypatch):
    """Keys by digits, in files and in filters; a run without filters is read whole; an empty run leaves none; a run left out."""
    monkeypatch.setattr(ledger, "FILE_ROWS", 100)
    monkeypatch.setattr(ledger, "BLOCK_KEYS", 20)
    own = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    rows = spark.range(1000).select(F.concat(F.lit("key "), "id").alias("key"), F.lit(None).cast("string").alias("domain"), F.lit("n").alias("name"), F.lit("1").alias("ingested_at"))
    own.enter(rows, "a")
    assert len(list((tmp_path / "ledger" / "batch=a").glob("bucket=*"))) == 16
    one = rows.where("key = 'key 77'")
    assert own.entries_of(one).join(one, "key", "left_semi").count() == 1 and len(own.opened) == 1
    other = rows.select(F.concat("key", F.lit("?")).alias("key"))
    assert own.entries_of(other).join(other, "key", "left_semi").isEmpty()
    rows.limit(3).select(*rows.columns).write.parquet(f"file://{tmp_path}/ledger/batch=cut")
    own.entries_of(other)
    assert any(p.endswith("/batch=cut") for p in own.opened)
    own.enter(rows.limit(0), "a")
    assert own.runs() == ["cut"]
    assert own.entries_of(rows, but="cut").isEmpty() and own.entries_of(rows).count() == 3


def test_streams_with_their_own_checkpoints_share_a_ledger(spark, tmp_path):
    for i, names in enumerate((["a", "b"], ["b", "c"])):
        source = tmp_path / f"in{i}"
        source.mkdir()
        (source / "1.jsonl").write_text("".join(f'{{"name": "{n}", "body": "x"}}\n' for n in names))
        ingest.ingest_stream(spark, str(source), *[str(tmp_path / x) for x in ("out", "ledger", f"check{i}")], domain="d").awaitTermination(120)
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == ["a", "b", "c"]
