import hashlib
import json
import random

import pytest

from chronoloom.sources import formats


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


def snapshot(path, records, **changed):
    body = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records)
    head = {"kind": "export", "format_version": 2, "record_count": len(records), "sha256": hashlib.sha256(body.encode()).hexdigest()} | changed
    path.write_text(json.dumps(head) + "\n" + body, encoding="utf-8", newline="\n")
    return [line for line in body.split("\n") if line]


@pytest.mark.parametrize("seed", range(5))
def test_ranges_have_every_line_once(tmp_path, seed, monkeypatch):
    """Against a split of the whole, with pieces and ranges shorter than lines, blank lines and no end of the last."""
    chance = random.Random(seed)
    monkeypatch.setattr(formats, "PIECE", chance.choice([1, 3, 7, 64]))
    lines = ["x" * chance.choice([0, 0, 1, 5, 40]) + "é " * chance.randrange(3) for _ in range(60)]
    whole = "\n".join(lines).encode() + b"\n" * (seed % 2)
    path = tmp_path / "lines"
    path.write_bytes(whole)
    cut = formats.ranges(str(path), 0, len(whole), chance.choice([1, 4, 17, 1000]))
    got = [x for r in cut for x in formats.lines_of(r.path, r.start, r.end)]
    texts = [x.text.decode() for x in got]
    assert [t for t in texts if t] == [t for t in lines if t]
    assert all(whole[x.at : x.at + len(x.text)] == x.text for x in got)


def test_a_snapshot_by_name(known, tmp_path):
    rows = [{"kind": k, "uuid": f"{i}", "name": "a b\u0085" * (i % 3)} for i, k in enumerate(["entity_node"] * 30 + ["entity_edge"] * 20)]
    lines = snapshot(tmp_path / "s.jsonl", rows)
    for most in (50, 1 << 20):
        got = known.read.format("chronoloom_snapshot").option("range_bytes", most).load(f"file://{tmp_path}/s.jsonl")
        assert [r["line"] for r in got.orderBy("position").collect()] == lines
        assert {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()} == {"entity_node": 30, "entity_edge": 20}
    snapshot(tmp_path / "empty.jsonl", [])
    assert known.read.format("chronoloom_snapshot").load(str(tmp_path / "empty.jsonl")).count() == 0


@pytest.mark.parametrize(("changed", "words"), [({"sha256": "0"}, "checksum"), ({"record_count": 7}, "checksum"), ({"format_version": 3}, "not supported"), ({"kind": "entity_node"}, "no export header")])
def test_a_damaged_snapshot_fails_whatever_is_asked_of_it(known, tmp_path, changed, words):
    snapshot(tmp_path / "s.jsonl", [{"kind": "entity_node", "uuid": "1"}] * 3, **changed)
    with pytest.raises(Exception, match=words):
        known.read.format("chronoloom_snapshot").load(str(tmp_path / "s.jsonl")).limit(1).collect()


def test_an_old_snapshot_has_no_checksum_and_an_unknown_kind_is_named(known, tmp_path):
    snapshot(tmp_path / "old.jsonl", [{"kind": "entity_node", "uuid": "1"}], format_version=1, sha256=None)
    assert known.read.format("chronoloom_snapshot").load(str(tmp_path / "old.jsonl")).count() == 1
    snapshot(tmp_path / "odd.jsonl", [{"kind": "entity_node", "uuid": "1"}, {"kind": "odd"}])
    with pytest.raises(Exception, match="unknown kind 'odd'"):
        known.read.format("chronoloom_snapshot").load(str(tmp_path / "odd.jsonl")).collect()


def row(i, **more):
    return json.dumps({"id": f"p{i}", "domain": "d", "status": "pending", "text": "a b", "facts": ["x", "y"], "landed": [0], "unknown": 1} | more, ensure_ascii=False) + "\n"


def test_a_queue_by_name(known, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.jsonl").write_text(row(1) + "\n" + row(2, text=None, facts=None, landed=None))
    (tmp_path / "q" / "2.jsonl").write_text(row(3, text=5).rstrip("\n"))
    (tmp_path / "q" / "_done").write_text("no JSON")
    got = known.read.format("chronoloom_queue").option("range_bytes", 40).load(str(tmp_path / "q"))
    assert {(r["id"], r["text"], tuple(r["facts"] or ()), tuple(r["landed"] or ())) for r in got.collect()} == {("p1", "a b", ("x", "y"), (0,)), ("p2", None, (), ()), ("p3", "5", ("x", "y"), (0,))}
    (tmp_path / "q" / "2.jsonl").write_text("")
    assert known.read.format("chronoloom_queue").load(str(tmp_path / "q")).count() == 2


@pytest.mark.parametrize("bad", ["{cut", "[1]", '{"id": "x", "facts": "text"}', '{"id": "x", "landed": ["a"]}'])
def test_a_corrupt_line_of_a_queue_is_named(known, tmp_path, bad):
    (tmp_path / "q.jsonl").write_text(row(1) + bad + "\n" + row(2))
    with pytest.raises(Exception, match=f"q.jsonl: byte {len(row(1).encode())}"):
        known.read.format("chronoloom_queue").load(str(tmp_path / "q.jsonl")).collect()


def test_a_growing_queue_is_streamed(known, tmp_path):
    """Lines come once, over restarts; one without its end waits; new files are found; a file that shrank is an error."""
    source = tmp_path / "q"
    source.mkdir()

    def run():
        stream = known.readStream.format("chronoloom_queue").option("range_bytes", 100).load(str(source))
        stream.select("id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="100 milliseconds").start().processAllAvailable()
        for q in known.streams.active:
            q.stop()
        return sorted(r["id"] for r in known.read.schema("id string").parquet(str(tmp_path / "out")).collect())

    half = row(3)
    (source / "1.jsonl").write_text(row(1) + row(2) + half[:20])
    assert run() == ["p1", "p2"]
    with (source / "1.jsonl").open("a") as f:
        f.write(half[20:])
    (source / "2.jsonl").write_text(row(4))
    assert run() == ["p1", "p2", "p3", "p4"]
    assert run() == ["p1", "p2", "p3", "p4"]
    (source / "1.jsonl").write_text(row(1))
    with pytest.raises(Exception, match="shorter than what was read"):
        run()
    for q in known.streams.active:
        q.stop()


def test_reading_a_snapshot_reads_all_of_it(known, tmp_path):
    from chronoloom.operators import review

    lines = snapshot(tmp_path / "s.jsonl", [{"kind": "entity_node", "uuid": str(i)} for i in range(500)])
    head, got = review.read_snapshot(known, str(tmp_path / "s.jsonl"))
    assert head["record_count"] == 500 and sorted(r["line"] for r in got.collect()) == sorted(lines)
    snapshot(tmp_path / "odd.jsonl", [{"kind": "entity_node"}] * 500 + [{"kind": "odd"}], format_version=1)
    with pytest.raises(ValueError, match="unknown kind 'odd'"):
        review.read_snapshot(known, str(tmp_path / "odd.jsonl"))
