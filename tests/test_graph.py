import json
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import checks, chunk, gates, reads, resolve, review, search, workflow


def now():
    return F.lit("2024-01-10").cast("timestamp")


def facts(spark, rows):
    return spark.createDataFrame(rows, "uuid string, fact string, valid string, invalid string").select("uuid", "fact", F.to_timestamp("valid").alias("valid_at"), F.to_timestamp("invalid").alias("invalid_at"))


def ids(df):
    return sorted(r[0] for r in df.select("uuid").collect())


def test_currency_is_strict_and_future_ends_are_current(spark):
    f = facts(spark, [("a", "x", None, None), ("b", "x", None, "2024-01-10"), ("c", "x", None, "2024-02-01"), ("d", "x", "2025-01-01", "2024-01-01")])
    assert ids(reads.current_facts(f, now())) == ["a", "c"]
    assert ids(reads.current_facts(f, now(), include_invalidated=True)) == ["a", "b", "c", "d"]


def test_date_range_is_inclusive(spark):
    f = facts(spark, [("a", "x", "2024-01-01", None), ("b", "x", "2024-01-02", None), ("c", "x", None, None)])
    assert ids(reads.in_date_range(f, valid_after=F.lit("2024-01-01"), valid_before=F.lit("2024-01-01"))) == ["a"]


def test_groups():
    assert reads.allowed_groups(None, ["a", "b"], ["b"]) == ["b"]
    with pytest.raises(ValueError, match="unknown group: x"):
        reads.allowed_groups(["z", "x"], ["a"])
    with pytest.raises(ValueError, match="ungranted group: a"):
        reads.allowed_groups(["a"], ["a", "b"], ["b"])


def test_first_scope_wins(spark):
    one, two = (spark.createDataFrame([(u, s)], "uuid string, name string") for u, s in (("x", "first"), ("x", "second")))
    assert [r["name"] for r in reads.collect_scopes([one, two]).collect()] == ["first"]


def test_provenance_split_and_empty_lists(spark):
    f = spark.createDataFrame([("only", ["e1"], "g"), ("shared", ["e1", "e2"], "g"), ("none", [], "g"), ("other", ["e2"], "g")], "uuid string, episodes array<string>, group_id string")
    e = spark.createDataFrame([("e1", ["only", "shared", "none"])], "uuid string, entity_edges array<string>")
    assert {r["uuid"]: r["only"] for r in reads.episode_edges(e, f).collect()} == {"only": True, "shared": False, "none": True}


def test_support_is_split_without_lists(spark, sf_dir):
    """Each input is read once; an episode without an id supports nothing; equal ids of two keys stay apart."""
    from chronoloom.plans import catalog

    rows = [("a", "x", "f2", "e1"), ("a", "x", "f1", "e1"), ("a", "y", "f3", "e1"), ("a", "y", "f4", "e9"), ("b", "x", "f5", "e9"), ("b", "y", None, None), ("b", "y", "f6", "e2"), (None, "z", "f6", "e2")]
    s = spark.createDataFrame(rows, "source string, target string, uuid string, _episode string")
    e = spark.createDataFrame([("e1",), ("e1",), ("e2",), (None,)], "uuid string")
    got = sorted((str(r["source"]), r["target"], r["uuid"], r["only"]) for r in reads.support_split(s, e, "source", "target").collect())
    assert got == [("None", "z", "f6", True), ("a", "x", "f1", True), ("a", "y", "f3", False), ("b", "y", "f6", True)]
    plan = catalog.QUERIES["provenance_split"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("Relation") == 2


def test_data_checks_hold_no_table_of_ids(spark, monkeypatch):
    from chronoloom.operators import checks

    rows = [("a", "x", "y", "said"), ("a", "x", "y", " "), ("a", "x", "q", None), ("b", "q", "q", "said"), (None, "x", "y", "said"), (None, "x", None, "said"), ("c", "y", "x", "said")]
    f = spark.createDataFrame(rows, "uuid string, source_node_uuid string, target_node_uuid string, fact string")
    n = spark.createDataFrame([("x",), ("y",), ("y",)], "uuid string")
    monkeypatch.setattr(checks, "DEALT", 2)
    found = checks.data_checks(f, n)
    assert {r["check"]: (r["status"], r["detail"]) for r in found.collect()} == {"duplicate ids": ("fail", 2), "unknown endpoints": ("fail", 3), "blank facts": ("warn", 2)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate(keys=[uuid" not in plan.split("Join")[0] and "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan
    assert {r["check"]: r["detail"] for r in checks.data_checks(f.limit(0), n).collect()} == {"duplicate ids": 0, "unknown endpoints": 0, "blank facts": 0}


def test_edge_sources_keep_order_and_missing(spark):
    f = spark.createDataFrame([("f", ["e2", "gone", "e1"])], "uuid string, episodes array<string>")
    e = spark.createDataFrame([("e1", "one"), ("e2", "two")], "uuid string, name string")
    assert [(r["episode"], r["name"]) for r in reads.edge_sources(f, e).orderBy("pos").collect()] == [("e2", "two"), ("gone", None), ("e1", "one")]


def test_name_clusters_cross_groups(spark):
    n = spark.createDataFrame([("1", "ACME Corp", "a"), ("2", "acme corp.", "b"), ("3", "Other", "a"), ("4", "--", "a"), ("5", "..", "a")], "uuid string, name string, group_id string")
    got = reads.duplicate_entities(n).collect()
    assert [(r["name"], r["count"], [m["uuid"] for m in r["members"]]) for r in got] == [("acme corp", 2, ["1", "2"])]
    assert sorted(r["uuid"] for r in reads.entity_members(n, reads.duplicate_entities(n, members=False)).collect()) == ["1", "2"]


def test_fact_clusters(spark):
    rows = [("e1", "It uses X.", "a", "b", None, "2024-01-02"), ("e2", "it uses x", "a", "b", None, None), ("e3", "it uses x", "b", "a", None, None), ("e4", "it uses x", "a", "b", "2024-01-01", None)]
    f = spark.createDataFrame(rows, "uuid string, fact string, source_node_uuid string, target_node_uuid string, inv string, cr string").withColumn("invalid_at", F.to_timestamp("inv")).withColumn("created_at", F.to_timestamp("cr"))
    got = reads.duplicate_facts(f, now()).collect()
    assert [(r["count"], r["fact"], [m["uuid"] for m in r["members"]]) for r in got] == [(2, "It uses X.", ["e1", "e2"])]
    keyed = reads.keyed_facts(f.withColumn("fact", F.when(F.col("uuid") == "e2", "It USES\u3000x").otherwise(F.col("fact"))))
    clusters = reads.fact_clusters(keyed)
    assert [(r["key"], r["count"]) for r in clusters.collect()] == [("it uses x", 3)]
    assert sorted((r["uuid"], r["at"]) for r in reads.fact_members(keyed, clusters).collect()) == [("e1", "2024-01-02 00:00:00"), ("e2", "None"), ("e4", "None")]


def test_rerank_multiplicity_omission_and_order(spark):
    e = spark.createDataFrame([("a", "same", 1), ("b", "same", 2), ("c", "left out", 3)], "uuid string, fact string, rank int")
    r = spark.createDataFrame([("same", 1, 0.1), ("same", 2, 0.9)], "passage string, place int, score double")
    got = [(x["uuid"], x["score"]) for x in search.rerank(e, r).orderBy("final_rank").collect()]
    assert got == [("a", 0.1), ("b", 0.9), ("c", 0.0)]
    assert [x["uuid"] for x in search.rerank(e, r, min_score=0.5).collect()] == ["b"]


def test_limits_and_stats():
    assert search.candidate_limit(100, 10) == 1000
    for bad in (0, 101):
        with pytest.raises(ValueError):
            search.candidate_limit(bad)
    with pytest.raises(ValueError):
        search.question_terms(" _ ")
    assert search.stats(5, 10, 10, 8, 5, 2)["recall_may_be_incomplete"] and not search.stats(5, 10, 9, 9, 5)["recall_may_be_incomplete"]


def test_vector_queries_are_bounded(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in search.vector_top(v, v.where("vec_id = 4"), 2).orderBy("rank").collect()] == [3, 2]
    assert search.vector_top(v, v.where("false"), 2).count() == 0


def test_gate_codes(spark):
    schema = "id string, domain string, facts array<string>, fact_type string, operation string, supersedes string, provenance string, source string, link string, said string, supersedes_rejection string"
    ok = ("source-fact", "assert", None, "p", None, None, None, None)
    secret = "pass" + "word = abcdefghij"
    rows = [
        ("good", "en", ["The service uses DuckDB"], *ok), ("type", "en", ["x"], "rumour", *ok[1:]), ("empty", "en", [" "], *ok), ("revise", "en", ["x"], "belief", "revise", *ok[2:]),
        ("two", "en", ["One thing. Another thing"], *ok), ("secret", "en", [secret], *ok), ("again", "en", ["uses MongoDB now"], *ok), ("cleared", "en", ["uses MongoDB now"], *ok[:7], "r1"),
        ("bundle", "en", ["a", "b"], "belief", "assert", None, None, None, None, None, None), ("elsewhere", "de", ["uses MongoDB now"], *ok),
    ]
    rejected = spark.createDataFrame([("r1", "en", ["uses MongoDB now."])], "id string, domain string, facts array<string>")
    got = {r["id"]: r["exit_code"] for r in gates.gate_codes(spark.createDataFrame(rows, schema), rejected).collect()}
    assert got == {"good": 0, "type": 2, "empty": 2, "revise": 2, "two": 4, "secret": 6, "again": 5, "cleared": 0, "bundle": 2, "elsewhere": 0}


def test_rejected_matches_are_exact(spark):
    import itertools
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(60)]
    t = spark.createDataFrame([(str(i), "d", x) for i, x in enumerate(texts[:30])], "id string, domain string, text string")
    r = spark.createDataFrame([(str(i), "d", [x]) for i, x in enumerate(texts[30:])], "id string, domain string, facts array<string>")
    for threshold in (0.5, 0.75, 1.0):
        got = {(x["id"], x["rejected_id"]) for x in gates.rejected_matches(t, r, threshold).collect()}
        want = set()
        for (i, a), (j, b) in itertools.product(enumerate(texts[:30]), enumerate(texts[30:])):
            a, b = set(a.split()), set(b.split())
            if (len(a & b) / len(a | b) if a | b else 1.0) >= threshold:
                want.add((str(i), str(j)))
        assert got == want


def test_decidable_and_binding(spark):
    rows = [("p", "pending", None, None, None), ("old", "approved", None, None, None), ("bound", "approved", "d", None, None), ("claimed", "approved", "d", "t", None), ("landed", "approved", "d", None, [0]), ("gone", "rejected", None, None, None)]
    q = spark.createDataFrame(rows, "id string, status string, approved_digest string, draining_at string, landed array<int>")
    yes = lambda s: {r["id"] for r in q.where(gates.decidable(s)).collect()}
    assert yes("approved") == {"p", "old"} and yes("rejected") == {"p", "old", "bound"}
    errors = {r["id"]: r["e"] for r in q.select("id", gates.binding_error(q.columns).alias("e")).collect()}
    assert errors["old"] == "missing" and errors["bound"] == "mismatch"


def test_retire_is_all_or_nothing(spark):
    f = facts(spark, [("a", "x", None, None), ("b", "x", None, "2030-01-01")]).withColumn("group_id", F.lit("g"))
    name = lambda *u: spark.createDataFrame([(x,) for x in u], "uuid string")
    with pytest.raises(ValueError, match="zz"):
        workflow.retire(f, name("a", "zz"), groups=["g"], ended=now(), now=now())
    got = {r["uuid"]: (r["outcome"], str(r["invalid_at"])[:10]) for r in workflow.retire(f, name("a", "b"), groups=["g"], ended=now(), now=now()).collect()}
    assert got == {"a": ("retired", "2024-01-10"), "b": ("already_invalid", "2030-01-01")}


def test_resume_keeps_repeats_within_a_batch(spark):
    r = workflow.keyed_records(spark.createDataFrame([("n", "b", None, None)] * 2 + [("m", "b", "x", None)], "name string, body string, domain string, valid_at string"), "d")
    assert r.select("key").distinct().count() == 2
    assert workflow.resume_plan(r, r.where("name = 'm'").select("key")).count() == 2


def graph(spark):
    n = spark.createDataFrame([("n1", "Ada", "g"), ("n2", "Notes", "g")], "uuid string, name string, group_id string")
    ep = spark.createDataFrame([("ep1", "g", ["keep", "drop"])], "uuid string, group_id string, entity_edges array<string>")
    e = spark.createDataFrame([(u, "g", "n1", "n2", f"fact {u}", [0.5]) for u in ("keep", "drop")], "uuid string, group_id string, source_node_uuid string, target_node_uuid string, fact string, fact_embedding array<float>")
    m = spark.createDataFrame([("m1", "g", "ep1", "n1")], "uuid string, group_id string, source_node_uuid string, target_node_uuid string")
    return {"entity_node": n, "episodic_node": ep, "entity_edge": e, "episodic_edge": m}


def test_snapshot_round_trip_and_tampering(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    head = review.write_snapshot(graph(spark), path, {"created_at": "t", "groups": ["g"]})
    assert head["record_count"] == 6
    got, lines = review.read_snapshot(spark, path)
    assert got == head and lines.count() == 6
    assert "embedding" not in open(path).read()
    text = open(path).read()
    open(path, "w").write(text.replace("fact keep", "fact kept"))
    with pytest.raises(ValueError, match="checksum"):
        review.read_snapshot(spark, path)
    open(path, "w").write(json.dumps({"kind": "other"}) + "\n")
    with pytest.raises(ValueError, match="header"):
        review.read_snapshot(spark, path)


def test_review(spark):
    g = graph(spark)
    d = lambda *r: spark.createDataFrame(list(r), "uuid string, decision string, reason string")
    problems = lambda x: {(r["uuid"], r["problem"]) for r in review.decision_problems(g["entity_edge"], x).collect()}
    assert problems(d(("keep", "accept", ""))) == {("drop", "missing")}
    assert problems(d(("keep", "accept", ""), ("keep", "accept", ""), ("drop", "refuse", ""), ("zz", "accept", ""))) == {("keep", "duplicate"), ("drop", "no reason"), ("zz", "unknown")}
    assert problems(review.decision_template(g["entity_edge"])) == {("keep", "unresolved"), ("drop", "unresolved")}
    good = d(("keep", "accept", ""), ("drop", "refuse", "wrong"))
    assert problems(good) == set()
    facts_, episodes = review.apply_decisions(g["entity_edge"], g["episodic_node"], good)
    assert ids(facts_) == ["keep"] and episodes.first()["entity_edges"] == ["keep"]


def test_restore_reports_missing_endpoints(spark):
    g = graph(spark)
    e = g["entity_edge"].union(spark.createDataFrame([("bad", "g", "n1", "nowhere", "x", [0.1])], g["entity_edge"].schema))
    out, failed = review.restore({"entity_node": g["entity_node"].where("uuid = 'n1'")}, {**g, "entity_edge": e}, "h")
    assert [(r["uuid"], r["missing"]) for r in failed.collect()] == [("bad", "target")]
    assert ids(out["entity_edge"]) == ["drop", "keep"] and {r["group_id"] for r in out["entity_node"].collect()} == {"h"}


def test_chunks():
    text = "Short.\n\n" + " ".join(["word"] * 20)
    got = chunk.chunks(text, 45)
    assert all(len(c) <= 45 for c in got) and " ".join(" ".join(got).split()) == " ".join(text.split())
    assert chunk.chunks("x" * 100, 45) == ["x" * 45, "x" * 45, "x" * 10]
    assert chunk.chunks(text, 0) == [text] and chunk.chunks(None) == [] and chunk.chunks(" \n ") == []
    assert chunk.chunks("a b\n\nc", 6) == ["a b\n\nc"] and chunk.chunks("aaa\n\nbbb\n\nc", 6) == ["aaa", "bbb\n\nc"]


def plain_chunks(text, most):
    """Character by character, without the search for a cut in reach that the library has."""
    text = (text or "").strip()
    if not text or most <= 0 or len(text) <= most:
        return [text] if text else []
    paragraphs, held = [], []
    for line in text.split("\n"):
        if line.strip():
            held.append(line)
        elif held:
            paragraphs.append("\n".join(held).strip())
            held = []
    paragraphs += ["\n".join(held).strip()] if held else []
    pieces = []
    for p in paragraphs:
        while len(p) > most:
            ends = [i for i in range(most + 1) if p[i] in "\n "]
            cut = ends[-1] if ends and ends[-1] >= most // 2 else most
            pieces.append(p[:cut].strip())
            p = p[cut:].lstrip()
        pieces += [p] if p else []
    out = pieces[:1]
    for piece in pieces[1:]:
        if len(f"{out[-1]}\n\n{piece}") <= most:
            out[-1] = f"{out[-1]}\n\n{piece}"
        else:
            out.append(piece)
    return out


def test_chunks_equal_a_plain_version():
    rng = random.Random(3)
    for _ in range(800):
        text = "".join(rng.choices(["a", "bc", "é", " ", "\n", "\n\n", "\n \n", "dddddddd"], k=rng.randint(0, 60)))
        most = rng.randint(1, 30)
        assert chunk.chunks(text, most) == plain_chunks(text, most), (text, most)


def test_chunks_of_the_documents(spark, sf_dir):
    """All documents, in chunks of a size that cuts many of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"))
    got = {}
    for r in chunk.chunk_records(docs, 700).collect():
        got.setdefault(r["name"].split(" [part ")[0], []).append((r["chunk_index"] or 1, r["body"]))
    want = {r["name"]: plain_chunks(r["body"], 700) for r in docs.collect()}
    assert {n: [b for _, b in sorted(x)] for n, x in got.items()} == {n: x for n, x in want.items() if x} and any(len(x) > 2 for x in want.values())


def test_chunk_records(spark):
    r = spark.createDataFrame([("doc", "a" * 30, "d"), ("one", "short", "d"), ("none", " ", "d")], "name string, body string, domain string")
    got = [(x["name"], x["chunk_index"], x["chunk_count"]) for x in chunk.chunk_records(r, 20).orderBy("name").collect()]
    assert got == [("doc [part 1/2]", 1, 2), ("doc [part 2/2]", 2, 2), ("one", None, None)]


def test_fuzzy_ties_go_to_the_smallest(spark):
    n = spark.createDataFrame([("x", "International Widgets")], "uuid string, name string")
    k = spark.createDataFrame([("z", "International Widgets!"), ("a", "international widgets")], "uuid string, name string")
    assert resolve.fuzzy_resolution(n, k).first()["resolved"] == "a"
    assert resolve.exact_resolution(n, k).first()["resolved"] is None


def test_lsh_equals_the_exact_join(spark):
    """Misspelled names among thousands: the recall of all that the exact join resolves, and the same answers; however small chunks are."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(5, 9)))
    known = [(f"k{i:04d}", " ".join(word() for _ in range(rng.randint(2, 5)))) for i in range(1500)]
    known += [(f"t{i:04d}", f"a template of many names, number {i % 40}") for i in range(200)]
    new = []
    for i, (_, name) in enumerate(rng.sample(known, 400)):
        at = rng.randrange(len(name))
        new.append((f"n{i}", rng.choice([name, name + "x", name[:at] + "q" + name[at + 1 :], name.upper() + "!"])))
    new += [("short", "ab"), ("none", None), ("flat", "aaaaaaaaaa")]
    new, known = (spark.createDataFrame(x, "uuid string, name string").repartition(3) for x in (new, known))
    rows = lambda df: {r["uuid"]: (r["resolved"], r["score"]) for r in df.collect()}
    exact, signed = rows(resolve.fuzzy_resolution(new, known)), resolve.signed_names(known).cache()
    for chunk in (1024, 5):
        got = rows(resolve.lsh_resolution(new, signed, chunk=chunk))
        found = [u for u, (r, _) in exact.items() if r is not None]
        assert len(found) > 200 and set(got) == set(exact) and got == exact
    few = rows(resolve.lsh_resolution(new, resolve.signed_names(known, bands=1, rows=12), bands=1, rows=12))
    assert sum(few[u][0] is not None for u in found) < len(found)  # bands do decide who meets


def test_worst_status(spark):
    c = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    assert checks.worst_status(c("ok", "warn", "ok")).first()["status"] == "warn"
    assert checks.worst_status(c("fail", "warn")).first()["status"] == "fail"
    assert checks.worst_status(c()).first()["status"] == "ok"


def test_vector_top_takes_more_queries_than_a_block(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), float(i % 3)]) for i in range(40)], "vec_id long, embedding array<float>")
    rows = lambda: sorted(map(tuple, search.vector_top(v, v.where("vec_id < 25"), 3).collect()))
    whole = rows()
    monkeypatch.setattr(search, "MAX_QUERIES", 10)
    assert rows() == whole and len(whole) == 75


@pytest.mark.parametrize("sent", [100_000, 0])
def test_distances_from_both_ends(spark, monkeypatch, sent):
    """Against a plain walk, with a hub, a loop, a node without an end and one out of reach; with frontiers sent, and joined by salt."""
    monkeypatch.setattr(search, "SENT_FRONTIER", sent)
    pairs = [("c", "hub"), *[("hub", f"h{i}") for i in range(40)], *[(f"t{i}", f"t{i + 1}") for i in range(6)], ("t0", "h3"), ("t6", "c"), ("x", "y"), ("h1", "h1"), (None, "h2"), ("h2", None)]
    near, todo = {"c": 0}, ["c"]
    for at in todo:
        for a, b in [p for p in pairs if None not in p]:
            for one, other in ((a, b), (b, a)):
                if one == at and other not in near:
                    near[other] = near[at] + 1
                    todo.append(other)
    edges = spark.createDataFrame(pairs, "source_node_uuid string, target_node_uuid string").repartition(3)
    asked = ["c", "h7", "t0", "t2", "t3", "t4", "x", "unknown"]
    targets = spark.createDataFrame([(n,) for n in [*asked, "t2", None]], "uuid string")
    for most in (1, 3, 6):
        within = {n: d for n, d in near.items() if d <= most}
        assert {r["uuid"]: r["distance"] for r in search.node_distance(edges, "c", most).collect()} == within
        assert {r["uuid"]: r["distance"] for r in search.distance_to(edges, "c", targets, most).collect()} == {n: within[n] for n in asked if n in within}


def test_names_are_weighed_once_not_for_every_node(spark):
    """The filter on a name's variety stays above the grouping of equal names."""
    nodes = spark.createDataFrame([("a", "one name")], "uuid string, name string").repartition(2)
    plan = resolve.signed_names(nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LOG2") < plan.index("Aggregate") and "LOG2" not in plan[plan.index("Aggregate") :]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 1.0])
def test_sets_at_the_threshold_share_a_key(threshold):
    """Of all pairs of sets at the threshold, by the places that keys take in ordered sets; numbers that differ in a digit share none at 0.9."""
    known, new, most, largest = resolve._choices(threshold)
    assert most == 128 and largest >= most

    def keys(choices, s):
        return {(j, tuple(sorted(s)[i - 1] for i in at)) for size, j, at in choices if size == len(s)}

    rng = random.Random(5)
    for _ in range(150):
        a = set(rng.sample(range(400), rng.randint(3, 30)))
        b = (a - set(rng.sample(sorted(a), rng.randint(0, len(a) // 5)))) | set(rng.sample(range(400), rng.randint(0, 3)))
        if b and len(a & b) / len(a | b) >= threshold:
            assert keys(new, a) & keys(known, b), (a, b)
    name = lambda n: {f"customer{n:09d}"[i : i + 3] for i in range(15)}
    if threshold == 0.9:
        assert not any(keys(new, name(123456789)) & keys(known, name(n)) for n in (123456389, 193456789, 213456789))


def test_fuzzy_resolution_of_numbers_equals_all_pairs(spark):
    new, known = ([(f"{c}{i}", f"Customer#{i * step:09d}") for i in range(150)] for c, step in (("n", 37), ("k", 111)))
    sets = lambda rows: [(u, {n.lower().replace("#", "")[i : i + 3] for i in range(15)}) for u, n in rows]
    theirs = {}
    for u, a in sets(new):
        found = sorted((-round(len(a & b) / len(a | b), 9), k) for k, b in sets(known) if len(a & b) / len(a | b) >= 0.9)
        theirs[u] = (found[0][1], -found[0][0]) if found else (None, None)
    new, known = (spark.createDataFrame(x, "uuid string, name string") for x in (new, known))
    assert {r["uuid"]: (r["resolved"], r["score"]) for r in resolve.fuzzy_resolution(new, known).collect()} == theirs


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_vectors_in_cells_equal_those_scored_in_place(spark, monkeypatch, kind):
    """With copies, null, zero and non-finite vectors and components, vectors of another width and a query id in two rows; and no block of
    queries is a value of the plan."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, rng.gauss(0, 1)]) for _ in range(4 if i % 10 else 3)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(50)] + [(2000, None), (2001, [0.0] * 4), (2002, [float("nan"), 1.0, 1.0, 1.0]), (2003, [None, 1.0, 1.0, 1.0]), (2004, [float("inf"), 1.0, 1.0, 1.0]), (2005, []), (0, rows[4][1]), (1, rows[5][1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vec_id", F.col("vec_id").cast(kind)).repartition(3)
    asked = v.where("vec_id < 40 OR vec_id >= 1045")
    got = []
    for few in (1000, 0):
        monkeypatch.setattr(search, "FEW_QUERIES", few)
        monkeypatch.setattr(search, "MAX_QUERIES", 30)
        found = search.vector_top(v, asked, 5)
        got.append(sorted(repr(tuple(r)) for r in found.select("query_id", "vec_id", "score", "rank").collect()))
    assert got[0] == got[1] and len(got[0]) > 200
    assert "ScalarSubquery" not in found._jdf.queryExecution().optimizedPlan().toString() and "Union" in found._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_rounded_as_spark_does(spark):
    from chronoloom.operators.nearest import rounded

    xs = [i / 2e6 for i in range(-41, 42)] + [0.1234565, 0.9999995, -0.0000005, 1.0, 0.3333333333]
    theirs = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(F.round("x", 6)).collect()]
    import numpy as np

    assert [abs(a - b) for a, b in zip(rounded(np.array(xs)).tolist(), theirs)] == [0] * len(xs)


def test_texts_are_cut_by_rows(spark):
    """A worker holds few texts at once: no Arrow batch of 10,000."""
    r = spark.createDataFrame([("doc", "a" * 30)], "name string, body string")
    plan = chunk.chunk_records(r, 20)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("sent", [200_000, 0])
def test_rejections_meet_texts_where_these_are_read(spark, monkeypatch, sent):
    """Only matches are shuffled while rejections are few; however they meet, the result is that of all pairs, empty sets, repeated and
    null texts among them."""
    monkeypatch.setattr(gates, "SENT_WORDS", sent)
    rng = random.Random(11)
    line = lambda: " ".join(rng.choices("abcdefghij", k=rng.randint(0, 7)))
    t = [(i % 60, rng.choice("xy"), line()) for i in range(150)] + [(1, "x", "a b"), (1, "x", "a b"), (2, "x", None), (3, None, "a b"), (4, "x", "?!"), (5, "y", "z " * 50)]
    r = [(f"r{i}", rng.choice("xy"), [line(), line()]) for i in range(20)] + [("e", "x", [""]), ("n", None, ["a b"])]
    words = lambda s: set((s or "").replace("?!", "").split())
    texts, rejected = spark.createDataFrame(t, "id long, domain string, text string").repartition(3), spark.createDataFrame(r, "id string, domain string, facts array<string>")
    for threshold in (0.3, 0.75, 1.0):
        jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        theirs = {(i, s or "", k, max(jaccard(words(s), words(f)) for f in fs)) for i, d, s in t for k, e, fs in r if d is not None and d == e and max(jaccard(words(s), words(f)) for f in fs) >= threshold}
        got = gates.rejected_matches(texts, rejected, threshold)
        assert sorted((x["id"], x["text"] or "", x["rejected_id"], x["ratio"]) for x in got.collect()) == sorted(theirs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == bool(sent)


def test_words_are_counted_where_their_texts_are(spark):
    """No row of a word is shuffled: one exchange, of texts, below the words."""
    from chronoloom.sources.store import term_counts

    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b c"), (4, "")], "doc_id long, text string").repartition(2)
    found = term_counts(docs, "doc_id", F.col("text"))
    assert sorted(map(tuple, found.collect())) == [(1, "a", 2, 3), (1, "b", 1, 3), (3, "b", 1, 2), (3, "c", 1, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "Exchange" not in final[: final.index("Generate")]
