"""Commits over several tables, and searches through an index of words, against the scan."""

import os
import pathlib
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import index, search
from chronoloom.sources import commits, store
from chronoloom.sources.views import KINDS


def body():
    return F.concat_ws(" ", "name", "fact")


def node(spark, *uuids):
    return spark.createDataFrame([(u,) for u in uuids], "uuid string")


def uuids(df):
    return sorted(r["uuid"] for r in df.collect())


# ---------------------------------------------------------------- commits


def test_a_number_is_put_once(spark, tmp_path):
    at = f"file://{tmp_path}/log/1.json"
    assert commits.put_if_absent(spark, at, "a") and not commits.put_if_absent(spark, at, "b") and commits.read_text(spark, at) == "a"
    assert commits.read_text(spark, at + "x") is None and [p.name for p in (tmp_path / "log").iterdir()] == ["1.json"]
    won, go = [], threading.Barrier(8)

    def race(i):
        go.wait()
        won.append(commits.put_if_absent(spark, f"file://{tmp_path}/log/2.json", str(i)))

    threads = [threading.Thread(target=race, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(won) == 1


def test_put_by_rename(spark, tmp_path, monkeypatch):
    """The way of stores other than a local disk, here on one: a name that is taken stays as it is."""
    keep = commits._path

    class Other:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return (lambda: "hdfs") if name == "getScheme" else getattr(self.fs, name)

    monkeypatch.setattr(commits, "_path", lambda s, at: (lambda w, fs: (w, Other(fs)))(*keep(s, at)))
    (tmp_path / "log").mkdir()
    at = f"file://{tmp_path}/log/1.json"
    assert commits.put_if_absent(spark, at, "ä") and not commits.put_if_absent(spark, at, "b") and commits.read_text(spark, at) == "ä"


def test_a_commit_is_of_all_its_tables(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    s.set_up()
    n = s.write_all({"entity_node": node(spark, "a"), "entity_edge": node(spark, "e")})
    with pytest.raises(RuntimeError, match="stop"), s.log.transaction() as t:
        t.write("entity_node", store.fitted(node(spark, "lost"), "entity_node"))
        raise RuntimeError("stop")
    assert s.log.head() == n and uuids(s.read("entity_node")) == ["a"]
    held = s.log.at()
    s.write("entity_node", node(spark, "b"))
    assert uuids(held.read("entity_node")) == ["a"] and uuids(s.read("entity_node")) == ["b"] and uuids(s.read("entity_edge")) == ["e"]
    assert uuids(s.read("entity_node", number=n)) == ["a"] and s.read("entity_node", number=1).isEmpty()
    with pytest.raises(ValueError, match="no commit 99"):
        s.log.at(99)
    with pytest.raises(ValueError, match="unknown table"):
        s.log.stage("nothing", node(spark, "a"))


def test_order_is_that_of_numbers(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    for u in "abc":
        s.write("entity_node", node(spark, u))
    for i, p in enumerate(sorted((tmp_path / "entity_node").iterdir())):
        os.utime(p, (i, i))
    for p in (tmp_path / "log").iterdir():
        os.utime(p, (7, 7))
    assert uuids(s.read("entity_node")) == ["c"] and s.log.head() == 3


def test_conflicts(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    s.set_up()
    rows = lambda u, kind="entity_node": store.fitted(node(spark, u), kind)
    with pytest.raises(commits.Conflict, match="entity_node"), s.log.transaction() as t:  # wrote what another wrote
        t.write("entity_node", rows("mine"))
        s.write("entity_node", node(spark, "theirs"))
    with pytest.raises(commits.Conflict, match="entity_edge"), s.log.transaction() as t:  # read what another wrote
        t.write("entity_node", t.read("entity_edge").transform(lambda df: rows("mine")))
        s.write("entity_edge", node(spark, "e"))
    with s.log.transaction() as t:  # another table: both count
        t.write("entity_node", rows("mine"))
        s.write("episodic_node", node(spark, "p"))
    assert uuids(s.read("entity_node")) == ["mine"] and uuids(s.read("episodic_node")) == ["p"]


def test_racing_writers_lose_nothing(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    s.set_up()
    tried, go = [], threading.Barrier(2)

    def add(who):
        first = [True]

        def work(t):
            tried.append(who)
            had = t.read("entity_node")
            if first:  # both read before one of them commits
                first.pop()
                go.wait()
            t.write("entity_node", had.unionByName(store.fitted(node(spark, who), "entity_node")))

        s.change(work)

    threads = [threading.Thread(target=add, args=(w,)) for w in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert uuids(s.read("entity_node")) == ["a", "b"] and len(tried) == 3 and s.log.head() == 3


# ---------------------------------------------------------------- the index


WORDS = [f"w{i}" for i in range(40)] + ["é", "日本", "x_1", "A"]


def some_facts(spark, n, seed=1, start=0):
    rng = random.Random(seed)
    pick = lambda: WORDS[min(int(rng.expovariate(0.15)), len(WORDS) - 1)]
    rows = [(f"f{i:04d}", rng.choice(["n a", "n b", None]), " ".join(pick() for _ in range(rng.choice([0, 1, 3, 8, 30]))), rng.choice(["g", "h", "i", None])) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "uuid string, name string, fact string, group_id string")


def scan(rows, question, limit, groups=None):
    rows = rows if groups is None else rows.where(F.col("group_id").isin(groups))
    return [(r["uuid"], r["score"]) for r in search.top(search.bm25(rows, "uuid", body(), question), limit, "uuid").collect()]


def through(ix, question, limit, groups=None):
    return [(r["id"], r["score"]) for r in ix.search(question, limit, groups).collect()]


QUESTIONS = ["w0 w1", "w30 w0 n", "w39 w38 w37 w12", "é 日本 x_1 a", "b w3 w5 w0 w1 w2", "nothing", "nothing w9"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    facts = some_facts(spark, 700).cache()
    return facts, index.WordIndex.create(facts, f"file://{tmp_path_factory.mktemp('index')}", text=body(), buckets=8, block=4, slice_docs=200)


def test_index_equals_the_scan(built):
    facts, ix = built
    for limit, q in zip((1, 7, 100, 20, 3, 5, 9), QUESTIONS, strict=True):
        assert through(ix, q, limit) == scan(facts, q, limit), q
    for limit, q in zip((1, 7, 100), QUESTIONS, strict=False):
        assert through(ix, q, limit, ["g", "h"]) == scan(facts, q, limit, ["g", "h"]), q


def test_many_documents_left(built, monkeypatch):
    """More of them than are sent to all tasks: they meet the postings by id."""
    facts, ix = built
    monkeypatch.setattr(index, "FEW", 3)
    for q in QUESTIONS[:3]:
        assert through(ix, q, 20) == scan(facts, q, 20), q


def test_search_reads_few_blocks(built, monkeypatch):
    """Blocks that are looked through are those that could reach the best; folders of other terms are not opened."""
    facts, ix = built
    read = []
    keep = index.WordIndex._postings
    monkeypatch.setattr(index.WordIndex, "_postings", lambda self, blocks, segments: read.append(blocks) or keep(self, blocks, segments))
    ix.search("w30 w0 n", 3).collect()
    segments, _ = ix._segments()
    whole = ix._of(ix._read(segments, "blocks"), ["w30", "w0", "n"], None)
    looked = read[0].agg(F.sum("n")).first()[0]
    assert looked * 4 < whole.agg(F.sum("n")).first()[0] and {r["term"] for r in read[0].select("term").distinct().collect()} == {"w30"}
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*In\(term|PushedFilters: \[[^\]]*term", plan)
    narrow = ix._of(ix._read(segments, "blocks"), ["w30"], None).select("term", "n", "most_tf")
    assert "ids" not in narrow._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_search_reads_few_blocks_though_many_are_gone(spark, tmp_path, monkeypatch):
    facts = some_facts(spark, 400).cache()
    ix = index.WordIndex.create(facts, f"file://{tmp_path}", text=body(), buckets=8, block=4, slice_docs=200)
    left = facts.where(F.substring("uuid", 5, 1) != "3")
    ix.update(facts, left, text=body())
    monkeypatch.setattr(index, "FEW", 20)
    read = []
    keep = index.WordIndex._postings
    monkeypatch.setattr(index.WordIndex, "_postings", lambda self, blocks, segments: read.append(blocks) or keep(self, blocks, segments))
    assert through(ix, "w30 w0 n", 3) == scan(left, "w30 w0 n", 3)
    whole = ix._of(ix._read(ix._segments()[0], "blocks"), ["w30", "w0", "n"], None).agg(F.sum("n")).first()[0]
    assert all(one.agg(F.sum("n")).first()[0] * 4 < whole for one in read[:2])


def test_files_of_an_index_do_not_grow_with_the_square_of_its_slices(spark, tmp_path):
    """Words are counted in their rows, buckets stay as they are however many slices there are, and what an update met is not kept."""
    facts = some_facts(spark, 120)
    ix = index.WordIndex.create(facts, f"file://{tmp_path}", text=body(), buckets=4, block=4, slice_docs=10)
    assert ix.meta["slices"] == 12 and ix.meta["buckets"] == 4
    own = index.WordIndex._own(facts, "uuid", body(), "group_id")
    posted = index._posted(own, 12)
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()
    ours = sorted((r["id"], r["term"], r["tf"], r["dl"]) for r in posted.collect())
    assert ours == sorted((r["id"], r["term"], r["tf"], r["dl"]) for r in store.term_counts(own, "id", F.col("text")).collect())
    ix.update(facts, facts.where("uuid > 'f0050'"), text=body())
    assert list((tmp_path / "changes").glob("*/*")) == []


def test_find_facts_by_index_and_by_scan(spark, built):
    """The same rows and statistics from both plans; only the scan takes texts apart."""
    facts, ix = built
    facts = facts.withColumn("invalid_at", F.when(F.substring("uuid", 5, 1) == "3", F.lit("2020-01-01").cast("timestamp_ntz"))).withColumn("expired_at", F.lit(None).cast("timestamp_ntz"))
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    for asked in (search.Asked("w30 w0 n", 5), search.Asked("w3 b", 9, groups=["h"])):
        a, b = search.find_facts(facts, asked, now), search.find_facts(facts, asked, now, index=ix)
        pick = lambda f: [(r["uuid"], r["score"], r["place"]) for r in f.rows.orderBy("place").collect()]
        assert pick(a) == pick(b) and a.stats.collect() == b.stats.collect()
        assert "regexp_extract_all" in a.rows._jdf.queryExecution().executedPlan().toString() and "regexp_extract_all" not in b.rows._jdf.queryExecution().executedPlan().toString()


def test_segments_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "FAN", 2)
    now = some_facts(spark, 300)
    ix = index.WordIndex.create(now, f"file://{tmp_path}", text=body(), buckets=4, block=4, slice_docs=100)
    sizes = []
    for step in range(1, 4):  # each step adds, changes and drops some
        kept = now.where(F.pmod(F.xxhash64("uuid", F.lit(step)), F.lit(10)) > 0)
        after = kept.withColumn("fact", F.when(F.pmod(F.xxhash64("uuid", F.lit(-step)), F.lit(7)) == 0, F.concat_ws(" ", "fact", F.lit("w39 new"))).otherwise(F.col("fact")))
        after = spark.createDataFrame(after.unionByName(some_facts(spark, 20, seed=step, start=1000 * step)).collect(), now.schema)
        ix.update(now, after, text=body())
        now = after
        sizes.append(len(ix._segments()[0]))
        for q in ("w39 new w0", "w1 n b"):
            assert through(ix, q, 15) == scan(now, q, 15), (step, q)
    assert sizes == [2, 1, 2]


def test_an_index_has_one_writer(spark, tmp_path):
    facts = some_facts(spark, 5)
    ix = index.WordIndex.create(facts, f"file://{tmp_path}", text=body())
    with pytest.raises(ValueError, match="already"):
        index.WordIndex.create(facts, f"file://{tmp_path}", text=body())
    with pytest.raises(commits.Conflict):
        ix._publish([], 0, "")


def test_empty_index(spark, tmp_path):
    ix = index.WordIndex.create(some_facts(spark, 0), f"file://{tmp_path}", text=body())
    assert through(ix, "w0", 5) == []
    ix.update(some_facts(spark, 0), some_facts(spark, 9), text=body())
    assert through(ix, "w0 w1", 5) == scan(some_facts(spark, 9), "w0 w1", 5)


def test_store_searches_through_its_index(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    s.set_up()
    now = F.lit("2024-01-01").cast("timestamp")
    facts = some_facts(spark, 60)
    for rows in (facts, facts.unionByName(some_facts(spark, 10, start=900))):
        s.write("entity_edge", rows)
        stale = s.find_facts(search.Asked("w0 w1", 5), now)  # the index has an older version: a scan
        assert "edge_name_and_fact" in s.missing_indexes()
        s.build_indexes()
        assert s.missing_indexes() == []
        found = s.find_facts(search.Asked("w0 w1", 5), now)
        assert uuids(found.rows) == uuids(stale.rows) and "regexp_extract_all" not in found.rows._jdf.queryExecution().executedPlan().toString()
    s.write("entity_node", spark.createDataFrame([("n1", "Widget", "red steel"), ("n2", "Gadget", "steel steel")], "uuid string, name string, summary string"))
    s.build_indexes()
    assert [r["uuid"] for r in s.find_nodes(search.Asked("steel")).rows.orderBy("place").collect()] == ["n2", "n1"]
    assert pathlib.Path(f"{tmp_path}/indexes/edge_name_and_fact/manifests").is_dir() and set(KINDS) < set(store.TABLES)


def test_words_have_no_combining_marks(spark):
    """A mark parts a word, as it does for the question and for SQL."""
    from chronoloom.functions.text import tokens

    text = "éa b x_1 ١٢ ½"
    (got,) = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t")).alias("w")).collect()
    assert got["w"] == ["e", "a", "b", "x_1", "١٢", "½"] == re.findall(r"\w+", text)


def test_writes_count_and_check_what_they_write(spark, tmp_path):
    """Counts and checks come from the write's own job, and a commit keeps those of the tables that it did not write."""
    s = store.Store(spark, f"file://{tmp_path}")
    s.set_up()
    assert set(s.counts()) == set(store.TABLES) and set(s.counts().values()) == {0}
    f = spark.range(100, numPartitions=3).select(F.col("id").cast("string").alias("uuid"), F.when(F.col("id") % 10 > 0, "a fact").otherwise(" ").alias("fact"), F.lit("2024-01-02").cast("timestamp").alias("valid_at"))
    f = f.withColumn("invalid_at", F.when(F.col("uuid").endswith("7"), F.lit("2024-01-01").cast("timestamp"))).withColumn("uuid", F.when(F.col("uuid") != "5", F.col("uuid")))
    spark.sparkContext.setJobGroup("counted", "")
    number = s.write("entity_edge", f)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    assert s.counts() == dict.fromkeys(store.TABLES, 0) | {"entity_edge": 100} and jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    s.write("entity_node", spark.createDataFrame([("n", "name")], "uuid string, name string"))
    assert s.counts()["entity_edge"] == 100 and s.counts()["entity_node"] == 1 and s.counts(number)["entity_node"] == 0
    got = {(r["check"], r["status"]): r["detail"] for r in s.checks().where("kind = 'entity_edge'").collect()}
    assert got == {("no id", "fail"): 1, ("blank facts", "warn"): 10, ("ends before start", "warn"): 10}
    assert {r["status"] for r in s.checks().where("kind = 'entity_node'").collect()} == {"ok"}
