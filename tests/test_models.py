"""Models in batches: loads are counted in the workers, answers are held against plain ones."""

import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import models, review, search


def loader(folder, width=4, short=False):
    """An embedder that leaves a file for each load, and one for each batch with its size."""

    def load():
        import os

        pathlib.Path(folder, f"load-{os.getpid()}-{uuid.uuid4().hex}").write_text("")

        def embed(texts):
            pathlib.Path(folder, f"batch-{uuid.uuid4().hex}").write_text(str(len(texts)))
            return [[float(len(t)), float(t.count("a")), 1.0, 0.0][:width] for t in texts][: len(texts) - short]

        return embed

    return load


def test_a_worker_loads_a_model_once(spark, tmp_path):
    name = uuid.uuid4().hex
    df = spark.range(90, numPartitions=6).select("id", F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 9 == 1, " ").otherwise(F.concat(F.lit("aa"), "id")).alias("t"))
    for _ in range(2):
        got = {r["id"]: (r["t"], r["v"]) for r in models.embedding(df, F.col("t"), name, loader(str(tmp_path)), 4, batch=5, out="v").collect()}
    assert len(got) == 90
    assert all(v == (None if t is None or not t.strip() else [float(len(t)), 2.0, 1.0, 0.0]) for t, v in got.values())
    pids = [p.name.split("-")[1] for p in tmp_path.glob("load-*")]
    assert pids and len(pids) == len(set(pids))
    assert max(int(p.read_text()) for p in tmp_path.glob("batch-*")) <= 5


@pytest.mark.parametrize(("wrong", "why"), [({"width": 3}, "3 numbers, not 4"), ({"short": True}, "vectors for")])
def test_wrong_answers_are_errors(spark, tmp_path, wrong, why):
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    with pytest.raises(Exception, match=why):
        models.embedding(df, F.col("t"), uuid.uuid4().hex, loader(str(tmp_path), **wrong), 4).collect()


def test_restored_records_are_found_by_vector(spark, tmp_path):
    facts = spark.createDataFrame([("f1", "banana", "n1", "n2", "g", None), ("f2", "xyz", "n1", "n2", "g", None), ("f3", "kept", "n1", "n2", "g", [9.0, 9.0, 9.0, 9.0])], "uuid string, fact string, source_node_uuid string, target_node_uuid string, group_id string, fact_embedding array<float>")
    nodes = spark.createDataFrame([("n1", "ann", "g"), ("n2", None, "g")], "uuid string, name string, group_id string")
    out = models.re_embedded({"entity_edge": facts, "entity_node": nodes}, uuid.uuid4().hex, loader(str(tmp_path)), 4)
    assert {r["uuid"]: r["fact_embedding"] for r in out["entity_edge"].collect()} == {"f1": [6.0, 3.0, 1.0, 0.0], "f2": [3.0, 0.0, 1.0, 0.0], "f3": [9.0] * 4}
    assert {r["uuid"]: r["name_embedding"] for r in out["entity_node"].collect()} == {"n1": [3.0, 1.0, 1.0, 0.0], "n2": None}
    assert [r["uuid"] for r in search.nearest_to(out["entity_edge"], [6.0, 3.0, 1.0, 0.0], "fact_embedding", 1).collect()] == ["f1"]
    restored = review.restore({"entity_node": out["entity_node"].limit(0), "entity_edge": out["entity_edge"].limit(0)}, {"entity_node": nodes}, embed=lambda r: models.re_embedded(r, uuid.uuid4().hex, loader(str(tmp_path)), 4))[0]
    assert {r["uuid"]: r["name_embedding"] for r in restored["entity_node"].collect()} == {"n1": [3.0, 1.0, 1.0, 0.0], "n2": None}


def test_a_ranker_in_batches(spark):
    def load():
        return lambda question, texts: [float(t.count(question)) for t in texts]

    found = spark.createDataFrame([("a", "x", 1), ("b", "x y x", 2), ("c", "y", 3), ("d", None, 4)], "uuid string, fact string, rank int")
    answer = models.ranker("x", uuid.uuid4().hex, load, batch=2)(found)
    assert [(r["passage"], r["score"]) for r in answer.orderBy("place").collect()] == [("x y x", 2.0), ("x", 1.0), ("y", 0.0), (None, 0.0)]
    assert [r["uuid"] for r in search.rerank(found.where("fact IS NOT NULL"), answer, limit=2).orderBy("final_rank").collect()] == ["b", "a"]
