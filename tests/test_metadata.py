from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.operators import chunk, metadata


def test_drift_and_record(spark):
    make = lambda *r: spark.createDataFrame(list(r), "database_key string, model string, dimensions int")
    old = make(("a", "m:latest", 768), ("b", "m", 768), ("c", "x", 768))
    new = make(("a", "m:v2", 768), ("b", "m", 384), ("c", "m", 768), ("d", "m", 768))
    assert {r["database_key"]: r["drift"] for r in metadata.embedder_drift(old, new).collect()} == {"a": None, "b": "dimensions", "c": "model", "d": None}
    assert metadata.record_identity(old, new).count() == 4


def test_target_group(spark):
    r = spark.createDataFrame([("1", "a"), ("2", ""), ("3", None), ("4", "z")], "uuid string, group_id string")
    got = {x["uuid"]: (x["target_group"], x["problem"]) for x in metadata.target_group(r, None, ["a"]).collect()}
    assert got == {"1": ("a", None), "2": (None, "no group"), "3": (None, "no group"), "4": ("z", "not allowed")}
    assert {x["target_group"] for x in metadata.target_group(r, "a", ["a"]).collect()} == {"a"}


def test_retryable(spark):
    rows = [(429, "X", ""), (503, "X", ""), (400, "TimeoutError", "timeout"), (None, "TimeoutError", ""), (None, "X", "HTTP 429 seen"), (None, "X", "Service Unavailable"), (None, "X", "no"), (None, "OutputTruncatedError", "timeout")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, k string, d string")
    got = [x["r"] for x in df.select("i", metadata.retryable(F.col("s"), F.col("k"), F.col("d")).alias("r")).orderBy("i").collect()]
    assert got == [True, True, False, True, True, True, False, False]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=200), st.integers(2, 40))
def test_chunks_are_bounded_and_lossless(text, most):
    got = chunk.chunks(text, most)
    assert all(0 < len(c) <= most for c in got)
    assert "".join("".join(got).split()) == "".join(text.split())
