from pyspark.sql import functions as F

from chronoloom.llm import chat, mixing, ngram_join

SCHEMA = "doc_id long, source string, text string"


def words(start, n=60):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_stages_lose_no_rows_without_or_with_shared_ids(spark, sf_dir):
    rows = [(1, "a", words(0)), (1, "a", words(1000)), (None, "a", words(2000)), (None, "b", words(0) + " more"), (2, "b", words(0)), (3, "b", None), (4, "b", None)]
    kept = ngram_join.dedupe_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), sf_dir)
    assert kept.columns == ["doc_id", "source", "text"]
    # Texts of their own stay whatever their id; of the near copies, the smallest id; texts without words link with nothing.
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, spark.createDataFrame(rows[:3] + rows[5:], SCHEMA).collect()))

    rows = [(None, "a", words(100 * i, 10 + i % 7)) for i in range(40)] + [(7, "b", words(100 * i, 10)) for i in range(40, 60)] + [(i, "c", words(100 * i, 10)) for i in range(60, 120)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mix_stage(spark, docs, sf_dir).collect()
    size, most = lambda s: sum(len(r["text"].split()) for r in got if r["source"] == s), 16
    per = {r["source"]: r for r in mixing.mix(docs).groupBy("source").agg({"target": "max"}).withColumnRenamed("max(target)", "goal").collect()}
    assert all(abs(size(s) - per[s]["goal"]) <= 1.05 * most for s in "abc") and size("a") > 0


def test_stage_joins_five_words_at_80_percent(spark, sf_dir):
    """Two words of 100 changed: 86 of 106 5-word shingles are shared (81 %), 89 of 105 of 4 words (84.8 %); with a third
    word changed, 81 of 111 (73 %)."""
    text = words(0, 100).split()
    change = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(text))
    rows = [(1, "a", change()), (2, "a", change(30, 60)), (3, "a", change(10, 45, 80))]
    kept = ngram_join.dedupe_stage(spark, spark.createDataFrame(rows, SCHEMA), sf_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_common_turns_are_the_prompt(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    (got,) = chat.format_pairs(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()
    assert got["n_prompt_turns"] == 1 and "hi" in got["prompt"] and "yes" in got["chosen"] and "no" in got["rejected"] and "hi" not in got["chosen"]


def test_rows_alike_are_mixed_as_any_others(spark):
    """Most of the table one text without an id: equal to the SQL over the same rows, as documents and by a key of the rows."""
    import duckdb

    rows = [(None, "a b c", "web")] * 3000 + [(i, f"w{i} " * (i % 40), ["web", "books", None][i % 3]) for i in range(900)] + [(7, "x y", "books")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = sorted(map(repr, con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP9_SQL})").fetchall()))
    of = lambda df: sorted(repr((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"])) for r in df.collect())
    assert of(mixing.mix(docs)) == want
    keyed = mixing.mix(docs.withColumn("_row", F.monotonically_increasing_id()), row_col="_row")
    assert of(keyed) == want and keyed.select("_row").distinct().count() == len(rows)
