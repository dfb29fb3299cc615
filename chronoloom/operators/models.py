"""Models in batches: embedders and rankers that load once in a worker and see many texts at a time.

A model is a function without arguments that loads it and gives what it does: an embedder maps a list of texts to as many lists of numbers, a
ranker maps a question and a list of texts to as many numbers. Batches are Spark's Arrow batches, cut to ``batch`` texts; a worker keeps what
it has loaded under the model's name, so its later tasks do not load again. A null or blank text has no vector, and is
not shown to a model. An answer of another length, or a vector of another width, is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
Ranker = Callable[[str, list[str]], Sequence[float]]

_LOADED: dict[str, object] = {}  # of this worker


def loaded(name: str, load: Callable[[], object]):
    """The model of that name, loaded by the first task of a worker that asks for it."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def _batches(values: list, n: int) -> Iterator[list]:
    for start in range(0, len(values), n):
        yield values[start : start + n]


def embedding(df: DataFrame, text: Column, name: str, load: Callable[[], Embedder], width: int, *, batch: int = 256, out: str = "embedding") -> DataFrame:
    """df with the vectors of a text by a model."""
    ship(df.sparkSession)

    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(name, load)
        for texts in parts:
            asked = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            got: list = [None] * len(texts)
            for some in _batches(asked, batch):
                answer = model([texts.iloc[i] for i in some])
                if len(answer) != len(some):
                    raise ValueError(f"{name}: {len(answer)} vectors for {len(some)} texts")
                for i, v in zip(some, answer, strict=True):
                    if len(v) != width:
                        raise ValueError(f"{name}: a vector of {len(v)} numbers, not {width}")
                    got[i] = [float(x) for x in v]
            yield pd.Series(got, dtype=object)

    vectors.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(vectors, "array<float>")(text))


def ranker(question: str, name: str, load: Callable[[], Ranker], *, batch: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A ranker for ``find_facts``: candidates (fact, rank) to (passage, place, score), best first, ties in the order they came. Candidates are a
    search's, 1,000 at most, so one window puts them in order."""

    def rank(candidates: DataFrame) -> DataFrame:
        ship(candidates.sparkSession)

        def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = loaded(name, load)
            for texts in parts:
                got: list = []
                for some in _batches([t or "" for t in texts], batch):
                    answer = model(question, some)
                    if len(answer) != len(some):
                        raise ValueError(f"{name}: {len(answer)} scores for {len(some)} texts")
                    got += [float(x) for x in answer]
                yield pd.Series(got, dtype="float64")

        scores.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        own = candidates.select(F.col("fact").alias("passage"), "rank", F.pandas_udf(scores, "double")("fact").alias("score"))
        return own.select("passage", F.row_number().over(Window.orderBy(F.desc("score"), "rank")).alias("place"), "score")

    return rank


def re_embedded(records: dict[str, DataFrame], name: str, load: Callable[[], Embedder], width: int, *, batch: int = 256) -> dict[str, DataFrame]:
    """A graph's records with vectors where they have none, of nodes' names and of facts' texts: a snapshot carries no vectors, so what was
    restored is found by vector only after this. Vectors that are there are kept."""
    out = dict(records)
    for kind, text, vector in (("entity_node", "name", "name_embedding"), ("entity_edge", "fact", "fact_embedding")):
        if kind in out:
            rows = out[kind]
            had = F.col(vector) if vector in rows.columns else F.lit(None).cast("array<float>")
            rows = embedding(rows.withColumn(vector, had), F.when(F.col(vector).isNull(), F.col(text)), name, load, width, batch=batch, out="_new")
            out[kind] = rows.withColumn(vector, F.coalesce(vector, "_new")).drop("_new")
    return out
